"""WARC archives: write with segmentation and chunked framing, read with reassembly (operator 10).

Writing: one record per page, an HTTP response whose body is sent in chunked framing.  Records
longer than a segment go out as a first segment plus ``continuation`` records.  Archives are
written and read by Spark's own file sources, so any shared store works and lost tasks are
simply written again.

Reading: records are parsed by their Content-Length; whole records are decoded where they are
read; only segments are shuffled, grouped by their origin's identifier, ordered by segment
number, checked against the total length, and then decoded from chunked framing.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from railspark.session import ensure_checkpoint_dir

from .common import ship, written

SEGMENT = 16_384  # bytes of a record's block in one segment
CHUNK = 4_096  # bytes of one chunk of the HTTP body
RECORDS_PER_FILE = 2_000  # bounds an archive's size: a task reads whole archives
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def record_id(key: str) -> str:
    """A stable record identifier, so a task that runs again writes the same bytes."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, key)}>"


def record(kind: str, ident: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the final line end, which the archive writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", ident), *headers,
                                                 ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """``body`` in HTTP/1.1 chunked transfer framing."""
    parts = [body[k:k + size] for k in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of chunked framing; ValueError if the framing is broken or cut off."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is cut off")
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2 + size
        if framed[at:at + 2] != b"\r\n" and size:
            raise ValueError("chunk does not end where its size says")
        if not size:
            return b"".join(out)
        out.append(framed[end + 2:at])
        at += 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block, out of its transfer framing."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP head is cut off")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def page_records(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None,
                 key: str | None = None, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page: a revisit, a response, or a response with its continuations.

    ``key`` names the row in the record identifiers, so pages that share an id keep apart; a
    revisit names the page, address and digest of what it refers to."""
    key = f"page:{page_id}" if key is None else key
    ident = record_id(key)
    uri = lambda u: "".join(c if 32 < ord(c) < 127 else "%%%02X" % (ord(c) & 255) for c in u) or "urn:none"
    about = [("WARC-Target-URI", uri(url)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        about.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        about += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", uri(refers_url or "")),
                  ("WARC-Refers-To-Date", "1970-01-01T00:00:00Z"), ("X-Refers-To-Page", str(refers_to))]
        return [record("revisit", ident, about, HTTP)]
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        return [record("response", ident, about, block)]
    parts = [block[k:k + segment] for k in range(0, len(block), segment)]
    out = [record("response", ident, [*about, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        out.append(record("continuation", record_id(f"{key}:{k}"),
                          [("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(k)), *total], part))
    return out


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 1000, segment: int = SEGMENT) -> None:
    """Writes ``pages`` as WARC files under ``path``, a record for every row.

    Payload: the html in UTF-8, null as empty.  Of equal payloads of at least ``least_bytes``
    the one with the largest page id is the response, the others revisit it (groups by SHA-1
    and length, aggregated map-side; only groups of two or more are joined back).  Each row has
    an identifier of its own; rows that repeat the response's page id and payload are responses
    too, and so are payloads none of whose rows has a page id.  A null page id has no header.
    """
    ship(pages.sparkSession)
    rows = pages.select(pages[page_id].cast("long").alias("_id"),
                        F.coalesce(pages[url].cast("string"), F.lit("")).alias("_url"),
                        F.encode(F.coalesce(pages[html].cast("string"), F.lit("")), "UTF-8").alias("_payload")) \
        .withColumn("_sha", F.sha1("_payload"))
    groups = rows.filter(F.octet_length("_payload") >= least_bytes).groupBy("_sha", F.octet_length("_payload").alias("_len")) \
        .agg(F.max(F.struct("_id", "_url")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n") \
        .withColumnRenamed("_sha", "_g")
    other = F.col("_first._id").isNotNull() & ~F.col("_first._id").eqNullSafe(F.col("_id"))
    rows = rows.join(groups, (F.col("_sha") == F.col("_g")) & (F.octet_length("_payload") == F.col("_len")), "left") \
        .select("_id", "_url", "_payload", "_sha", F.when(other, F.col("_first._id")).alias("_refers"),
                F.when(other, F.col("_first._url")).alias("_there"), F.expr("uuid()").alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):  # a few pages at a time bound the memory
                rows = zip(*(c.to_pylist() for c in b.slice(at, 64).columns))
                yield pa.RecordBatch.from_arrays([pa.array([x for row in rows for x in page_records(*row, segment)], pa.binary())], ["record"])

    # bytes pass through the text sink untouched; its line end closes each record
    rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")) \
        .write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive, out of gzip."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, archive[end + 4:end + 4 + size]
        at = end + 4 + size + 4


ROW = "record_id string, origin_id string, segment long, total long, kind string, page_id long, refers_to long, " \
      "declared string, payload_bytes long, payload_digest string, payload binary, complete boolean, block binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records under ``path``, segments put together: record_id, kind, page_id, refers_to,
    declared (digest in the header), payload_bytes, payload_digest, complete, and the payload
    itself on request.

    A record whose segments are not 1..n, whose bytes are not as many as its last segment
    says, or whose framing is broken stays in the result with ``complete`` false and null
    payload columns.  One record's segments are bounded by that record's size.
    """
    ship(spark)
    names = [x.split(" ")[0] for x in ROW.split(", ")]

    def decoded(block: bytes) -> tuple:
        try:
            body = payload_of(block)
        except ValueError:
            return None, None, None, False
        return len(body), hashlib.sha1(body).hexdigest(), body if payloads else None, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda h, k: int(h[k]) if k in h else None
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                 pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.binary()]
        for b in batches:
            for archive in b.column(0):
                out, held = [], 0
                for h, block in parse(gzip.decompress(archive.as_buffer())):
                    kind, part = h["warc-type"], "warc-segment-number" in h
                    got = (None, None, None, True) if part or kind == "revisit" else decoded(block)
                    out.append((h["warc-record-id"], h.get("warc-segment-origin-id", h["warc-record-id"]),
                                number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), kind,
                                number(h, "x-page-id"), number(h, "x-refers-to-page"),
                                h.get("warc-payload-digest", "").removeprefix("sha1:"), *got, block if part else None))
                    if (held := held + len(block)) > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def join_segments(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["segment", "record_id"])
        first, block = pdf.iloc[:1].copy(), b"".join(pdf["block"])
        whole = list(pdf["segment"]) == list(range(1, len(pdf) + 1)) and first["kind"].iloc[0] != "continuation" \
            and len(block) == pdf["total"].iloc[-1]
        n, sha, body, ok = decoded(block) if whole else (None, None, None, False)
        first["payload_bytes"], first["payload_digest"], first["complete"] = pd.array([n], "Int64"), sha, ok
        first["payload"], first["block"] = pd.Series([body], index=first.index, dtype=object), None
        return first

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = written(files.mapInArrow(run, ROW))  # archives are parsed once; both kinds of record come from it
    whole = records.filter("segment is null")
    parts = records.filter("segment is not null").groupBy("origin_id").applyInPandas(join_segments, ROW)
    return whole.unionByName(parts).drop("origin_id", "segment", "total", "block")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000,
               segment: int = SEGMENT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from archives.

    A revisit takes length and digest from the response that it names, as found in the
    archives by page and digest; without it both are null.  Every row comes back, rows that
    repeat a page id (with equal or different payloads) and null page ids (as null) too; null
    and empty texts have payloads of no bytes, long ones go out in segments, an empty table
    gives an empty table, and other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, page_id, url, html, least_bytes, segment)
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    rows = written(read_archives(spark, path))
    responses = rows.filter("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
                                                        F.lit(None).cast("long").alias("refers_to"))
    found = rows.filter("kind = 'response'").groupBy(F.col("page_id").alias("_page"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = rows.filter("kind = 'revisit'").select("page_id", F.col("kind").alias("record_type"), "refers_to", "declared") \
        .join(found, (F.col("refers_to") == F.col("_page")) & (F.col("declared") == F.col("payload_digest")), "left")
    return responses.unionByName(revisits.select(responses.columns))
