"""Token ids in length-delimited binary records with an offset index (operator 12).

A file is a run of frames: u64 length of the payload, u32 masked CRC-32C of those eight bytes,
the payload, u32 masked CRC-32C of the payload (all little-endian): the widespread record
format of training-data loaders.  A payload is u32 flags (1: the document has no id; 2: an id
passes 16 bits), u32 number of ids, i64 document id, then the ids as u16, or u32 under flag 2.  The index is a Parquet table beside the files,
(file, offset, size, doc_id, n_tokens) per record, so that readers may take records in any order.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from railspark.session import ensure_checkpoint_dir

from .common import ship, texts_of, written

#: Bytes after which a task goes on to a new file, and bytes that a reader takes at once.
FILE_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: A payload's head: flags, number of ids, document id.
BODY, BODY_BYTES = "<IIq", 16
#: Fixed values of the record format: the reflected Castagnoli polynomial and the mask's constant.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 512
INDEX = "file string, offset long, size long, doc_id long, n_tokens long"


@functools.cache
def registers() -> tuple[np.ndarray, np.ndarray]:
    """(register after a byte and the rest of its block in zeros, flat by place and byte;
    register after BLOCK zero bytes by byte of the register before, 4 x 256)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (step & np.uint32(1)))
    after = [step]
    for _ in range(BLOCK - 1):
        after.append((after[-1] >> np.uint32(8)) ^ step[after[-1] & np.uint32(255)])
    shift = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for _ in range(BLOCK):
        shift = (shift >> np.uint32(8)) ^ step[shift & np.uint32(255)]
    return np.concatenate(after[::-1]), shift


def masked_crcs(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of every part (of four bytes or more), all parts at once.

    The register is linear in the message, so a block's is the XOR of one table entry per byte.
    Parts are filled up with zeros in front, which leave an empty register as it is.
    """
    table, shift = registers()
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    out = np.zeros(len(parts), np.uint32)
    raw = np.zeros(int(ends[-1]) * BLOCK if len(parts) else 0, np.uint8)
    for part, end in zip(parts, (ends * BLOCK).tolist()):
        raw[end - len(part):end] = np.frombuffer(part, np.uint8)
        raw[end - len(part):end - len(part) + 4] ^= 255  # the register starts as all ones
    per_block = np.empty(len(raw) // BLOCK, np.uint32)
    place = np.arange(BLOCK, dtype=np.int32) << 8
    for at in range(0, len(per_block), 1024):  # blocks at once: bounds the scratch space
        some = raw[at * BLOCK:(at + 1024) * BLOCK].reshape(-1, BLOCK)
        per_block[at:at + 1024] = np.bitwise_xor.reduce(table[some + place], axis=1)
    first = ends - blocks
    for k in range(int(blocks.max(initial=0))):
        go = np.flatnonzero(blocks > k)
        r = out[go]
        out[go] = shift[0][r & 255] ^ shift[1][(r >> 8) & 255] ^ shift[2][(r >> 16) & 255] ^ shift[3][r >> 24] ^ per_block[first[go] + k]
    out = ~out
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    """The payloads, each framed with its length and both checksums."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    return [b"".join((n, struct.pack("<I", a), p, struct.pack("<I", b)))
            for n, a, p, b in zip(lengths, masked_crcs(lengths).tolist(), payloads, masked_crcs(payloads).tolist())]


def unframed(records: list[bytes]) -> list[bytes]:
    """The payloads of whole frames; a wrong length or checksum raises ValueError."""
    payloads = [r[12:-4] for r in records]
    if [len(p) for p in payloads] != [struct.unpack_from("<Q", r)[0] for r in records]:
        raise ValueError("a record's length does not match its frame")
    heads = np.array([struct.unpack_from("<I", r, 8)[0] for r in records], np.uint32)
    tails = np.array([struct.unpack_from("<I", r, len(r) - 4)[0] for r in records], np.uint32)
    if (masked_crcs([r[:8] for r in records]) != heads).any() or (masked_crcs(payloads) != tails).any():
        raise ValueError("a record's checksum does not match its bytes")
    return payloads


class Words(dict):
    """Little-endian u32 ids of each distinct word, found when it is first asked for.

    Two generations of at most ``REMEMBERED`` words: a full one turns old, and what is asked for
    again moves to the new one, so common words stay.
    """

    REMEMBERED = 1 << 19

    def __init__(self, find):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.find(word)
        if len(self) >= self.REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of whole texts, as the tokenizer file's library gives them without special tokens added.

    Words repeat, so each distinct word (between blanks that end a token in any case) is encoded
    once.  A word of ASCII and Latin letters goes through the file's own lower case and pattern
    here and through the library's model piece by piece; any other word, and any file with other
    steps than these, goes through the whole library.
    """

    #: Characters that are composed already and whose lower case and class do not depend on their neighbours.
    PLAIN = regex.compile(r"[!-~\u00a1-\u017f]*")
    #: Python splits words at these, the file's pattern does not.
    ODD = "\x1c\x1d\x1e\x1f"
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"] \
            and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and spec["post_processor"] is None
        self.special = [t["content"] for t in spec["added_tokens"]]
        if self.by_word:
            self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
        rest = iter(range(256, 512))  # bytes without a shape of their own are shown by these
        self.shown = {b: b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(rest) for b in range(256)}
        self.words, self.pieces = Words(self.word), Words(self.piece)

    def piece(self, piece: str) -> bytes:
        seen = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.shown)
        return np.array([t.id for t in self.whole.model.tokenize(seen)], "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable() or self.PLAIN.fullmatch(word)) or "<" in word and any(s in word for s in self.special):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        low = word.lower()
        if low.isalpha():
            return self.pieces[low]
        return b"".join([self.pieces[p] for p in self.pattern.findall(low)])

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        words = [w for w in regex.split("[ \t\n]", text) if w] if any(c in text for c in self.ODD) else text.split()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every row's ids and ``end_id`` as one record, in ascending id order over the files; returns the index.

    Rows are dealt by ranges of (id, hash of the text), so rows that share an id do not meet in
    one task; null ids come last.  File names ascend in the same order and carry a name of their
    task attempt: only the attempt whose index rows Spark commits is ever read, so a task that
    is run again after an executor is lost leaves at worst a file that nobody refers to.
    """
    ship(docs.sparkSession)
    store = f"{path.rstrip('/')}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = encoder(vocabulary), np.array([end_id], "<u4")
        part, attempt, roll, out, at = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None, 0
        system, base = files.FileSystem.from_uri(store)
        for b in batches:
            keys = b.column(0).to_pylist()
            payloads, counts = [], []
            for key, t in zip(keys, texts_of(b)):
                ids = np.concatenate([model.encode(t), end])
                wide = int(ids.max()) >> 16 > 0
                counts.append(len(ids))
                payloads.append(struct.pack(BODY, (key is None) + 2 * wide, len(ids), key or 0) + ids.astype("<u4" if wide else "<u2").tobytes())
            rows = []
            for key, n, frame in zip(keys, counts, frames(payloads)):
                if out is None or at and at + len(frame) > file_bytes:
                    if out is not None:
                        out.close()
                    name, at, roll = f"ids-{part:08d}-{roll:06d}-{attempt}", 0, roll + 1
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}")
                out.write(frame)
                rows.append((name, at, len(frame), key, n))
                at += len(frame)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.string(), *[pa.int64()] * 4))],
                                             ["file", "offset", "size", "doc_id", "n_tokens"])
        if out is not None:
            out.close()

    rows = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].cast("string").alias("_text"))
    order = [F.col("_id").asc_nulls_last(), F.xxhash64(F.coalesce("_text", F.lit("")))]
    rows.repartitionByRange(*order).sortWithinPartitions(*order, "_text").mapInArrow(run, INDEX) \
        .write.parquet(f"{path.rstrip('/')}/index")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index")


def read_records(index: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(file, offset, doc_id, n_tokens, ids_crc32[, ids]) of the records that ``index`` names, in its order.

    Give the index shuffled (``index.orderBy(F.rand(seed))``), cut down or joined, and each task
    reads its records by their offsets; neighbours in a file are read at once.  Both checksums of
    every record are verified, and an id or length that differs from the index raises.
    """
    ship(index.sparkSession)
    store = f"{path.rstrip('/')}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = files.FileSystem.from_uri(store)
        name, source = None, None

        def taken(run: list[tuple]) -> list[bytes]:
            nonlocal name, source
            if run[0][0] != name:
                if source is not None:
                    source.close()
                name, source = run[0][0], system.open_input_file(f"{base}/{run[0][0]}")
            start = run[0][1]
            raw = source.read_at(run[-1][1] + run[-1][2] - start, start)
            return [raw[at - start:at - start + size] for _, at, size, _, _ in run]

        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            at = 0
            while at < len(rows):
                end, size = at + 1, rows[at][2]
                while end < len(rows) and size < READ_BYTES and rows[end][0] == rows[at][0] and rows[end][1] == rows[end - 1][1] + rows[end - 1][2]:
                    size += rows[end][2]
                    end += 1
                out = []
                for (file, offset, _, key, n), payload in zip(rows[at:end], unframed(taken(rows[at:end]))):
                    flags, count, ident = struct.unpack_from(BODY, payload)
                    body = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=BODY_BYTES)
                    if (None if flags & 1 else ident, count, len(body)) != (key, n, count):
                        raise ValueError(f"the record at {offset} of {file} is not the one that the index names")
                    out.append((file, offset, key, count, zlib.crc32(body.astype("<u4").tobytes()), body.astype(np.int64) if ids else None))
                cols = list(zip(*out))[:5 + ids]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["file", "offset", "doc_id", "n_tokens", "ids_crc32", "ids"][:5 + ids])
                at = end
        if source is not None:
            source.close()

    return index.select("file", "offset", "size", "doc_id", "n_tokens") \
        .mapInArrow(run, "file string, offset long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the record files.

    ``start``: ids in all records before it.  A running sum within each (bounded) file, plus the
    sums of the files before it, one row per file.  Null texts are empty and give ``end_id``
    alone, null ids stand last and come back null, rows that repeat an id each give a record,
    long texts are records of any size, an empty table gives an empty table, and other columns
    are not read.
    """
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    rows = written(read_records(write_records(docs, path, vocabulary, end_id, doc_id, text), path))
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = sums.select("file", (F.sum("_n").over(W.orderBy("file")) - F.col("_n")).alias("_before"))
    local = F.sum("n_tokens").over(W.partitionBy("file").orderBy("offset")) - F.col("n_tokens")
    return rows.withColumn("_start", local).join(before, "file") \
        .select("doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")
