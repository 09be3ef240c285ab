"""Suffix-array removal of byte strings that occur more than once (operator 6).

Every 200-byte string is assigned to an anchor: the smallest hashed 32-byte gram inside it (the
leftmost on ties).  Equal strings have equal anchors at equal offsets, so only documents that
share an anchor can share a string, and the start positions of a document fall into disjoint
regions, one per anchor.  Regions whose anchor occurs once are done.  Regions that are equal as
a whole are repeated as a whole.  The different regions of a shared anchor go to a shard, where

* a suffix array is built by Larsson-Sadakane refinement in numpy (ranks of the first h bytes
  sort the first 2h, and only groups that are still tied are touched again),
* Kasai's pass gives each suffix its common prefix with its neighbour in the array, all regions
  of the shard in lockstep, and a start is repeated if a neighbour shares 200 bytes,
* an anchor with too many regions for one shard is split over several, whose sorted strings are
  then merged by binary search in tasks for ranges of strings.

The results are spans of documents, so no shard and no task ever holds a whole group of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import written

LENGTH = 200
GRAM = 32
#: Bytes of regions in one suffix array, about.
SHARD = 2_000_000
#: Bytes of text that pass through the anchor search at once; longer texts go in overlapping parts.
PART = 8_000_000
#: Strings of split anchors in one merging task, about, and what is known of each.
MERGE = 1_000_000
STRING = np.dtype([("string", "<u8"), ("g", "<i8"), ("r", "<i8"), ("at", "<i4"), ("unsettled", "?")])
_RNG = np.random.default_rng(20240607)  # fixed, so every task and every run hashes alike
TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive bytes (uint64; none if there are fewer)."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    out, have, h, width, power = None, 0, TABLE[data], 1, STEP
    while True:  # binary digits of size: hashes of 1, 2, 4, ... bytes are joined to what is there
        if size & width:
            if out is None:
                out = h
            else:
                n = len(data) - have - width + 1
                out = out[:n] * power + h[have:have + n]
            have += width
        if have == size:
            break
        h, power, width = h[:-width] * power + h[width:], np.uint64(int(power) ** 2 % (1 << 64)), 2 * width
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


def regions(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, number of starts) of the regions of one text part."""
    starts = len(data) - length + 1
    if starts < 1:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2)
    h = gram_hashes(data, gram)
    # smallest (hash, position) in every window of length - gram + 1 grams, by doubling
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    window, have = length - gram + 1, 1
    while 2 * have <= window:
        key, have = np.minimum(key[:-have], key[have:]), 2 * have
    if have < window:
        key = np.minimum(key[:len(key) - (window - have)], key[window - have:])
    anchor = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return h[anchor[first]], first, np.diff(np.append(first, starts))


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all positions by the first ``depth`` bytes of their suffixes.

    ``ends``: for every position the end of its region; a suffix stops there and sorts before
    its extensions.  Larsson-Sadakane: rank is the index of a group's first member, sorted
    groups stay, and tied ones are sorted by the rank ``h`` further on, with h doubling.
    """
    n = len(text)
    room = ends - np.arange(n)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(8)) | np.where(room > j, padded[j:n + j], np.uint64(0))
    key = (key << np.uint64(8)) | np.minimum(room, 7).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    tied = ~new | ~np.append(new[1:], True)  # by place in order: member of a group of two or more
    h = 7
    while h < depth and tied.any():
        place = np.flatnonzero(tied)
        at = order[place]
        ahead = np.where(room[at] > h, rank[np.minimum(at + h, n - 1)] + 1, 0)
        group = rank[at]
        by = np.argsort(group * (n + 1) + ahead, kind="stable")  # groups keep their places
        at, ahead, group = at[by], ahead[by], group[by]
        order[place] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])])
        rank[at] = place[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        tied[place] = ~fresh | ~np.append(fresh[1:], True)
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For every position the common prefix (up to ``limit``) with the suffix before it in ``order``.

    Kasai: going right by one loses at most one byte of it, so bytes are compared once; the
    regions (``starts``..region end) are walked side by side.  ``ends``: region end by position.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(n + 1, np.uint64)
    for j in range(8):
        words[:n] |= padded[j:n + j].astype(np.uint64) << np.uint64(8 * j)
    out, have = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    at, lane = starts.copy(), np.arange(len(starts))
    while len(lane):
        other = before[at]
        most = np.minimum(np.minimum(ends[at] - at, np.where(other >= 0, ends[other] - other, 0)), limit)
        h = np.minimum(have[lane], most)
        live = np.flatnonzero(h < most)
        while len(live):
            i, j = at[live] + h[live], other[live] + h[live]
            diff = words[i] ^ words[j]
            low = diff & (~diff + np.uint64(1))  # lowest differing bit: its byte is the first that differs
            same = np.where(diff == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            h[live] = np.minimum(h[live] + same, most[live])
            live = live[(same == 8) & (h[live] < most[live])]
        out[at] = h
        have[lane] = np.maximum(h - 1, 0)
        go = at + 1 < ends[at]
        at, lane = at[go] + 1, lane[go]
    return out


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For every part, which of its start positions hold a string that also starts elsewhere in the parts."""
    sizes = np.array([len(p) for p in parts])
    last = np.cumsum(sizes)
    starts, ends = last - sizes, np.repeat(last, sizes)
    text = np.frombuffer(b"".join(parts), np.uint8)
    # in full: Kasai's step holds only in a complete order (equal suffixes go by position)
    order, _ = suffix_array(text, ends, int(sizes.max()))
    prefix = common_prefixes(text, starts, ends, order, length)
    hit = prefix >= length
    hit[order[:-1]] |= prefix[order[1:]] >= length
    return [hit[s:s + max(0, n - length + 1)] for s, n in zip(starts, sizes)]


def runs_of(mask: np.ndarray) -> np.ndarray:
    """(first, last) of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2) - [0, 1]


def repeated_spans(docs: DataFrame, text: str = "_text", key: str = "_key", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(key, spans): the byte spans (start, end) to remove, per distinct text.

    ``docs``: key identifies the text's content and ``_id`` the row; equal texts have equal keys.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, ids = b.column(0), b.column(1)
            for row, t in enumerate(b.column(2)):
                raw = t.as_buffer()
                if raw is None or raw.size < length:
                    continue
                data, view = np.frombuffer(raw, np.uint8), memoryview(raw)
                for base in range(0, len(data) - length + 1, PART):
                    g, lo, n = regions(data[base:base + PART + length - 1], length)
                    lo = lo + base
                    r = np.array([xxhash.xxh3_64_intdigest(view[i:i + m + length - 1]) for i, m in zip(lo.tolist(), n.tolist())], np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), pa.repeat(ks[row], len(g)),
                                                      pa.repeat(ids[row], len(g)), pa.array(lo), pa.array(n.astype(np.int32))], ["g", "r", "k", "id", "lo", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in find(batches):  # few, large record batches
            held.append(b)
            rows += b.num_rows
            if rows > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    source = docs.select(F.col(key).alias("k"), F.col("_id").alias("id"), F.encode(F.col(text), "UTF-8").alias("raw"))
    found = written(source.mapInArrow(merged, "g long, r long, k binary, id long, lo long, n int"))
    shared = found.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("g").alias("_g"))
    hits = written(found.join(shared, F.col("g") == F.col("_g")).drop("_g"))
    variants = written(hits.groupBy("g", "r").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("k", "id", "lo", "n")).alias("at")))
    per_anchor = variants.groupBy("g").agg(F.count(F.lit(1)).alias("v"), F.sum(F.col("at.n") + length - 1).alias("size")).filter("v > 1") \
        .select(F.col("g").alias("_g"), "size")
    # an anchor's regions share a shard; large anchors are split over shards of their own
    several = F.ceil(F.col("size") / (shard // 4)).cast("int")
    judged = written(variants.join(per_anchor, F.col("g") == F.col("_g"))
                     .select("g", "r", "m", F.col("at.k").alias("k"), F.col("at.id").alias("id"), F.col("at.lo").alias("lo"), F.col("at.n").alias("n"),
                             F.when(several > 1, F.pmod(F.xxhash64("r"), several)).otherwise(-1).cast("int").alias("split")))
    total = judged.agg(F.sum(F.when(F.col("split") < 0, F.col("n") + length - 1))).first()[0] or 0
    name = F.when(F.col("split") < 0, F.concat(F.lit("s"), F.pmod(F.xxhash64("g"), F.lit(max(1, -(-total // shard))))))\
        .otherwise(F.concat(F.lit("g"), F.col("g"), F.lit("/"), F.col("split")))
    wanted = judged.withColumn("shard", name).groupBy(F.col("k").alias("_k"), F.col("id").alias("_id")) \
        .agg(F.collect_list(F.struct("shard", "g", "r", "m", "split", "lo", "n")).alias("parts"))  # a document's own regions

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, parts in zip(b.column(0), b.column(1).to_pylist()):
                view = memoryview(raw.as_buffer())
                cols = [[p[c] for p in parts] for c in ("shard", "g", "r", "m", "split")]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))),
                                                  pa.array([bytes(view[p["lo"]:p["lo"] + p["n"] + length - 1]) for p in parts], pa.binary())],
                                                 ["shard", "g", "r", "m", "split", "bytes"])

    pieces = source.join(wanted, (F.col("k") == F.col("_k")) & (F.col("id") == F.col("_id"))).select("raw", "parts") \
        .mapInArrow(extract, "shard string, g long, r long, m long, split int, bytes binary")

    open_starts = judged.agg(F.sum(F.when(F.col("split") >= 0, F.col("n")))).first()[0] or 0
    ranges = max(1, -(-open_starts // MERGE))

    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of repeated starts of the regions seen once; of split anchors also the shard's
        different strings, as one sorted run for each range of string hashes."""
        pdf = pdf.drop_duplicates(["g", "r"]).reset_index(drop=True)
        out, strings = [], []
        for (g, r, m, split, raw), hit in zip(zip(pdf["g"], pdf["r"], pdf["m"], pdf["split"], pdf["bytes"]), repeated_starts(list(pdf["bytes"]), length)):
            if m < 2:
                out += [(g, r, a, z, None, None) for a, z in runs_of(hit).tolist()]
            if split >= 0:
                one = np.zeros(len(hit), STRING)
                one["string"], one["g"], one["r"], one["at"] = gram_hashes(np.frombuffer(raw, np.uint8), length), g, r, np.arange(len(hit))
                one["unsettled"] = ~hit & (m < 2)
                strings.append(one)
        if strings:
            run = np.concatenate(strings)
            run = run[np.unique(run["string"], return_index=True)[1]]  # sorted; a string found twice here is settled
            cuts = run["string"].searchsorted(np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64))
            out += [(0, 0, 0, 0, k, x.tobytes()) for k, x in enumerate(np.split(run, cuts)) if len(x)]
        got = pd.DataFrame(out, columns=["g", "r", "a", "z", "range", "run"])
        got["range"] = got["range"].astype("Int64")
        return got

    results = written(pieces.groupBy("shard").applyInPandas(judge, "g long, r long, a long, z long, range long, run binary"))

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Unsettled strings that another shard holds too, by binary search in the shards' sorted runs."""
        runs = [np.frombuffer(x, STRING) for x in pdf["run"]]
        both = np.sort(np.concatenate([x["string"] for x in runs]), kind="stable")  # of sorted runs: a merge
        found = []
        for x in runs:
            x = x[x["unsettled"]]
            x = x[both.searchsorted(x["string"], "right") - both.searchsorted(x["string"], "left") > 1]
            found.append(pd.DataFrame({"g": x["g"], "r": x["r"], "a": x["at"], "z": x["at"]}))
        return pd.concat(found).astype("int64")

    runs = results.filter("range is null").select("g", "r", "a", "z")
    if open_starts:
        runs = runs.unionByName(results.filter("range is not null").groupBy("range").applyInPandas(merge, "g long, r long, a long, z long"))
    whole = variants.filter("m > 1").select("g", "r", F.lit(0).cast("long").alias("a"), (F.col("at.n") - 1).cast("long").alias("z"))
    runs = runs.unionByName(whole).select(F.col("g").alias("_g"), F.col("r").alias("_r"), "a", "z")
    return hits.join(runs, (F.col("g") == F.col("_g")) & (F.col("r") == F.col("_r"))) \
        .select("k", (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("z") + length).alias("e")).distinct() \
        .groupBy(F.col("k").alias(key)).agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # of one text: bounded by it


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))).alias("_id"),
                       F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text")).withColumn("_key", F.unhex(F.md5("_text")))


def removed_runs(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans merged into maximal runs."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in (spans if spans is not None else ())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes when a ``length``-byte string that covers it also starts anywhere else, in
    the same text or another; all occurrences go.  Null text is empty; texts shorter than
    ``length`` stay whole; rows that repeat a text lose all of it.
    """
    source = keyed(docs, doc_id, text)
    spans = repeated_spans(source, length=length, shard=shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, sp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, runs = t.encode(), removed_runs(sp)
                out.append((None if i == -(1 << 63) else i, len(raw), sum(e - s for s, e in runs), len(runs),
                            hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*(pa.int64(),) * 4, pa.string()))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = source.join(spans.withColumnRenamed("_key", "_k"), F.col("_key") == F.col("_k"), "left").select("_id", "_text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` and n_chars, if there, counted anew.

    Runs shrink inwards to whole characters, so the text stays valid; rows and all other
    columns, of any name, stay as they are, also where nothing of the text is left.  An empty
    table gives an empty table.
    """
    own = max([*docs.columns, ""], key=len)  # names that start with it are longer than every column's
    key, content, runs = own + "_key", own + "_content", own + "_spans"
    ids = F.monotonically_increasing_id() if "doc_id" not in docs.columns else F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    source = docs.withColumn(content, F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(key, F.unhex(F.md5(content)))
    spans = repeated_spans(source.select(ids.alias("_id"), F.col(content).alias("_text"), F.col(key).alias("_key")), length=length) \
        .select(F.col("_key").alias(own + "_of"), F.col("spans").alias(runs))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, sp in zip(texts, runs):
            if sp is None or not len(sp):
                out.append(t)
                continue
            raw, whole = t.encode(), []
            for s, e in removed_runs(sp):
                while s < e and raw[s] & 0xC0 == 0x80:
                    s += 1
                while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                    e -= 1
                whole.append((s, e))
            out.append(kept_bytes(raw, whole).decode())
        return pd.Series(out)

    joined = source.join(spans, F.col(key) == F.col(own + "_of"), "left")
    clean = F.when(F.col(runs).isNull(), F.col(text)).otherwise(cut(content, runs))
    cols = [clean.alias(c) if c == text else F.col(c) for c in docs.columns]
    out = joined.select(*cols)
    return out.withColumn("n_chars", F.char_length(F.coalesce(text, F.lit(""))).cast("long")) if "n_chars" in docs.columns else out
