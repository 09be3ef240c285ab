"""MinHash near-duplicates by fast similarity sketching (operator 7).

A document's set of five-word shingles is thrown into the bins of a sketch round by round: in
the first t rounds every element picks a bin by its hash, in the next t rounds round t + b puts
all elements into bin b, and a bin keeps the smallest (round, value).  So every coordinate is
filled by the time round 2t ends, usually after a few rounds, and the share of equal coordinates
estimates the Jaccard similarity with the concentration of independent draws.

Sketches are cut into bands; documents that share a band are candidates.  Copies of the same
set are one class from the start.  The candidates of a connected group of classes meet in one
task (or, if large, in tasks for pairs of bounded blocks of similar size), where full sets are
compared exactly; only links that join two parts not yet joined leave the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import first_by_id, likely_in, placed, texts_of, written
from .components import components

WORDS_PER_SHINGLE = 5
#: 32 bands of 4 coordinates: a pair at similarity 0.85 shares no band with probability 6e-11.
BANDS, ROWS = 32, 4
#: Shingles that one block of a verification task holds at most, about (16 MB).
BLOCK = 2_000_000
MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000 and len(word) < 64:
            self[word] = h
        return h


KNOWN = Words()


def shingles(text: str, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's k-word shingles, A-Z lower-cased.

    Fewer than k words: the whole sequence is the one shingle; no word: no shingle.
    """
    words = text.encode().lower().split()  # bytes lower A-Z only and split at \\x20, \\x09-\\x0D only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return mix(np.array([np.uint64(len(h)) + sum(int(x) * (2 * i + 3) for i, x in enumerate(h)) % (1 << 64)], np.uint64))
    out = h[:len(h) - k + 1].copy()
    for j in range(1, k):
        out = mix(out * MULT + h[j:len(h) - k + 1 + j])
    return np.unique(out)


def sketch(elements: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """The t coordinates of a non-empty set's fast similarity sketch."""
    bins = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, at = len(elements), 0
    while at < 2 * t:
        many = max(1, min(t if at < t else 2 * t, at + -(-t // n)) - at)
        rounds = np.arange(at, at + many, dtype=np.uint64)
        v = mix(elements[None, :] + mix(rounds * MULT + np.uint64(0x51))[:, None])
        where = (v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if at < t else \
            np.broadcast_to((rounds - np.uint64(t))[:, None], v.shape)
        value = (rounds[:, None] << np.uint64(32)) | (v & np.uint64(0xFFFFFFFF))
        np.minimum.at(bins, where.astype(np.int64).ravel(), value.ravel())
        at += many
        if (bins != np.iinfo(np.uint64).max).all():
            break
    # a coordinate stands for its element: (round, value) of equal elements in equal bins are equal
    return bins


def band_keys(bins: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    grid = bins.reshape(bands, rows)
    key = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for j in range(rows):
        key = mix(key * MULT + grid[:, j])
    return key.view(np.int64)


def linked(a: int, b: int, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """den * |A and B| >= num * |A or B|, in whole numbers."""
    return den * common >= num * (a + b - common)


def forest(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what exact comparison connects, one fewer than the members of each part.

    Each set in turn is compared with all later sets of other parts at once, by marking its
    elements in the concatenation of all sets.  ``sides``: compare only across the two sides
    (each side's own pairs are another task's).
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = ids[order], [sets[k] for k in order]
    sides = None if sides is None else sides[order]
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark, part, out = np.zeros(flat.max() + 1, bool), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        # sorted by size: later sets are larger, and a link needs den * |A| >= num * |B|
        last = np.searchsorted(sizes, den * sizes[i] / num, "right")
        lo = i + 1
        if lo >= last:
            continue
        rest = np.arange(lo, last)
        if sides is not None:
            rest = rest[sides[rest] != sides[i]]
        rest = rest[part[rest] != part[i]]
        if not len(rest):
            continue
        mark[flat[starts[i]:starts[i + 1]]] = True
        if len(rest) * 2 > last - lo:
            sums = np.add.reduceat(mark[flat[starts[lo]:starts[last]]], starts[lo:last] - starts[lo], dtype=np.int64)[rest - lo]
        else:
            sums = np.array([np.count_nonzero(mark[flat[starts[j]:starts[j + 1]]]) for j in rest])
        mark[flat[starts[i]:starts[i + 1]]] = False
        for j in rest[linked(sizes[i], sizes[rest], sums, num, den)]:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 80, den: int = 100,
                    bands: int = BANDS, rows: int = ROWS, k: int = WORDS_PER_SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked when
    den * |A and B| >= num * |A or B| over their k-word shingle sets.

    component_id is the smallest doc_id reachable over links; kept marks it.  Documents
    without words (null, empty) link with nothing.  Every row is linked by its own text, so rows
    that repeat an id may carry different texts and still get a component each; ``kept`` marks all
    rows whose id is their component's.  Rows with a null id are their own component, null, and
    stay.  Very long texts count whole; an empty table gives an empty table; further columns are
    not read.  Sets are compared by their 64-bit shingle hashes.
    """
    t = bands * rows

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, keys = [], [], []
            for x in texts_of(b):
                s = shingles(x, k)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(sketch(s, t), bands, rows) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["_id", "_n", "_set", "_keys"])

    source = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].cast("string").alias("_text"))
    all_rows = written(source.mapInArrow(sketched, "_id long, _n long, _set binary, _keys array<long>"))
    # classes of equal sets: a number and one representative each; all links are between the numbers
    classes = written(all_rows.filter("_set is not null and _id is not null").groupBy("_set")
                      .agg(F.min("_id").alias("_rep"), F.min("_n").alias("_n")).withColumn("_class_id", F.monotonically_increasing_id()))
    reps = all_rows.join(classes.select("_rep", "_class_id", F.col("_set").alias("_s")), (F.col("_id") == F.col("_rep")) & (F.col("_set") == F.col("_s")))
    band_rows = written(reps.select(F.col("_class_id").alias("_id"), F.explode("_keys").alias("_key")).distinct())
    hubs = band_rows.groupBy("_key").agg(F.min("_id").alias("_hub"), F.max("_id").alias("_last")).filter("_hub <> _last").select("_key", "_hub")
    groups = written(components(band_rows.join(hubs, "_key").select(F.col("_hub").alias("u"), F.col("_id").alias("v"))))
    # sets sizes in classes of ratio num/den: linked sets are in the same or in neighbouring classes
    members = groups.join(classes, F.col("node") == F.col("_class_id")) \
        .select("node", "component", "_n", F.floor(F.log(F.col("_n")) / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int").alias("_class"))
    totals = members.groupBy("component").agg(F.sum("_n").alias("_all"))
    by_class = members.groupBy("component", "_class").agg(F.sum("_n").alias("_in")) \
        .select(F.col("component").alias("_c"), F.col("_class").alias("_k"), F.ceil(F.col("_in") / block).cast("int").alias("_blocks"))
    here = by_class.select("_c", "_k", "_blocks")
    below = by_class.select(F.col("_c").alias("_c1"), (F.col("_k") + 1).alias("_k1"), F.col("_blocks").alias("_down"))
    above = by_class.select(F.col("_c").alias("_c2"), (F.col("_k") - 1).alias("_k2"), F.col("_blocks").alias("_up"))
    small = members.join(totals.filter(f"_all <= {block}").withColumnRenamed("component", "_c"), F.col("component") == F.col("_c")) \
        .select("node", "component", F.lit("all").alias("_task"), F.lit(0).alias("_side"))
    plan = here.join(totals.filter(f"_all > {block}").select(F.col("component").alias("_c0")), F.col("_c") == F.col("_c0")) \
        .join(below, (F.col("_c") == F.col("_c1")) & (F.col("_k") == F.col("_k1")), "left") \
        .join(above, (F.col("_c") == F.col("_c2")) & (F.col("_k") == F.col("_k2")), "left") \
        .select("_c", "_k", "_blocks", F.coalesce("_down", F.lit(0)).alias("_down"), F.coalesce("_up", F.lit(0)).alias("_up"))
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    dealt = members.join(plan, (F.col("component") == F.col("_c")) & (F.col("_class") == F.col("_k"))).withColumn("_b", mine)
    # block b of class k meets the blocks of its own class and those of the next; names are sorted, so both sides agree
    same = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(
        F.concat_ws("/", F.lit("s"), F.col("_class"), F.least(o, F.col("_b")), F.greatest(o, F.col("_b"))).alias("task"),
        F.when(o == F.col("_b"), F.lit(0)).when(F.col("_b") < o, F.lit(1)).otherwise(F.lit(2)).alias("side")))
    up = F.when(F.col("_up") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("_up") - 1, F.lit(0))), lambda o: F.struct(
        F.concat_ws("/", F.lit("u"), F.col("_class"), F.col("_b"), o).alias("task"), F.lit(1).alias("side"))))
    down = F.when(F.col("_down") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("_down") - 1, F.lit(0))), lambda o: F.struct(
        F.concat_ws("/", F.lit("u"), F.col("_class") - 1, o, F.col("_b")).alias("task"), F.lit(2).alias("side"))))
    empty = F.array().cast("array<struct<task:string,side:int>>")
    large = dealt.select("node", "component", F.explode(F.concat(same, F.coalesce(up, empty), F.coalesce(down, empty))).alias("_t")) \
        .select("node", "component", F.col("_t.task").alias("_task"), F.col("_t.side").alias("_side"))
    tasks = written(small.unionByName(large))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, k).tobytes() for x in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in sets], pa.binary()),
                                              pa.array(sets, pa.binary())], ["_id", "_set", "_bytes"])

    wanted = written(classes.join(tasks.select(F.col("node").alias("_w")).distinct(), F.col("_class_id") == F.col("_w"))
                     .select(F.col("_rep").alias("_r"), F.col("_set").alias("_s"), "_class_id"))
    # texts of no candidate stay where they are; only the others are shuffled
    likely = likely_in(source, "_id", wanted.select("_r"))
    full = likely.join(wanted, F.col("_id") == F.col("_r"), "left_semi").mapInArrow(sets_of, "_id long, _set binary, _bytes binary") \
        .join(wanted, (F.col("_id") == F.col("_r")) & (F.col("_set") == F.col("_s"))).select("_class_id", "_bytes")

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        side = pdf["_side"].to_numpy()
        pairs = forest(pdf["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["_bytes"]], side if side.any() else None, num, den)
        return pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")

    links = tasks.join(full, F.col("node") == F.col("_class_id")).groupBy("component", "_task").applyInPandas(verify, "u long, v long")
    found = components(links)
    joined = classes.join(found, F.col("_class_id") == F.col("node"), "left") \
        .select(F.col("_set").alias("_s"), "_rep", F.coalesce("component", "_class_id").alias("_part"))
    least = joined.groupBy(F.col("_part").alias("_p")).agg(F.min("_rep").alias("_comp"))
    parts = joined.join(least, F.col("_part") == F.col("_p")).select("_s", "_comp")
    return all_rows.join(parts, F.col("_set") == F.col("_s"), "left") \
        .select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"),
                F.when(F.col("_id").isNotNull(), F.coalesce("_comp", "_id")).alias("component_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component of linked rows, that with the smallest id (null last), then the first.

    Each row is judged by its own text, so rows that share an id, or have none, are compared as
    well.  Rows without words stay.  Further columns may have any name.
    """
    rows, row = placed(docs)
    found = near_duplicates(rows, doc_id=row, num=num, den=den).select(F.col("doc_id").alias(row + "_of"), F.col("component_id").alias("_part"))
    parts = written(rows.select(row, rows["doc_id"].alias("_id")).join(found, F.col(row) == F.col(row + "_of")).select(row, "_id", "_part"))
    several = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), first_by_id(F.col("_id"), row).alias("_stays")) \
        .filter("_n > 1").select(F.col("_part").alias("_p"), "_stays")
    gone = written(parts.join(several, (F.col("_part") == F.col("_p")) & (F.col(row) != F.col("_stays"))).select(F.col(row).alias(row + "_gone")))
    return rows.join(gone, F.col(row) == F.col(row + "_gone"), "left_anti").drop(row)
