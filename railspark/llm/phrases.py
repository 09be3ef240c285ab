"""Phrase collocations by the stripes pattern (operator 11).

A stripe belongs to a prefix word of one language: an associative counter of what follows it,
the next word and the word after that ("" is the end of a piece).  Tasks build stripes over
chunks of text, equal prefixes' stripes are merged element by element, and one merged stripe
gives everything that the score asks for: its sum is f(w1), the sums of its next words are
f(w1 w2), its elements are f(w1 w2 w3), and the largest element under a next word is the
extension that may subsume the pair.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import ship, texts_of, written

#: Pieces end at these characters; fixed by the operator's contract.
BREAKS = b".,;:!?\n\x0b\x0c\r"
TOKENS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]|[^ \t.,;:!?\n\x0b\x0c\r]+")

#: Words that a task counts before it hands its stripes on, and elements in one row of them.
CHUNK, ROW = 1 << 21, 4096
#: Stripes with more elements than this over all tasks are merged as rows, others whole.
WHOLE = 1 << 20

#: A stripe's elements: ``follow`` holds "next after" lines (words have neither blanks nor line ends), ``n`` their counts.
STRIPE = "lang string, prefix string, follow string, n array<long>"
DIGEST = "lang string, w1 string, w2 string, w3 string, words int, f long, best long"


class Vocabulary(dict):
    """Number of each word of a chunk, from 1; every break is 0."""

    def __init__(self) -> None:
        super().__init__({bytes([b]): 0 for b in BREAKS})
        self.words = [""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word.decode())
        return number


def summed(first: np.ndarray, second: np.ndarray, third: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct (first, second, third) in ascending order and the sum of their weights (or their number)."""
    a, b, c = (int(x.max(initial=0)) + 1 for x in (first, second, third))
    if a * b * c < 1 << 62:
        code = (first.astype(np.int64) * b + second) * c + third
        order = np.argsort(code, kind="stable")
        code = code[order]
        new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    else:
        order = np.lexsort((third, second, first))
        rows = np.stack([first[order], second[order], third[order]])
        new = np.flatnonzero(np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)])
    at = order[new]
    total = np.diff(np.r_[new, len(order)]) if weight is None else np.add.reduceat(weight[order], new) if len(new) else weight[:0]
    return first[at], second[at], third[at], total.astype(np.int64)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the (grouped) columns changes."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def stripes_of(lang: str, ids: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """The stripes of one language's word numbers (0: break, also at the end)."""
    ids = np.r_[ids, 0, 0]
    at = np.flatnonzero(ids)
    second = ids[at + 1]
    w1, w2, w3, n = summed(ids[at], second, np.where(second > 0, ids[at + 2], 0))
    cut = starts(w1)
    cut = np.unique(np.r_[cut, np.arange(0, len(w1), ROW)])  # no row has more than ROW elements
    for k in range(0, len(cut), ROW):
        some = cut[k:k + ROW]
        end = cut[k + ROW] if k + ROW < len(cut) else len(w1)
        offsets = pa.array(np.r_[some, end] - some[0], pa.int32())
        part = slice(some[0], end)
        follow = pc.binary_join_element_wise(words.take(pa.array(w2[part])), words.take(pa.array(w3[part])), " ")
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(some), pa.string()), words.take(pa.array(w1[some])),
            pc.binary_join(pa.ListArray.from_arrays(offsets, follow), "\n"), pa.ListArray.from_arrays(offsets, pa.array(n[part]))],
            ["lang", "prefix", "follow", "n"])


def stripes(docs: DataFrame, lang: str = "lang", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Stripes of every task's chunks of ``chunk`` words or a little more: (lang, prefix, follow, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        vocabulary, size = Vocabulary(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = pa.array(vocabulary.words, pa.string())
            for key, ids in held.items():
                yield from stripes_of(key, np.concatenate(ids), words)

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), texts_of(b)):
                found = TOKENS.findall(t.encode().lower())  # bytes: only A-Z have a lower case
                held[key].append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                held[key].append(np.zeros(1, np.int64))
                size += len(found)
                if size >= chunk:
                    yield from flush()
                    held.clear()
                    vocabulary, size = Vocabulary(), 0
        yield from flush()

    return docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")), docs[text].cast("string")).mapInArrow(run, STRIPE)


def digest(rows: pa.Table, least: int) -> pa.RecordBatch:
    """Merges the stripes of whole prefixes, sorted by prefix, and reads the figures off them."""
    lang, prefix = (c.combine_chunks().dictionary_encode() for c in (rows["lang"], rows["prefix"]))
    new = starts(lang.indices.to_numpy(), prefix.indices.to_numpy())
    key = np.zeros(len(rows), np.int64)
    key[new[1:]] = 1
    lists = rows["n"].combine_chunks()
    key = np.repeat(np.cumsum(key), np.diff(lists.offsets.to_numpy()))
    words = pc.split_pattern(pc.split_pattern(rows["follow"].combine_chunks(), "\n").flatten(), " ").flatten().dictionary_encode()
    number, words = words.indices.to_numpy(), words.dictionary
    k, w2, w3, n = summed(key, number[::2], number[1::2], lists.flatten().to_numpy())
    blank = pc.index(words, "").as_py()
    prefixes = pa.Table.from_arrays([rows["lang"], rows["prefix"]], ["lang", "w1"]).take(pa.array(new))

    word_at, pair_at = starts(k), starts(k, w2)
    f1, f2 = np.add.reduceat(n, word_at), np.add.reduceat(n, pair_at)
    best = np.maximum.reduceat(np.where(w3 == blank, 0, n), pair_at)
    pick = (f2 >= least) & (w2[pair_at] != blank)
    pair_at, f2, best = pair_at[pick], f2[pick], best[pick]
    triple_at = np.flatnonzero((n >= least) & (w3 != blank))
    # end-of-piece elements have "" as both words, so a whole triple never has a blank second word
    at = np.concatenate([word_at, pair_at, triple_at])
    kind = np.repeat(np.array([1, 2, 3], np.int32), [len(word_at), len(pair_at), len(triple_at)])
    named = prefixes.take(pa.array(k[at]))
    return pa.RecordBatch.from_arrays(
        [named["lang"].combine_chunks(), named["w1"].combine_chunks(),
         words.take(pa.array(w2[at], mask=kind < 2)), words.take(pa.array(w3[at], mask=kind < 3)), pa.array(kind),
         pa.array(np.concatenate([f1, f2, n[triple_at]])),
         pa.array(np.concatenate([np.zeros_like(f1), best, np.zeros(len(triple_at), np.int64)]), mask=kind != 2)],
        ["lang", "w1", "w2", "w3", "words", "f", "best"])


def merged(rows: DataFrame, least: int, whole: int = WHOLE) -> DataFrame:
    """Figures of every prefix out of its merged stripe: f of words, pairs and triples, ``best`` of pairs.

    Words are all there; pairs and triples from ``least`` occurrences on.  Stripes that hold more
    than ``whole`` elements over all tasks are merged as (prefix, element) rows, so that a very
    common prefix meets in no single task; all others come together as whole stripes.
    """
    large = rows.groupBy("lang", "prefix").agg(F.sum(F.size("n")).alias("_size")).filter(F.col("_size") > whole)
    large = written(large.select("lang", "prefix", F.lit(True).alias("_large")))
    tagged = rows.join(large, ["lang", "prefix"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b.column(3).flatten())
            if size < whole // 2:
                continue
            rows = pa.Table.from_batches(held)
            last = (rows["lang"][len(rows) - 1], rows["prefix"][len(rows) - 1])
            same = pc.and_(pc.equal(rows["lang"], last[0]), pc.equal(rows["prefix"], last[1]))
            cut = pc.index(same, True).as_py()  # the last prefix may go on in the next batch
            if cut:
                yield digest(rows.slice(0, cut), least)
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(len(x.column(3).flatten()) for x in held)
        if held and sum(map(len, held)):
            yield digest(pa.Table.from_batches(held), least)

    small = tagged.filter("_large is null").drop("_large").repartition("lang", "prefix") \
        .sortWithinPartitions("lang", "prefix").mapInArrow(run, DIGEST)
    cells = tagged.filter("_large").select("lang", F.col("prefix").alias("w1"), F.inline(F.arrays_zip(F.split("follow", "\n").alias("pair"), "n")))
    cells = written(cells.groupBy("lang", "w1", F.substring_index("pair", " ", 1).alias("w2"), F.substring_index("pair", " ", -1).alias("w3"))
                    .agg(F.sum("n").alias("f")))
    none = F.lit(None)
    words = cells.groupBy("lang", "w1").agg(F.sum("f").alias("f")) \
        .select("lang", "w1", none.cast("string").alias("w2"), none.cast("string").alias("w3"), F.lit(1).alias("words"), "f", none.cast("long").alias("best"))
    pairs = cells.filter("w2 <> ''").groupBy("lang", "w1", "w2") \
        .agg(F.sum("f").alias("f"), F.coalesce(F.max(F.when(F.col("w3") != "", F.col("f"))), F.lit(0)).alias("best")).filter(F.col("f") >= least) \
        .select("lang", "w1", "w2", none.cast("string").alias("w3"), F.lit(2).alias("words"), "f", "best")
    triples = cells.filter((F.col("w3") != "") & (F.col("f") >= least)) \
        .select("lang", "w1", "w2", "w3", F.lit(3).alias("words"), "f", none.cast("long").alias("best"))
    return small.unionByName(words).unionByName(pairs).unionByName(triples)


def score_of(a: str, left: str, right: str) -> str:
    """floor(1000000 a a / (l r)) in exact decimals; counts up to 14 digits keep within 38."""
    d = "cast({} as decimal(14,0))".format
    return f"(cast(1000000 as decimal(7,0)) * {d(a)} * {d(a)}) div ({d(left)} * {d(right)})"


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, subsumed_percent: int = 50, lang: str = "lang", text: str = "text",
                 chunk: int = CHUNK, whole: int = WHOLE) -> DataFrame:
    """The best ``top`` phrases of two or three words of every language.

    Returns (lang, rank, phrase, a, l, r, n, score), score descending, then a, then the phrase's
    UTF-8 bytes.  A phrase counts from ``least`` occurrences on; the lowest-scoring cut into two
    counts (ties: the first).  A pair inside a triple that has ``subsumed_percent`` of its
    occurrences or more is dropped.  Null texts are empty, a null language is ``und``; empty
    texts and tables give no phrases, repeated rows count each time, texts of any length count
    whole, and other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    figures = written(merged(written(stripes(docs, lang, text, chunk)), least, whole))
    words = figures.filter("words = 1").select("lang", F.col("w1").alias("w"), "f")
    pairs, triples = figures.filter("words = 2"), figures.filter("words = 3")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    first, last = words.select("lang", F.col("w").alias("w1"), F.col("f").alias("f1")), words.select("lang", F.col("w").alias("_w"), F.col("f").alias("fl"))
    # a pair's extension to the left is the best triple that ends in it
    before = triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("f").alias("_before"))
    two = pairs.join(before, ["lang", "w1", "w2"], "left") \
        .withColumn("_longer", F.greatest(F.when(F.col("best") >= least, F.col("best")).otherwise(0), F.coalesce("_before", F.lit(0)))) \
        .filter((F.col("_longer") < least) | (100 * F.col("_longer") < subsumed_percent * F.col("f"))) \
        .join(first, ["lang", "w1"]).join(last.withColumnRenamed("_w", "w2"), ["lang", "w2"]) \
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("fl").alias("r"),
                F.expr(score_of("f", "f1", "fl")).alias("score"))
    head = pairs.select("lang", "w1", "w2", F.col("f").alias("f12"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23"))
    three = triples.drop("best").join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"]) \
        .join(first, ["lang", "w1"]).join(last.withColumnRenamed("_w", "w3"), ["lang", "w3"]) \
        .withColumn("_s1", F.expr(score_of("f", "f1", "f23"))).withColumn("_s2", F.expr(score_of("f", "f12", "fl"))) \
        .withColumn("_one", F.col("_s1") <= F.col("_s2")) \
        .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
                F.expr("if(_one, f1, f12)").alias("l"), F.expr("if(_one, f23, fl)").alias("r"), F.least("_s1", "_s2").alias("score"))
    # each shard keeps its best, so a language's last ranking sees shards x top rows at most
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shard = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranked = two.unionByName(three).withColumn("_shard", shard) \
        .withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_shard").orderBy(*best))).filter(F.col("_rank") <= top) \
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
