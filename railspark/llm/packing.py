"""Best-fit packing of token pieces, planned on the histogram of lengths (operator 8).

The plan never sees documents: it packs *counts* of lengths (at most ``capacity`` of them) into
sequences, best fit in decreasing length, as runs "ranks f .. f+n-1 of length l go to sequences
s, s+1, ...".  Pieces then take their planned slot by joining on their rank within the length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import bpe
from .common import texts_of, written

#: Pieces of one length that one task ranks, about; a more frequent length is ranked in more shards.
SHARD = 1 << 16
#: Runs of the plan that are sent to every executor, at most (40 bytes each); a longer plan is joined by length.
RUNS_SENT = 200_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than ``capacity``."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def piece_table(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id",
                text: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every row's ids plus ``end_id``, cut into pieces.

    ``ranks``: see ``Bpe``.  Null text is empty and gives the end id alone; repeated rows each give their pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocabulary, ranks)
        end = np.array([end_id], "<u4")
        for b in batches:
            out = []
            for key, ids in zip(b.column(0).to_pylist(), model.encode_batch(texts_of(b))):
                ids = np.concatenate([ids, end])
                out += [(key, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")) \
        .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = 1024) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first_rank, n, first_sequence, per_sequence, offset): best fit over counts.

    Rank r of a run sits in sequence first_sequence + (r - first_rank) // per_sequence at
    offset + length * ((r - first_rank) % per_sequence).  Lengths go down; each takes the
    open sequences with the least sufficient room first.  Open sequences with equal room are
    kept as intervals, so work and output depend on the number of lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]
    runs, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, many: int, space: int) -> None:
            nonlocal left, rank
            each = min(space // length, left)
            full, rest = min(many, left // each), 0
            runs.append((length, rank, full * each, first, each, capacity - space))
            if (space_left := space - each * length) > 0:
                room[space_left].append((first, full))
            left, rank = left - full * each, rank + full * each
            if full < many and (rest := left and min(left, each)):
                runs.append((length, rank, rest, first + full, rest, capacity - space))
                if space > rest * length:
                    room[space - rest * length].append((first + full, 1))
                left, rank = left - rest, rank + rest
            if space < capacity and many > full + bool(rest):
                room[space].append((first + full + bool(rest), many - full - bool(rest)))

        for space in sorted(r for r in room if r >= length):
            groups = room.pop(space)
            while groups and left:
                first, many = groups.pop()
                fill(first, many, space)
            room[space] += groups
            if not room[space]:
                del room[space]
            if not left:
                break
        if left:
            need = -(-left // (capacity // length))
            first, sequences = sequences, sequences + need
            fill(first, need, capacity)
    return [r for r in runs if r[2]]


def place(pieces: DataFrame, capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """``pieces`` with sequence_id and offset: gapless sequences of at most ``capacity`` tokens.

    The driver sees only the histogram (one row per length, at most ``capacity``); the plan goes
    back as one row per run.  A length of n pieces is ranked in ceil(n / ``shard``) shards, whose
    first ranks come from a running sum over their counts; both meet in the ranks' own partitions.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["_n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).collect()}
    shards = spark.createDataFrame([(length, -(-n // shard)) for length, n in histogram.items()], "_length long, _shards long")
    # at most ``capacity`` pairs of numbers; an unhinted join would deal the pieces by length alone
    pieces = pieces.join(F.broadcast(shards), F.col("length") == F.col("_length")) \
        .withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_shards"))).drop("_length", "_shards")
    before = W.partitionBy("length").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n")) \
        .select(F.col("length").alias("_l"), F.col("_shard").alias("_sh"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    runs: dict[int, list[tuple]] = defaultdict(list)
    for run in plan(histogram, capacity):
        runs[run[0]].append(run[1:])
    slots = spark.createDataFrame([(n, sorted(r)) for n, r in runs.items()],
                                  "length long, _runs array<struct<r:long,n:long,s:long,each:long,at:long>>")
    order = W.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_place", F.row_number().over(order)) \
        .join(offsets, (F.col("length") == F.col("_l")) & (F.col("_shard") == F.col("_sh"))) \
        .withColumn("_rank", F.col("_before") + F.col("_place") - 1)
    # few runs of a length hold its ranks: the run is the last that starts at or before the rank
    runs_flat = slots.select("length", F.explode("_runs").alias("_run")) \
        .select("length", F.col("_run.r").alias("_r"), F.col("_run.n").alias("_cnt"), F.col("_run.s").alias("_s"),
                F.col("_run.each").alias("_each"), F.col("_run.at").alias("_at"))
    if sum(map(len, runs.values())) <= RUNS_SENT:
        runs_flat = F.broadcast(runs_flat)
    step = F.col("_rank") - F.col("_r")
    return ranked.join(runs_flat, (ranked["length"] == runs_flat["length"])
                       & (F.col("_rank") >= F.col("_r")) & (F.col("_rank") < F.col("_r") + F.col("_cnt"))) \
        .select(*[pieces[c] for c in ("doc_id", "piece", "start")], pieces["length"], pieces["ids_crc32"],
                (F.col("_s") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"),
                (F.col("_at") + pieces["length"] * (step % F.col("_each"))).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id",
         text: str = "text", ranks: str | None = None) -> DataFrame:
    """Packs all rows; one output row per piece.  An empty table gives an empty table; very long
    texts become many pieces; further columns are not read.

    Pieces are written once, so the histogram and the ranks see the same rows.  Rows that tie
    in id, piece and content may swap slots among themselves, which changes no sequence.
    """
    return place(written(piece_table(docs, vocabulary, capacity, end_id, doc_id, text, ranks)), capacity)
