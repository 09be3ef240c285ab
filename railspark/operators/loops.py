"""What iterative operators share: a loop's tables are written once and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from railspark.session import discard, ensure_checkpoint_dir, shuffles_dropped


#: A table of at most so many rows is sent to the tasks of a join whole.
SMALL_ROWS = 1 << 20


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/loop-{uuid.uuid4().hex}"


def small(df: DataFrame) -> DataFrame:
    """``df``, a table that was written, to be joined with a large one: broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


class Buckets:
    """Rows of a loop in a Parquet table bucketed by ``key``: grouping by the key, and more, needs no shuffle.

    ``key`` None: a plain table.  Rounds append; ``release`` deletes the table's files, ``settle``
    keeps them and gives them as a plain table.
    """

    def __init__(self, spark: SparkSession, key: str | None, n: int):
        self.spark, self.key, self.n = spark, key, n
        self.path = _folder(spark)
        self.name = f"loop_{self.path.rsplit('-', 1)[1]}"
        self.schema, self.count = None, 0

    def append(self, df: DataFrame, which: Column) -> int:
        """Adds the rows of ``df`` and tells for how many ``which`` holds."""
        self.schema, seen = self.schema or df.schema, Observation()
        df = df.observe(seen, F.count_if(which).alias("n"), F.count(F.lit(1)).alias("all"))
        with shuffles_dropped(self.spark):
            if self.key is None:
                df.write.mode("append").parquet(self.path)
            else:
                df.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.n, self.key).saveAsTable(self.name)
        self.count += seen.get["all"]
        return seen.get["n"]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.key is None else self.spark.table(self.name)

    def settle(self) -> DataFrame:
        if self.key is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # its files stay
        return self.spark.read.schema(self.schema).parquet(self.path)

    def release(self) -> None:
        self.settle()
        discard(self.spark, self.path)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the session's checkpoint directory, read back.

    Cuts the lineage like ``checkpoint()``, computes the plan once and, unlike it, forgets the
    planner's size estimates: those of a table joined with itself are squared every round, until
    planning takes longer than the work.  What is read back has its true size.  Partition counts
    stay bounded: a union of a table with itself has twice its partitions, ``coalesce`` merges
    them without a shuffle.
    """
    spark = df.sparkSession
    path = _folder(spark)
    with shuffles_dropped(spark):
        df.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_input(df: DataFrame) -> DataFrame:
    """An input of a loop, written once with its own partitions, so rounds do not recompute it."""
    spark = df.sparkSession
    path = _folder(spark)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chain_from(heads: DataFrame, jump: DataFrame) -> DataFrame:
    """``(_g)`` of every row on a chain of successors ``jump(_g, _to)`` from ``heads(_g)``, each once.

    Tables of 1, 2, 4, ... steps, without the rows whose chain has ended; from the longest down,
    what is marked marks what lies that many steps on, so L steps take about 2 log2 L joins.
    """
    jumps, jump = [], materialise(jump.select("_g", "_to"))
    while not jump.isEmpty():
        jumps.append(jump)
        jump = materialise(jump.join(jump.select(F.col("_g").alias("_to"), F.col("_to").alias("_far")), "_to").select("_g", F.col("_far").alias("_to")))
    kept = materialise(heads.select("_g"))
    for jump in reversed(jumps):
        kept = materialise(kept.unionByName(kept.join(jump, "_g").select(F.col("_to").alias("_g"))))
    return kept
