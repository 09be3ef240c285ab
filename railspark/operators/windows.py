"""Window operators: next/previous stop, per-group heads, dense ids, ranks, running sums.

Scale notes
-----------
* ``lead_lag`` can split a hot group: with ``bucket`` (a coarse column that is
  non-decreasing along the order, e.g. the hour of the planned departure) the
  window runs per ``(key, bucket)`` and only the last/first row of each bucket
  is fixed up through a small per-bucket table.  One key holding a third of the
  rows is then spread over as many tasks as it has buckets.  Only keys that can
  be hot are split: rows are counted per slot of the key's hash, and the keys of
  slots with few rows take the plain window, which shuffles each row once.
* ``dense_id_first_seen`` numbers keys in order of first appearance without a
  global one-task window: range partitioning, per-partition counts (one row per
  partition), and a prefix offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspark.functions.scalar import col_of
from railspark.session import ensure_checkpoint_dir


def _cols(cs) -> list[Column]:
    if cs is None:
        return []
    if isinstance(cs, (str, Column)):
        cs = [cs]
    return [col_of(c) for c in cs]


#: Key hashes are counted in so many slots (a proven size bound), and a slot with more rows than this is split at the buckets.
HOT_SLOTS, HOT_ROWS = 1 << 16, 1 << 18


def lead_lag(df: DataFrame, key, order, value, out: str, offset: int = 1,
             bucket: Column | str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``lead`` (offset > 0) or ``lag`` (offset < 0) of ``value`` inside ``key`` ordered by ``order``.

    ``order`` must be a total order inside a key (pass tie-break columns).
    With ``bucket`` only offsets of +-1 are supported; the result is identical
    to the plain window.  ``df`` is read four times then: a count per slot of the key's hash, the
    rows of the other slots, and those of hot slots with their per-bucket table.
    """
    return _lead_lags(df, _cols(key), _cols(order), col_of(value), {out: offset}, bucket, hot_rows)


def _lead_lags(df: DataFrame, keys: list[Column], orders: list[Column], v: Column, offsets: dict[str, int], bucket, hot_rows: int) -> DataFrame:
    """``lead_lag`` for several columns ``{out: offset}`` at once, from one window."""
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*orders)
        return df.withColumns({out: _shifted(v, n, w) for out, n in offsets.items()})
    if any(abs(n) != 1 for n in offsets.values()):
        raise ValueError("bucketed lead/lag supports offset +-1")
    slot = F.pmod(F.xxhash64(*keys), F.lit(HOT_SLOTS)).cast("int")
    hot = F.broadcast(df.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows).select("_slot"))
    slotted = df.withColumn("_slot", slot)
    cold, warm = (slotted.join(hot, "_slot", how).drop("_slot") for how in ("left_anti", "left_semi"))
    return _lead_lags(cold, keys, orders, v, offsets, None, hot_rows).unionByName(_bucketed_lead_lags(warm, keys, orders, v, offsets, bucket))


def _shifted(v: Column, offset: int, w) -> Column:
    return F.lead(v, offset).over(w) if offset > 0 else F.lag(v, -offset).over(w)


def _bucketed_lead_lags(df: DataFrame, keys: list[Column], orders: list[Column], v: Column, offsets: dict[str, int], bucket) -> DataFrame:
    key_names = [f"_k{i}" for i in range(len(keys))]
    ord_names = [f"_o{i}" for i in range(len(orders))]
    base = df.withColumns({**{n: c for n, c in zip(key_names, keys)},
                           **{n: c for n, c in zip(ord_names, orders)},
                           "_b": col_of(bucket), "_v": v})
    w = Window.partitionBy(*key_names, "_b").orderBy(*ord_names)
    # last (lead) / first (lag) row of its bucket: same window spec, no extra sort
    base = base.withColumns({f"_inner{i}": _shifted(F.col("_v"), n, w) for i, n in enumerate(offsets.values())}
                            | {f"_edge{i}": _shifted(F.lit(True), n, w).isNull() for i, n in enumerate(offsets.values())})
    ord_struct = F.struct(*[F.col(o) for o in ord_names])
    # one row per (key, bucket): its first and last value
    per_bucket = base.groupBy(*key_names, "_b").agg(
        F.min_by("_v", ord_struct).alias("_first"), F.max_by("_v", ord_struct).alias("_last"))
    wb = Window.partitionBy(*key_names).orderBy("_b")
    nb = per_bucket.select(*key_names, "_b", *[_shifted(F.col("_first" if n > 0 else "_last"), n, wb).alias(f"_fix{i}")
                                               for i, n in enumerate(offsets.values())])
    res = _null_safe_left(base, nb, [*key_names, "_b"]).withColumns(
        {out: F.when(F.col(f"_edge{i}"), F.col(f"_fix{i}")).otherwise(F.col(f"_inner{i}")) for i, out in enumerate(offsets)})
    return res.drop(*key_names, *ord_names, "_b", "_v", *[f"{c}{i}" for c in ("_inner", "_edge", "_fix") for i in range(len(offsets))])


def _null_safe_left(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Left join on ``names`` where NULL equals NULL, as in ``partitionBy`` and ``groupBy``."""
    r = right.withColumnsRenamed({n: f"{n}_r" for n in names})
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"{n}_r"))
    return left.join(r, cond, "left").drop(*[f"{n}_r" for n in names])


def next_stop(df: DataFrame, key, order, stop, out: str = "next_stop", bucket=None) -> DataFrame:
    """Next stop of the same train-day (card W1): computed before any filter."""
    return lead_lag(df, key, order, stop, out, 1, bucket)


def prev_stop(df: DataFrame, key, order, stop, out: str = "prev_stop", bucket=None) -> DataFrame:
    return lead_lag(df, key, order, stop, out, -1, bucket)


def next_and_prev_stop(df: DataFrame, key, order, stop, next_out: str = "next_stop", prev_out: str = "prev_stop",
                       bucket=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``next_stop`` and ``prev_stop`` from one window, so a row is shuffled once for both."""
    return _lead_lags(df, _cols(key), _cols(order), col_of(stop), {next_out: 1, prev_out: -1}, bucket, hot_rows)


def head_per_group(df: DataFrame, key, order, n: int) -> DataFrame:
    """First ``n`` rows of every group (``row_number() <= n``, a top-k feature)."""
    w = Window.partitionBy(*_cols(key)).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def number_rows(df: DataFrame, order, out: str, start: int = 0, partitions: int | None = None) -> DataFrame:
    """Consecutive numbers ``start, start+1, ...`` following a total ``order``.

    Two-level: range partitioning spreads the rows over all tasks; each row's
    number is the count of rows in earlier partitions (a table with one row per
    partition) plus its index inside its own sorted partition.
    """
    orders = _cols(order)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *orders).sortWithinPartitions(*orders)
    tagged = (ranged.withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)))
    # Range bounds come from sampling, whose input order follows shuffle fetch order; the
    # per-partition counts and the rows must see the same partitioning, so the tagged rows are
    # written once to the (shared) checkpoint directory and both uses read that copy.
    ensure_checkpoint_dir(df.sparkSession)
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    # offsets has one row per partition: a proven size bound
    res = tagged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
    return res.withColumn(out, (F.col("_off") + F.col("_local") + F.lit(start)).cast("long")) \
        .drop("_pid", "_mid", "_local", "_off")


def dense_id_first_seen(df: DataFrame, value, order, out: str = "id", start: int = 0) -> DataFrame:
    """Distinct ``value`` columns numbered ``start..`` in order of first appearance along ``order``.

    Returns one row per distinct value with columns ``value..., out``.
    """
    vals = [value] if isinstance(value, str) else list(value)
    orders = _cols(order)
    first = df.groupBy(*vals).agg(F.min(F.struct(*orders)).alias("_first"))
    return number_rows(first, [F.col("_first")] + [F.col(v) for v in vals], out, start).drop("_first")


def rank_neighbours(edges: DataFrame, node: str = "src", neighbour: str = "dst", out: str = "rank",
                    as_text: bool = False) -> DataFrame:
    """Rank (from 1) of each neighbour inside its node; ``as_text`` sorts ids as strings like the reference."""
    o = F.col(neighbour).cast("string") if as_text else F.col(neighbour)
    return edges.withColumn(out, F.row_number().over(Window.partitionBy(node).orderBy(o, F.col(neighbour))))


def running_sum(df: DataFrame, key, order, value, out: str, bucket=None) -> DataFrame:
    """Prefix sum of ``value`` along ``order`` inside ``key`` (rows frame, current row included).

    With ``bucket`` (non-decreasing along ``order``) the prefix runs per (key, bucket) and each
    bucket adds the total of the earlier buckets of its key from a per-bucket table, so a hot
    key is spread over as many tasks as it has buckets.
    """
    keys, orders = _cols(key), _cols(order)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*orders).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.sum(col_of(value)).over(w))
    key_names = [f"_k{i}" for i in range(len(keys))]
    base = df.withColumns({**{n: c for n, c in zip(key_names, keys)}, "_b": col_of(bucket), "_v": col_of(value)})
    w = Window.partitionBy(*key_names, "_b").orderBy(*orders).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = base.withColumn("_in", F.sum("_v").over(w))
    tot = base.groupBy(*key_names, "_b").agg(F.sum("_v").alias("_t"))
    wb = Window.partitionBy(*key_names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.sum("_t").over(wb)).select(*key_names, "_b", "_off")
    res = _null_safe_left(base, off, [*key_names, "_b"])
    # a sum without any value so far is NULL, as in the plain window
    return res.withColumn(out, F.coalesce(F.col("_off") + F.col("_in"), F.col("_in"), F.col("_off"))) \
        .drop(*key_names, "_b", "_v", "_in", "_off")
