"""Projections, filters and predicates.

Every function builds one projection (``select``/``withColumns``) from the
schema instead of chained ``withColumn`` calls, so the plan stays flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railspark.functions.scalar import col_of


def cast_columns(df: DataFrame, types: dict) -> DataFrame:
    """Typed projection with ``try_cast``: bad text becomes NULL instead of failing under ANSI."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """Drop listed columns; names that are absent are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def select_order(df: DataFrame, cols, types: dict | None = None) -> DataFrame:
    """Final fixed column order; absent columns are added as typed NULLs."""
    types = types or {}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "string")).alias(c)
                       for c in cols])


def blank_to_null(df: DataFrame) -> DataFrame:
    """For every string column ``''`` -> NULL, in one projection built from the schema."""
    return df.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def time_range_filter(df: DataFrame, col: str, start, end) -> DataFrame:
    """``start <= col <= end`` (both inclusive); literals typed like the column so it pushes down."""
    t = df.schema[col].dataType
    return df.filter(F.col(col).between(F.lit(start).cast(t), F.lit(end).cast(t)))


def _member_flag(df: DataFrame, col: str, members, tag: str) -> tuple[DataFrame, Column]:
    if isinstance(members, (list, tuple, set)):
        return df, F.col(col).isin(list(members))
    m = members.select(F.col(members.columns[0]).alias(f"_m{tag}")).distinct().withColumn(f"_f{tag}", F.lit(True))
    j = df.join(m, F.col(col) == F.col(f"_m{tag}"), "left")
    return j, F.col(f"_f{tag}").isNotNull()


def member_filter(df: DataFrame, cols, members, mode: str = "any") -> DataFrame:
    """Keep rows where any / all of ``cols`` are in ``members`` (list literal or one-column DataFrame)."""
    out, flags = df, []
    for i, c in enumerate(cols):
        out, f = _member_flag(out, c, members, str(i))
        flags.append(f)
    cond = flags[0]
    for f in flags[1:]:
        cond = (cond | f) if mode == "any" else (cond & f)
    res = out.filter(cond)
    return res.drop(*[c for c in res.columns if c.startswith("_m") or c.startswith("_f")])


def link_filter(df: DataFrame, station: str, next_col: str, a, b) -> DataFrame:
    return df.filter((F.col(station) == F.lit(a)) & (F.col(next_col) == F.lit(b)))


def dropna_any(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows holding a NULL (or NaN in floating columns)."""
    cols = subset or df.columns
    cond = None
    for f in df.schema.fields:
        if f.name not in cols:
            continue
        c = F.col(f.name).isNotNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c & ~F.isnan(f.name)
        cond = c if cond is None else cond & c
    return df.filter(cond) if cond is not None else df


def null_inspect(df: DataFrame, cols, mode: str = "any") -> DataFrame:
    conds = [F.col(c).isNull() for c in cols]
    cond = conds[0]
    for c in conds[1:]:
        cond = (cond | c) if mode == "any" else (cond & c)
    return df.filter(cond)


def point_lookup(df: DataFrame, cols, value) -> DataFrame:
    """Rows whose key equals ``value`` in any of ``cols``."""
    cond = None
    for c in cols:
        e = F.col(c) == F.lit(value)
        cond = e if cond is None else cond | e
    return df.filter(cond)


def conditional_update(df: DataFrame, cond: Column, col: str, value) -> DataFrame:
    v = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(cond, v).otherwise(F.col(col)))


def apply_corrections(df: DataFrame, corrections: DataFrame, key, cols) -> DataFrame:
    """Many conditional updates at once: left join a corrections table, ``coalesce`` new over old."""
    keys = [key] if isinstance(key, str) else list(key)
    c = corrections.select(*keys, *[F.col(x).alias("_new_" + x) for x in cols])
    j = df.join(c, keys, "left")
    return j.withColumns({x: F.coalesce(F.col("_new_" + x), F.col(x)) for x in cols}) \
        .drop(*["_new_" + x for x in cols])
