"""Scalar helpers for cleaning, parsing and formatting.

All of them are compositions of built-in Spark expressions, so they stay
inside whole-stage codegen.  Parsing uses the ``try_`` forms: under ANSI mode
plain casts raise, while the cleaning jobs expect NULL for bad text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "col_of", "unquote_json", "split_point", "truncate", "parse_ddmmmyyyy", "datetime_merge",
    "case_null", "seconds_since", "seconds_to_ts", "format_date", "format_time",
    "parse_iso_date", "parse_iso_time", "to_finite_double", "pick_first", "lane_to_edge",
    "split_head", "split_tail", "link_id", "isclose", "eq_false_on_null", "acos_degrees",
    "POLYLINE_TYPE", "GEOJSON_LINE_TYPE", "parse_polyline", "polyline_to_json", "from_json_text",
]

POLYLINE_TYPE = T.ArrayType(T.ArrayType(T.DoubleType()))
GEOJSON_LINE_TYPE = T.StructType([
    T.StructField("coordinates", POLYLINE_TYPE),
    T.StructField("type", T.StringType()),
])


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unquote_json(c) -> Column:
    """Strip one pair of outer double quotes and un-double inner ones (CSV-quoted JSON)."""
    c = col_of(c)
    return F.regexp_replace(F.regexp_replace(c, r'^"|"$', ""), '""', '"')


def split_point(c, i: int) -> Column:
    """i-th (0-based) number of a ``"lat,lon"`` text; NULL when absent or not numeric."""
    return F.trim(F.get(F.split(col_of(c), ","), F.lit(i))).try_cast("double")


def truncate(c, n: int = 6, mode: str = "round") -> Column:
    """Keep ``n`` decimals, by rounding (HALF_UP) or by flooring toward -inf."""
    c = col_of(c).try_cast("double")
    if mode == "round":
        return F.round(c, n)
    if mode == "floor":
        scale = float(10 ** n)
        return F.floor(c * F.lit(scale)) / F.lit(scale)
    raise ValueError(f"unknown truncate mode {mode!r}")


def parse_ddmmmyyyy(c) -> Column:
    """``01JAN2025`` (any letter case) -> DATE; NULL for bad text."""
    c = col_of(c)
    txt = F.concat(F.substring(c, 1, 2), F.initcap(F.substring(c, 3, 3)), F.substring(c, 6, 4))
    return F.when(F.length(c) == 9, F.try_to_date(txt, "ddMMMyyyy"))


def datetime_merge(date_col, time_col, date_fmt: str = "yyyy-MM-dd", time_fmt: str = "H:mm:ss") -> Column:
    """Date (DATE or text) + time text -> TIMESTAMP; NULL when either is missing or bad."""
    d = col_of(date_col)
    txt = F.concat_ws(" ", F.date_format(d, date_fmt) if date_fmt == "yyyy-MM-dd" else d, col_of(time_col))
    return F.try_to_timestamp(txt, F.lit(f"{date_fmt} {time_fmt}"))


def case_null(c, value) -> Column:
    return F.nullif(col_of(c), F.lit(value))


def seconds_since(start, ts) -> Column:
    """Whole seconds from ``start`` to ``ts`` (truncated toward zero), as LONG."""
    micros = F.unix_micros(col_of(ts).cast("timestamp")) - F.unix_micros(col_of(start).cast("timestamp"))
    return (micros / F.lit(1_000_000)).cast("long")


def seconds_to_ts(base, seconds) -> Column:
    """``base`` + fractional seconds -> TIMESTAMP (micro precision); NULL if either is NULL."""
    return F.timestamp_micros(F.unix_micros(col_of(base).cast("timestamp"))
                              + F.round(col_of(seconds) * F.lit(1_000_000)).cast("long"))


def format_date(c) -> Column:
    return F.date_format(col_of(c), "yyyy-MM-dd")


def format_time(c) -> Column:
    return F.date_format(col_of(c), "HH:mm:ss")


def parse_iso_date(c) -> Column:
    return F.try_to_date(F.trim(col_of(c)), "yyyy-MM-dd")


def parse_iso_time(c) -> Column:
    """``HH:MM:SS`` else ``HH:MM`` -> seconds since midnight (INT); NULL for bad text."""
    t = F.trim(col_of(c))
    ts = F.coalesce(F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), t), F.lit("yyyy-MM-dd H:m:s")),
                    F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), t), F.lit("yyyy-MM-dd H:m")))
    return F.when(t.rlike(r"^\d{1,2}:\d{1,2}(:\d{1,2})?$"), F.unix_seconds(ts).cast("int"))


def to_finite_double(c) -> Column:
    """Trim, blank -> NULL, non-numeric -> NULL, NaN/inf -> NULL."""
    v = col_of(c).cast("string").try_cast("double")  # a cast trims, and blank text is no number
    return F.when(v * 0 == 0, v)


def pick_first(*cols) -> Column:
    """First non-NULL, non-empty value of the listed columns."""
    return F.coalesce(*[F.nullif(col_of(c), F.lit("")) for c in cols])


def lane_to_edge(c) -> Column:
    """Lane id ``edge_3`` -> ``edge`` (strip a trailing ``_<digits>``)."""
    return F.regexp_replace(col_of(c), r"^(.+)_\d+$", "$1")


def split_head(c, sep: str = "_") -> Column:
    """Text before the first ``sep`` (whole text when absent)."""
    return F.substring_index(col_of(c), sep, 1)


def split_tail(c, sep: str = "->") -> Column:
    """Text after the first ``sep``; NULL when absent."""
    c = col_of(c)
    pos = F.instr(c, sep)
    return F.when(pos > 0, c.substr(pos + F.lit(len(sep)), F.length(c)))


def link_id(a, b, sep: str = "_") -> Column:
    return F.concat_ws(sep, col_of(a).cast("string"), col_of(b).cast("string"))


def isclose(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """numpy-style ``|a-b| <= atol + rtol*|b|``; NULL/NaN -> false."""
    a, b = col_of(a), col_of(b)
    res = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.coalesce(res & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def eq_false_on_null(a, b) -> Column:
    return F.coalesce(col_of(a) == col_of(b), F.lit(False))


def acos_degrees(x) -> Column:
    """Clamp to [-1, 1], ``acos``, convert to degrees."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col_of(x)))))


def from_json_text(c, schema) -> Column:
    return F.from_json(col_of(c), schema)


def parse_polyline(c) -> Column:
    """JSON text that must be a list of lists of numbers -> array<array<double>>, else NULL."""
    arr = F.from_json(col_of(c), POLYLINE_TYPE)
    ok = arr.isNotNull() & F.forall(arr, lambda p: p.isNotNull() & (F.size(p) >= 2)
                                    & F.forall(p, lambda v: v.isNotNull()))
    return F.when(ok, arr)


def polyline_to_json(c) -> Column:
    return F.to_json(col_of(c))
