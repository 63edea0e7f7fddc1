"""Column-level helpers: scalar functions and the pandas-parity rules.

All are plain functions returning ``Column`` expressions built from
``pyspark.sql.functions`` so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "NA_TOKENS", "c", "null_tokens_to_null", "is_true", "flag", "rate_of",
    "count_of", "first_number", "truncate_label", "days_in_month",
    "clip_upper", "ratio", "skew_bias_corrected", "yes_no", "month_start",
    "right_closed_bin", "equal_width_bin", "has_letter", "non_ascii",
    "round_half_even", "avg_rank", "quantile",
]

# The tokens pandas.read_csv treats as missing by default
# (pandas documentation, ``na_values``).  Spark's CSV reader only knows one
# null token, so string columns are mapped through this list after reading.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_tokens_to_null(col: str | Column) -> Column:
    """pandas ``na_values`` parity (N1): listed tokens become null."""
    x = c(col)
    return F.when(x.isin(NA_TOKENS), F.lit(None)).otherwise(x)


def is_true(cond: Column) -> Column:
    """Null-safe predicate: null counts as false (pandas mask semantics)."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """Boolean to 0/1 int, null -> 0."""
    return is_true(cond).cast("int")


def rate_of(col: str | Column, value) -> Column:
    """``(x == value).mean()``: nulls count as misses, denominator all rows."""
    return F.avg(F.when(c(col) == F.lit(value), 1).otherwise(0))


def count_of(col: str | Column, values) -> Column:
    """``x.isin(values).sum()`` / ``(x == v).sum()`` as an aggregate."""
    vals = values if isinstance(values, (list, tuple, set)) else [values]
    return F.count_if(is_true(c(col).isin(list(vals))))


def first_number(col: str | Column) -> Column:
    """First number in text ``(\\d+\\.?\\d*)`` as double; null when none."""
    s = F.regexp_extract(c(col), r"(\d+\.?\d*)", 1)
    return F.nullif(s, F.lit("")).try_cast("double")


def truncate_label(col: str | Column, n: int = 20) -> Column:
    x = c(col)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def days_in_month(col: str | Column) -> Column:
    return F.dayofmonth(F.last_day(c(col)))


def clip_upper(col: str | Column, upper) -> Column:
    """``clip(upper=u)`` keeping null (N15); ``least`` would turn null into u."""
    x = c(col)
    return F.when(x > F.lit(upper), F.lit(upper)).otherwise(x)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that yields null instead of raising on a zero denominator."""
    return F.try_divide(c(num), c(den))


def skew_bias_corrected(col: str | Column) -> Column:
    """pandas ``skew()`` (adjusted Fisher-Pearson), an aggregate."""
    x = c(col)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def yes_no(col: str | Column) -> Column:
    x = c(col)
    return F.when(x == 1, "Yes").when(x == 0, "No")


def month_start(col: str | Column) -> Column:
    return F.trunc(F.to_date(c(col)), "MM")


def round_half_even(col: str | Column, digits: int = 1) -> Column:
    """pandas/numpy ``round`` is half-to-even."""
    return F.bround(c(col), digits)


def right_closed_bin(x: str | Column, edges: Column) -> Column:
    """pandas ``cut``/``qcut`` bin id: bins ``(e[i], e[i+1]]``, lowest edge
    included (N13).  ``edges`` is an ascending array column.  Null outside."""
    v = c(x)
    n = F.size(edges)
    below = F.size(F.filter(edges, lambda e: e < v))
    return (F.when(v.isNull() | (v < F.element_at(edges, 1)) | (v > F.element_at(edges, -1)), F.lit(None))
             .when(v == F.element_at(edges, 1), F.lit(0))
             .otherwise(F.least(below - 1, n - 2)))


def equal_width_bin(x: str | Column, lo: str | Column, hi: str | Column, nbins: int) -> Column:
    """``numpy.histogram`` bin id: left-closed bins, the last one closed.
    A constant column uses numpy's range ``(lo-0.5, hi+0.5)``."""
    v, a, b = c(x), c(lo), c(hi)
    a2 = F.when(a == b, a - 0.5).otherwise(a)
    b2 = F.when(a == b, b + 0.5).otherwise(b)
    raw = F.floor((v - a2) / (b2 - a2) * nbins).cast("int")
    return F.when(v.isNull(), None).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(nbins - 1)))


def has_letter(col: str | Column) -> Column:
    return c(col).rlike("[A-Za-z]")


def non_ascii(col: str | Column) -> Column:
    return is_true(c(col).rlike("[^\\x00-\\x7F]"))


def avg_rank(rank_col: Column, ties_col: Column) -> Column:
    """Average rank of tied values given the competition rank and tie count."""
    return rank_col + (ties_col - 1) / 2.0


def quantile(col: str | Column, p, exact: bool = True, accuracy: int = 10000) -> Column:
    """Linear-interpolated exact percentile (N8) or, with ``exact=False``,
    Spark's bounded-memory ``percentile_approx`` for very large groups."""
    x = c(col)
    return F.percentile(x, p) if exact else F.percentile_approx(x, p, accuracy).cast(
        "array<double>" if isinstance(p, (list, tuple)) else "double")
