"""Generic relational building blocks (filters, joins, aggregates, windows,
top-k, set operations).  Every function is lazy and keyed by column names."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regula.functions.columns import c, equal_width_bin, is_true
from regula.session import cut_lineage


# ---------------------------------------------------------------- filters (F)

def optional_filters(df: DataFrame, *, equals: dict | None = None,
                     between: dict | None = None, any_value: str = "all") -> DataFrame:
    """Dashboard-style optional predicates: a value equal to ``any_value`` (or
    None) disables that filter.  All predicates are AND-ed into one ``filter``
    so Catalyst can push them to the scan (F7)."""
    preds: list[Column] = []
    for col, v in (equals or {}).items():
        if v is not None and v != any_value:
            preds.append(F.col(col) == F.lit(v))
    for col, rng in (between or {}).items():
        if rng is not None:
            lo, hi = rng
            preds.append(F.col(col).between(lo, hi))
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def semi_join(df: DataFrame, keys_df: DataFrame, on, how: str = "left_semi") -> DataFrame:
    """Membership in another table's keys (``isin(other.unique())``): F4/J5."""
    return df.join(keys_df, on, how)


def anti_join(df: DataFrame, keys_df: DataFrame, on) -> DataFrame:
    return df.join(keys_df, on, "left_anti")


# ----------------------------------------------------------- aggregates (A)

def value_counts(df: DataFrame, col: str, *, k: int | None = None,
                 count_name: str = "count", pct_name: str | None = "pct") -> DataFrame:
    """``value_counts`` (A1): null keys dropped (N3) but counted in the
    denominator (percent of all rows).  The total is a one-row aggregate of
    the grouped frame, broadcast to the groups."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
    out = g
    if pct_name:
        tot = g.agg(F.sum(count_name).alias("_total"))
        out = (g.crossJoin(F.broadcast(tot))
                .withColumn(pct_name, F.col(count_name) / F.col("_total") * 100)
                .drop("_total"))
    out = out.filter(F.col(col).isNotNull())
    if k is not None:
        out = out.orderBy(F.col(count_name).desc(), F.col(col).asc()).limit(k)
    return out


def count_per_group(df: DataFrame, key: str | list[str], name: str = "n") -> DataFrame:
    """``groupby(key).size()`` (A2) with null keys dropped."""
    keys = [key] if isinstance(key, str) else list(key)
    pred = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(pred).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distribution_stats(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """n, mean, std (sample), min, max, median of a numeric column."""
    x = F.col(col)
    one = df.agg(F.count(x).alias(prefix + "n"), F.avg(x).alias(prefix + "mean"),
                 F.stddev_samp(x).alias(prefix + "std"), F.min(x).alias(prefix + "min"),
                 F.max(x).alias(prefix + "max"))
    median = global_quantiles(df, col, [0.5]).select(F.get("_q", F.lit(0)).alias(prefix + "median"))
    return one.crossJoin(F.broadcast(median))


def group_size_stats(df: DataFrame, key: str) -> DataFrame:
    """Mean / median / std / min / max of rows per key (two-level agg)."""
    return distribution_stats(count_per_group(df, key, "_size"), "_size")


def count_groups_above(df: DataFrame, key: str, thresholds) -> DataFrame:
    """Number of groups whose size exceeds each threshold."""
    g = count_per_group(df, key, "_size")
    return g.agg(F.count(F.lit(1)).alias("n_groups"),
                 *[F.count_if(F.col("_size") > t).alias(f"groups_over_{t}") for t in thresholds])


def histogram(df: DataFrame, col: str, nbins: int, *, lo=None, hi=None) -> DataFrame:
    """Equal-width histogram (B31): numpy semantics (N14), empty bins kept
    through a bin spine.  min/max come from one aggregate unless given."""
    x = F.col(col)
    vals = df.select(x.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if lo is None or hi is None:
        rng = vals.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    else:
        rng = df.sparkSession.range(1).select(F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
    binned = (vals.crossJoin(F.broadcast(rng))
                  .filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                  .withColumn("bin", equal_width_bin("_v", "_lo", "_hi", nbins))
                  .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    spine = (rng.select(F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"),
                        "_lo", "_hi"))
    width = (F.when(F.col("_lo") == F.col("_hi"), F.lit(1.0))
              .otherwise((F.col("_hi") - F.col("_lo")) / nbins))
    start = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    return (spine.join(binned, "bin", "left")
                 .select("bin",
                         (start + F.col("bin") * width).alias("bin_start"),
                         (start + (F.col("bin") + 1) * width).alias("bin_end"),
                         F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def size_histogram(df: DataFrame, key: str, max_size: int, nbins: int) -> DataFrame:
    """Histogram of group sizes at or below ``max_size``."""
    g = count_per_group(df, key, "_size").filter(F.col("_size") <= max_size)
    return histogram(g, "_size", nbins)


def crosstab_counts(df: DataFrame, row: str, col: Column | str, col_name: str = "col") -> DataFrame:
    """Long-form contingency table (A15) with null row keys dropped."""
    return (df.select(F.col(row).alias("row"), c(col).alias(col_name))
              .filter(F.col("row").isNotNull() & F.col(col_name).isNotNull())
              .groupBy("row", col_name).agg(F.count(F.lit(1)).alias("observed")))


# --------------------------------------------------------------- windows (W)

def last_non_null_by(df: DataFrame, key: str, order_col: str, cols: list[str],
                     tie: list[str] = (), suffix: str = "") -> DataFrame:
    """``sort(order).groupby(key).last()`` (W8/N18): per column the value of
    the latest row where that column is non-null; a null ``order_col`` sorts
    last, ``tie`` columns break equal dates.  Written as ``max_by``
    aggregates, which combine map-side, so a hot key never lands whole in
    one task as a window partition would."""
    rank = F.struct(F.col(order_col).isNull().cast("int").alias("_undated"),
                    F.col(order_col).alias("_d"), *[F.col(t) for t in tie])
    aggs = [F.max_by(F.col(col), F.when(F.col(col).isNotNull(), rank)).alias(col + suffix)
            for col in cols]
    return df.groupBy(key).agg(*aggs)


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Sort + head (K2/K3): a distributed TakeOrderedAndProject."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: str | list[str], k: int, order: list[Column],
                    rank_name: str = "rank") -> DataFrame:
    """Top k rows per group (K5).  The ``row_number() <= k`` filter lets Spark
    insert a per-partition group limit before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w)).filter(F.col(rank_name) <= k)


def pivot_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Zero-filled pivot of counts (A16) with a fixed column list."""
    return (df.groupBy(row).pivot(col, values).count().na.fill(0))


def null_safe_not(cond: Column) -> Column:
    """``~mask`` where the mask's null counts as False."""
    return ~is_true(cond)


#: buckets of one level; two levels part a column a million times
LEVEL = 1024


def _number(df: DataFrame, col: str) -> Column:
    """A double that never falls where ``col`` rises: the value itself, or
    the first six bytes of a string."""
    kind = dict(df.dtypes)[col]
    if kind == "string":
        return F.conv(F.rpad(F.substring(F.hex(F.col(col).cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(col).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return F.col(col).cast("double")


def _cell(x: str, lo: str, hi: str) -> Column:
    """Which of ``LEVEL`` equal steps between lo and hi ``x`` lies in: a pure,
    non-decreasing function of the value."""
    share = F.try_divide(F.col(x) - F.col(lo), F.col(hi) - F.col(lo))
    return F.coalesce(F.least(F.floor(share * LEVEL), F.lit(LEVEL - 1)), F.lit(0)).cast("int")


def _running(keys: list[str], order: Column, total: Column) -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(total).over(w), F.lit(0))


def prefix_sums(df: DataFrame, order: str, cols: list[str], *, descending: bool = False, suffix: str = "_before") -> DataFrame:
    """Exclusive running sums of ``cols`` over rows sorted by ``order``, exact
    and without a single-task sort.  ``order`` values must be distinct and not
    null (apply to grouped / distinct frames).

    A row's bucket is a function of its value alone: one of ``LEVEL`` steps
    between the column's least and greatest value, and within it one of
    ``LEVEL`` steps between that bucket's least and greatest, so crowded
    buckets part once more.  Running totals of the buckets (at most ``LEVEL``
    rows a window) are joined back, and a window inside a bucket does the rest."""
    o = (lambda x: F.col(x).desc()) if descending else (lambda x: F.col(x).asc())
    rows = cut_lineage(df.withColumn("_x", _number(df, order)))
    span = rows.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    one = rows.crossJoin(F.broadcast(span)).withColumn("_b", _cell("_x", "_lo", "_hi")).drop("_lo", "_hi")
    first = one.groupBy("_b").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), *[F.sum(x).alias(f"_s_{x}") for x in cols])
    # at most LEVEL rows
    first = first.select("_b", "_lo", "_hi", *[_running([], o("_b"), F.col(f"_s_{x}")).alias(f"_o_{x}") for x in cols])
    two = one.join(F.broadcast(first), "_b").withColumn("_c", _cell("_x", "_lo", "_hi"))
    second = two.groupBy("_b", "_c").agg(*[F.sum(x).alias(f"_s_{x}") for x in cols], *[F.first(f"_o_{x}").alias(f"_o_{x}") for x in cols])
    second = second.select("_b", "_c", *[(F.col(f"_o_{x}") + _running(["_b"], o("_c"), F.col(f"_s_{x}"))).alias(f"_p_{x}") for x in cols])
    local = two.select("_b", "_c", *[F.col(f"`{n}`") for n in df.columns],
                       *[_running(["_b", "_c"], o(order), F.col(x)).alias(f"_l_{x}") for x in cols])
    out = local.join(second, ["_b", "_c"])
    return out.select(*df.columns, *[(F.col(f"_p_{x}") + F.col(f"_l_{x}")).alias(f"{x}{suffix}") for x in cols])


#: size of the sketches that propose where to cut, and the share of ranks either
#: side of a wanted one that a cut leaves room for (about twice the rank error)
KLL, ROOM = 4096, 0.003
#: distinct values that one task puts in order; cells with more are cut again
EXACT = 1 << 20
#: groups whose cuts, or values whose codes, are sent to all tasks: a join by a
#: column of few values would put all rows into as many tasks
FEW = 1 << 14


def few_broadcast(small: DataFrame) -> DataFrame:
    """``small``, a frame that is cheap to count, marked for broadcast unless it
    holds more than ``FEW`` rows."""
    return F.broadcast(small) if small.count() <= FEW else small


def _narrow(rows: DataFrame, targets: DataFrame, path: list[str], cell: str, ranks: list[float]) -> tuple[DataFrame, DataFrame]:
    """The values that stand in a cell with a wanted rank, and the ranks within
    their cells.

    A mergeable KLL sketch per group proposes the cuts between cells; how many
    values a cell holds is then counted exactly, so a poor sketch makes a cell
    larger but no answer wrong.  The cuts of few groups go to all tasks."""
    sketch = rows.groupBy(*path).agg(F.kll_sketch_agg_double("_v", F.lit(KLL)).alias("_s"))
    cuts = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(r) for r in ranks]))
    # sketches draw at random, so both passes have to read the same ones
    cuts = cut_lineage(sketch.select(*path, F.array_distinct(cuts).alias("_s")))
    small = F.broadcast if cuts.count() <= FEW else (lambda x: x)
    dealt = rows.join(small(cuts), path).withColumn(cell, F.size(F.filter("_s", lambda s: s < F.col("_v")))).drop("_s")
    sums = dealt.groupBy(*path, cell).agg(F.sum("_m").alias("_w"))
    sums = sums.withColumn("_before", _running(path, F.col(cell), F.col("_w")))
    hit = targets.join(sums, path).filter((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_w")))
    hit = hit.withColumn("_left", F.col("_left") - F.col("_before")).drop("_before", "_w")
    wanted = hit.select(*path, cell).distinct()
    kept = dealt.join(small(wanted), [*path, cell]).groupBy(*path, cell, "_v").agg(F.sum("_m").alias("_m"))
    return cut_lineage(kept), hit


def _around(probs: list[float]) -> list[float]:
    return sorted({min(1.0, max(0.0, p + side)) for p in probs for side in (-ROOM, ROOM)})


def _at_ranks(rows: DataFrame, targets: DataFrame, path: list[str]) -> DataFrame:
    """``targets`` (path, _left, ...) with the value _v at each rank of its
    cell; cells with too many distinct values (path, _v, _m) are cut again."""
    while (rows.groupBy(*path).count().agg(F.max("count")).first()[0] or 0) > EXACT:
        cell = f"_c{len(path)}"
        rows, targets = _narrow(rows, targets, path, cell, [i / 64 for i in range(65)])
        path = [*path, cell]
    values = rows.withColumn("_before", _running(path, F.col("_v"), F.col("_m")))
    return targets.join(values, path).filter((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_m")))


def grouped_quantiles(df: DataFrame, keys: list[str], col: str, probs: list[float], name: str = "_q") -> DataFrame:
    """Exact linear-interpolated quantiles (pandas / ``percentile`` semantics)
    of ``col`` per group as ``keys..., name: array<double>``; groups without a
    value have no row, null keys form a group.

    Sketches bracket each wanted rank (see ``_narrow``), and only the distinct
    values inside the brackets are put in order; where a bracket still holds
    more than ``EXACT`` of them, it is cut again."""
    rows = cut_lineage(df.select(F.struct(F.lit(0).alias("_z"), *[F.col(f"`{k}`") for k in keys]).alias("_k"),
                                 F.col(f"`{col}`").cast("double").alias("_v"), F.lit(1).cast("long").alias("_m"))
                       .filter(F.col("_v").isNotNull()))
    sizes = rows.groupBy("_k").agg(F.count("*").alias("_n"))
    asked = sizes.select("_k", F.posexplode(F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: p * (F.col("_n") - 1))).alias("_i", "_pos"))
    asked = asked.select("_k", "_i", "_pos", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_rank"))
    targets, path = asked.withColumn("_left", F.col("_rank")), ["_k"]
    rows, targets = _narrow(rows, targets, path, "_c", _around(probs))
    found = _at_ranks(rows, targets, [*path, "_c"])
    per = found.groupBy("_k", "_i", "_pos").agg(F.max(F.when(F.col("_rank") == F.floor("_pos"), F.col("_v"))).alias("_vl"),
                                                F.max(F.when(F.col("_rank") == F.ceil("_pos"), F.col("_v"))).alias("_vh"))
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    q = F.when(lo == hi, F.col("_vl")).otherwise((hi - F.col("_pos")) * F.col("_vl") + (F.col("_pos") - lo) * F.col("_vh"))
    out = per.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_i", q.alias("_qv")))).alias("_a"))
    return out.select(*[F.col(f"_k.`{k}`").alias(k) for k in keys], F.transform("_a", lambda s: s["_qv"]).alias(name))


def global_quantiles(df: DataFrame, col: str, probs: list[float], name: str = "_q", *, cut: bool = True) -> DataFrame:
    """``grouped_quantiles`` of a whole column: one row, null on no values.

    The cuts, the cells' counts and the values found are a few numbers per
    wanted quantile, so they pass through the driver and the column is read by
    three plain aggregations.  ``cut=False`` spares a copy of the column where
    ``df`` is cheap to read again."""
    rows = df.select(F.col(f"`{col}`").cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rows = cut_lineage(rows) if cut else rows
    ranks = F.array(*[F.lit(r) for r in _around(probs)])
    top = rows.agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", F.lit(KLL)).alias("s"))
    n, cuts = top.select("n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", ranks))).first()
    one = df.sparkSession.range(1, numPartitions=1)
    if not n:
        return one.select(F.lit(None).cast("array<double>").alias(name))
    cell = reduce(lambda x, y: x + y, [(F.col("_v") > F.lit(c)).cast("int") for c in sorted(set(cuts))])
    dealt = rows.withColumn("_c", cell)
    before, held = {}, 0
    sizes = {r["_c"]: r["count"] for r in dealt.groupBy("_c").count().collect()}
    for c in sorted(sizes):
        before[c], held = held, held + sizes[c]
    positions = [p * (n - 1) for p in probs]
    wanted = {}
    for rank in {f(p) for p in positions for f in (math.floor, math.ceil)}:
        c = max(c for c in before if before[c] <= rank)
        wanted[rank] = (c, rank - before[c])
    inside = dealt.filter(F.col("_c").isin(sorted({c for c, _ in wanted.values()}))).groupBy("_c", "_v").agg(F.count("*").alias("_m"))
    targets = df.sparkSession.createDataFrame([(rank, c, left) for rank, (c, left) in wanted.items()], "_rank long, _c int, _left long")
    if max(sizes[c] for c, _ in wanted.values()) > EXACT:
        found = _at_ranks(cut_lineage(inside), targets, ["_c"])
    else:
        values = inside.withColumn("_before", _running(["_c"], F.col("_v"), F.col("_m")))
        hit = (F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_m"))
        found = values.join(F.broadcast(targets), "_c").filter(hit)
    at = {r["_rank"]: r["_v"] for r in found.select("_rank", "_v").collect()}

    def value(pos: float) -> float:
        lo, hi = math.floor(pos), math.ceil(pos)
        return at[lo] if lo == hi else (hi - pos) * at[lo] + (pos - lo) * at[hi]

    return one.select(F.array(*[F.lit(value(pos)) for pos in positions]).alias(name))
