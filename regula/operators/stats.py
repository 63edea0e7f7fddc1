"""Statistical tests and concentration measures (Z-series).

Ranks, counts and sums are Spark aggregates; only the final tail
probability of a one-row statistic frame goes through a pandas UDF.
Global orderings are taken over *distinct values* (with their
multiplicities), never over raw rows, and the running sums over them are
computed in value buckets (``relational.prefix_sums``), so no single task
sorts the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regula.functions.distributions import chi2_p, normal_sf, t_test_p
from regula.operators.relational import prefix_sums
from regula.session import cut_lineage


def pearson_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r of ``y`` on ``x`` with n and the t statistic (Z1; null at r = 1)."""
    r = F.corr(F.col(x).cast("double"), F.col(y).cast("double"))
    out = df.agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
                 r.alias("r"))
    return out.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def with_trend_test(stat: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds the two-sided p-value and a trend label to ``pearson_trend``."""
    p = t_test_p(F.col("t"), F.col("n") - 2)
    out = stat.withColumn("p_value", F.when(F.abs(F.col("r")) >= 1, F.lit(0.0)).otherwise(p))
    return out.withColumn(
        "trend",
        F.when(F.col("p_value") < alpha,
               F.when(F.col("r") > 0, "increasing").otherwise("decreasing"))
         .otherwise("none"))


def chi_square_independence(observed: DataFrame, row: str = "row", col: str = "col",
                            count: str = "observed", yates: bool = True) -> DataFrame:
    """Chi-square test of independence over a long contingency table.

    Only observed cells meet their margins: an empty cell adds its expected
    count, and all expected counts sum to n.  With one degree of freedom Yates'
    correction is applied (the SciPy default); there the deviation is the same
    in all four cells, and the inverse expected counts factor into margins."""
    rows = observed.groupBy(row).agg(F.sum(count).alias("_rt"))
    cols = observed.groupBy(col).agg(F.sum(count).alias("_ct"))
    r = rows.agg(F.sum("_rt").alias("_n"), F.count(F.lit(1)).alias("_r"), F.sum(F.try_divide(F.lit(1.0), "_rt")).alias("_ir"))
    k = cols.agg(F.count(F.lit(1)).alias("_c"), F.sum(F.try_divide(F.lit(1.0), "_ct")).alias("_ic"))
    cells = observed.join(rows, row).join(cols, col).crossJoin(F.broadcast(r.select("_n")))
    cells = cells.select(F.col(count).cast("double").alias("_o"), (F.col("_rt") * F.col("_ct") / F.col("_n")).alias("_e"))
    sums = cells.agg(F.sum(F.try_divide(F.pow(F.col("_o") - F.col("_e"), F.lit(2)), F.col("_e"))).alias("_dev"),
                     F.sum("_e").alias("_se"), F.max(F.abs(F.col("_o") - F.col("_e"))).alias("_d"))
    one = sums.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(k))
    dof = (F.col("_r") - 1) * (F.col("_c") - 1)
    corrected = F.col("_d") - F.least(F.lit(0.5), F.col("_d"))
    plain = F.col("_dev") + F.greatest(F.col("_n") - F.col("_se"), F.lit(0.0))
    chi2 = F.when(F.lit(yates) & (dof == 1), corrected * corrected * F.col("_n") * F.col("_ir") * F.col("_ic")).otherwise(plain)
    return one.select(chi2.alias("chi2"), dof.cast("long").alias("dof"), F.col("_n").cast("long").alias("n")).filter(F.col("n").isNotNull())


def with_chi_square_p(stat: DataFrame, alpha: float = 0.05) -> DataFrame:
    out = stat.withColumn("p_value", chi2_p(F.col("chi2"), F.col("dof")))
    return out.withColumn("significant", F.col("p_value") < alpha)


def mann_whitney_u(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """Mann-Whitney U of sample ``first`` vs ``second`` (Z3), asymptotic form
    with average ranks, tie correction and continuity correction; the
    alternative is "first is stochastically less".

    Ranks are computed over the distinct values with their per-sample
    multiplicities, so the only global ordering is over distinct values."""
    g = F.col(group)
    counts = (df.filter(g.isin(first, second) & F.col(value).isNotNull())
                .groupBy(value)
                .agg(F.count_if(g == first).alias("_c1"), F.count_if(g == second).alias("_c2")))
    ranked = prefix_sums(counts.withColumn("_t", F.col("_c1") + F.col("_c2")), value, ["_t"])
    ranked = ranked.withColumn("_avg_rank", F.col("_t_before") + (F.col("_t") + 1) / 2.0)
    agg = ranked.agg(F.sum(F.col("_c1") * F.col("_avg_rank")).alias("_r1"),
                     F.sum("_c1").alias("n1"), F.sum("_c2").alias("n2"),
                     F.sum(F.col("_t").cast("double") ** 3 - F.col("_t")).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    out = agg.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                     u1.alias("u_statistic"), sigma.alias("_sigma"))
    u2 = n1 * n2 - F.col("u_statistic")
    return (out.withColumn("z", F.try_divide(u2 - n1 * n2 / 2 - 0.5, F.col("_sigma")))
               .drop("_sigma"))


def with_mann_whitney_p(stat: DataFrame, alpha: float = 0.05) -> DataFrame:
    p = F.least(F.greatest(normal_sf(F.col("z")), F.lit(0.0)), F.lit(1.0))
    return stat.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def _value_blocks(counts: DataFrame, value: str) -> DataFrame:
    """Distinct values of ``value`` with their multiplicity ``m``."""
    return counts.groupBy(value).agg(F.count(F.lit(1)).alias("_m"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """Standard Gini coefficient of non-negative ``value`` over rows (Z4):
    G = (n + 1 - 2 * sum_i cum_share_i) / n with rows sorted ascending.

    Equal values are interchangeable, so the sum is evaluated per block of
    equal values: a block of m values v starting after p smaller rows adds
    v * (m * (n + 1) - m * p - m * (m + 1) / 2) / T."""
    blocks = _value_blocks(df.filter(F.col(value).isNotNull()), value)
    b = prefix_sums(blocks, value, ["_m"]).withColumnRenamed("_m_before", "_p")
    tot = blocks.agg(F.sum("_m").alias("_n"), F.sum(F.col(value) * F.col("_m")).alias("_T"))
    m, p, n = F.col("_m").cast("double"), F.col("_p").cast("double"), F.col("_n").cast("double")
    contrib = F.col(value) * (m * (n + 1) - m * p - m * (m + 1) / 2)
    s = b.crossJoin(F.broadcast(tot)).agg(F.first("_n").alias("_n"), F.first("_T").alias("_T"),
                                          F.sum(contrib).alias("_S"))
    # null where nothing is held
    g = F.try_divide(F.col("_n") + 1 - F.try_divide(2 * F.col("_S"), F.col("_T")), F.col("_n"))
    return s.select(F.col("_n").cast("long").alias("n"), g.alias("gini")).withColumn(
        "concentration",
        F.when(F.col("gini") > 0.6, "High").when(F.col("gini") > 0.3, "Moderate").otherwise("Low"))


def lorenz_points(df: DataFrame, value: str) -> DataFrame:
    """Cumulative shares (W5): per distinct value, ascending, the rows that
    hold it and the shares (%) of rows and of the total up to and with it."""
    # read by the running sums and by the totals
    blocks = cut_lineage(_value_blocks(df.filter(F.col(value).isNotNull()), value).withColumn("_held", F.col(value) * F.col("_m")))
    run = prefix_sums(blocks, value, ["_m", "_held"])
    tot = blocks.agg(F.sum("_m").alias("_n"), F.sum("_held").alias("_T"))
    return run.crossJoin(F.broadcast(tot)).select(
        F.col(value).alias("value"), F.col("_m").alias("n"),
        (F.try_divide(F.col("_m_before") + F.col("_m"), F.col("_n")) * 100).alias("rows_share_pct"),
        (F.try_divide(F.col("_held_before") + F.col("_held"), F.col("_T")) * 100).alias("total_share_pct"))


def top_share(df: DataFrame, value: str, frac: float = 0.1) -> DataFrame:
    """Share (%) of the total held by the ``int(n * frac)`` largest rows (Z5),
    evaluated over distinct-value blocks taken from the top."""
    blocks = _value_blocks(df.filter(F.col(value).isNotNull()), value)
    b = prefix_sums(blocks, value, ["_m"], descending=True).withColumnRenamed("_m_before", "_above")
    tot = blocks.agg(F.sum("_m").alias("_n"), F.sum(F.col(value) * F.col("_m")).alias("_T"))
    k = F.floor(F.col("_n") * frac)
    take = F.least(F.greatest(k - F.col("_above"), F.lit(0)), F.col("_m"))
    s = b.crossJoin(F.broadcast(tot)).agg(F.first("_n").alias("n"), F.first("_T").alias("total"),
                                          F.first(k).cast("long").alias("k"),
                                          F.sum(F.col(value) * take).alias("top_total"))
    return s.select(F.col("n").cast("long").alias("n"), "k",
                    F.col("top_total").cast("double").alias("top_total"),
                    (F.try_divide(F.col("top_total"), F.col("total")) * 100).alias("top_share_pct"))


def skewness_flag(df: DataFrame, cols: list[str], threshold: float = 1.0) -> DataFrame:
    """Bias-corrected skewness per column and ``abs(skew) > threshold`` (Z6),
    one aggregation pass for all columns, then unpivoted."""
    from regula.functions.columns import skew_bias_corrected
    one = df.agg(*[skew_bias_corrected(F.col(x).cast("double")).alias(x) for x in cols])
    long = one.unpivot([], cols, "column_name", "skewness")
    return long.withColumn("is_skewed", F.coalesce(F.abs(F.col("skewness")) > threshold, F.lit(False)))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations (Z7) in one aggregate."""
    exprs = []
    names = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            nm = f"{a}__{b}"
            names.append((a, b, nm))
            exprs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(nm))
    one = df.agg(*exprs)
    pairs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(nm).alias("corr"))
             for a, b, nm in names]
    sym = [F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(nm).alias("corr"))
           for a, b, nm in names if a != b]
    return one.select(F.explode(F.array(*pairs, *sym)).alias("p")).select("p.*")


def linear_slope(df: DataFrame, y: str, order: str) -> DataFrame:
    """Least-squares slope of ``y`` on its row position."""
    idx = F.row_number().over(Window.orderBy(order)) - 1
    return (df.select(F.col(y).cast("double").alias("_y"), idx.alias("_i"))
              .agg(F.regr_slope("_y", "_i").alias("slope"),
                   F.regr_intercept("_y", "_i").alias("intercept")))


def year_coverage(df: DataFrame, date_col: str) -> DataFrame:
    """First / last year, most active year (smallest of ties) and its count."""
    y = F.year(F.col(date_col))
    yrs = df.select(y.alias("year")).filter(F.col("year").isNotNull())
    per = yrs.groupBy("year").agg(F.count(F.lit(1)).alias("_n"))
    best = per.agg(F.max_by(F.col("year"), F.struct(F.col("_n"), -F.col("year"))).alias("mode_year"),
                   F.max("_n").alias("mode_count"), F.min("year").alias("first_year"),
                   F.max("year").alias("last_year"))
    return best.select("first_year", "last_year", "mode_year", "mode_count")


