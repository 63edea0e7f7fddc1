"""Registered statistical tests and concentration measures (Z-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from regula.operators import stats as Z
from regula.operators import timeseries as T
from regula.operators.relational import crosstab_counts
from regula.plans.registry import register
from regula.plans.roles import roles, with_roles
from regula.sources.parquet import read_table

YEARS_A = (1996, 2001)

_YEARLY_SQL = """
, s AS (SELECT CAST(year(SubmissionStatusDate) AS INTEGER) AS Year, * FROM submissions)
, ys AS (SELECT Year, round_even(CASE WHEN count_if(SubmissionStatus = 'AP') > 0 THEN count_if(SubmissionStatus = 'AP') END::DOUBLE
                / count(SubmissionStatus) * 100, 1) AS Approval_Rate
         FROM s WHERE Year BETWEEN 1996 AND 2001 GROUP BY Year)
"""


def _trend(spark, d):
    (subs,) = roles(spark, d, "submissions")
    ys = T.yearly_approval_stats(subs, first_year=YEARS_A[0], last_year=YEARS_A[1])
    return Z.pearson_trend(ys, "Year", "Approval_Rate")


@register("Z1_approval_trend_corr", sql=with_roles("submissions") + _YEARLY_SQL + """
, c AS (SELECT count(CASE WHEN Year IS NOT NULL AND Approval_Rate IS NOT NULL THEN 1 END) AS n,
               corr(Approval_Rate, Year) AS r FROM ys)
SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c
""")
def z1_corr(spark, d):
    return _trend(spark, d)


@register("Z1_approval_trend_test")
def z1_test(spark, d):
    return Z.with_trend_test(_trend(spark, d))


def _chi(spark, d):
    (subs,) = roles(spark, d, "submissions")
    approved = F.coalesce(F.col("SubmissionStatus") == "AP", F.lit(False))
    return Z.chi_square_independence(crosstab_counts(subs, "ReviewPriority", approved, "col"))


@register("Z2_chi_square_priority_vs_approval", sql=with_roles("submissions") + """
, o AS (SELECT ReviewPriority AS row, coalesce(SubmissionStatus = 'AP', false) AS col, count(*) AS obs
        FROM submissions WHERE ReviewPriority IS NOT NULL GROUP BY 1, 2)
, rt AS (SELECT row, sum(obs) AS rt FROM o GROUP BY row)
, ct AS (SELECT col, sum(obs) AS ct FROM o GROUP BY col)
, tot AS (SELECT sum(obs) AS n, count(DISTINCT row) AS r, count(DISTINCT col) AS c FROM o)
, cells AS (SELECT coalesce(o.obs, 0)::DOUBLE AS ob, rt.rt * ct.ct::DOUBLE / tot.n AS e, (tot.r - 1) * (tot.c - 1) AS dof, tot.n
            FROM rt CROSS JOIN ct CROSS JOIN tot LEFT JOIN o ON o.row = rt.row AND o.col = ct.col)
SELECT sum(CASE WHEN dof = 1 THEN power(abs(ob - e) - least(0.5, abs(ob - e)), 2) ELSE power(ob - e, 2) END / e) AS chi2,
       CAST(any_value(dof) AS BIGINT) AS dof, CAST(any_value(n) AS BIGINT) AS n
FROM cells
""")
def z2_chi(spark, d):
    return _chi(spark, d)


@register("Z2_chi_square_test")
def z2_test(spark, d):
    return Z.with_chi_square_p(_chi(spark, d))


def _mw(spark, d):
    (subs,) = roles(spark, d, "submissions")
    tl = T.approval_timelines(subs)
    tagged = (subs.filter((F.col("SubmissionStatus") == "AP") & F.col("ReviewPriority").isin("PRIORITY", "STANDARD"))
                  .select("ApplNo", F.col("ReviewPriority").alias("priority")).distinct())
    x = tl.select("ApplNo", "Days_to_Approval").join(tagged, "ApplNo", "inner")
    return Z.mann_whitney_u(x, "Days_to_Approval", "priority", "PRIORITY", "STANDARD")


@register("Z3_mann_whitney_priority_faster", sql=with_roles("submissions") + """
, tl AS (SELECT ApplNo, date_diff('day', min(SubmissionStatusDate), max(SubmissionStatusDate)) AS days
         FROM submissions WHERE SubmissionStatus = 'AP' AND SubmissionStatusDate IS NOT NULL GROUP BY ApplNo)
, tag AS (SELECT DISTINCT ApplNo, ReviewPriority AS g FROM submissions
          WHERE SubmissionStatus = 'AP' AND ReviewPriority IN ('PRIORITY', 'STANDARD'))
, x AS (SELECT tag.g, tl.days FROM tl JOIN tag ON tl.ApplNo = tag.ApplNo WHERE tl.days BETWEEN 0 AND 3650)
, rk AS (SELECT g, days, rank() OVER (ORDER BY days) AS r, count(*) OVER (PARTITION BY days) AS t FROM x)
, ag AS (SELECT sum(CASE WHEN g = 'PRIORITY' THEN r + (t - 1) / 2.0 END) AS r1,
                count(CASE WHEN g = 'PRIORITY' THEN 1 END)::DOUBLE AS n1,
                count(CASE WHEN g = 'STANDARD' THEN 1 END)::DOUBLE AS n2 FROM rk)
, ties AS (SELECT sum(power(t, 3) - t) AS tt FROM (SELECT count(*)::DOUBLE AS t FROM x GROUP BY days))
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, r1 - n1 * (n1 + 1) / 2 AS u_statistic,
       (n1 * n2 - (r1 - n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5)
       / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1)))) AS z
FROM ag, ties
""")
def z3_mw(spark, d):
    return _mw(spark, d)


@register("Z3_mann_whitney_test")
def z3_test(spark, d):
    return Z.with_mann_whitney_p(_mw(spark, d))


def _sponsor_counts(spark, d):
    (apps,) = roles(spark, d, "applications")
    return (apps.filter(F.col("SponsorName").isNotNull()).groupBy("SponsorName")
                .agg(F.count(F.lit(1)).alias("apps")))


_SPONSOR_SQL = """
, s AS (SELECT SponsorName, count(*) AS v FROM applications WHERE SponsorName IS NOT NULL GROUP BY 1)
"""


@register("Z4_gini_sponsor_concentration", sql=with_roles("applications") + _SPONSOR_SQL + """
, o AS (SELECT v, sum(v) OVER (ORDER BY v, SponsorName ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(v) OVER () AS cum,
               count(*) OVER () AS n FROM s)
, g AS (SELECT CAST(any_value(n) AS BIGINT) AS n, (any_value(n) + 1 - 2 * sum(cum)) / any_value(n) AS gini FROM o)
SELECT n, gini, CASE WHEN gini > 0.6 THEN 'High' WHEN gini > 0.3 THEN 'Moderate' ELSE 'Low' END AS concentration FROM g
""")
def z4_gini(spark, d):
    return Z.gini(_sponsor_counts(spark, d), "apps")


@register("W5_sponsor_cumulative_share", sql=with_roles("applications") + _SPONSOR_SQL + """
, b AS (SELECT v, count(*) AS n FROM s GROUP BY v)
SELECT v AS value, n, sum(n) OVER (ORDER BY v)::DOUBLE / sum(n) OVER () * 100 AS rows_share_pct,
       sum(n * v) OVER (ORDER BY v)::DOUBLE / sum(n * v) OVER () * 100 AS total_share_pct FROM b
""")
def w5_shares(spark, d):
    return Z.lorenz_points(_sponsor_counts(spark, d), "apps")


@register("Z5_top10pct_sponsor_share", sql=with_roles("applications") + _SPONSOR_SQL + """
, o AS (SELECT v, row_number() OVER (ORDER BY v DESC, SponsorName) AS i, count(*) OVER () AS n FROM s)
SELECT CAST(any_value(n) AS BIGINT) AS n, CAST(floor(any_value(n) * 0.1) AS BIGINT) AS k,
       CAST(sum(CASE WHEN i <= floor(n * 0.1) THEN v ELSE 0 END) AS DOUBLE) AS top_total,
       sum(CASE WHEN i <= floor(n * 0.1) THEN v ELSE 0 END)::DOUBLE / sum(v) * 100 AS top_share_pct
FROM o
""")
def z5_share(spark, d):
    return Z.top_share(_sponsor_counts(spark, d), "apps", 0.1)


@register("Z6_skewness_flags", sql="""
SELECT 'l_quantity' AS column_name, skewness(l_quantity) AS skewness, coalesce(abs(skewness(l_quantity)) > 1, false) AS is_skewed FROM lineitem
UNION ALL SELECT 'l_extendedprice', skewness(l_extendedprice), coalesce(abs(skewness(l_extendedprice)) > 1, false) FROM lineitem
UNION ALL SELECT 'l_discount', skewness(l_discount), coalesce(abs(skewness(l_discount)) > 1, false) FROM lineitem
UNION ALL SELECT 'l_tax', skewness(l_tax), coalesce(abs(skewness(l_tax)) > 1, false) FROM lineitem
""")
def z6_skew(spark, d):
    li = read_table(spark, d, "lineitem")
    return Z.skewness_flag(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("Z9_year_coverage", sql=with_roles("submissions") + """
, y AS (SELECT CAST(year(SubmissionStatusDate) AS INTEGER) AS year FROM submissions WHERE SubmissionStatusDate IS NOT NULL)
, c AS (SELECT year, count(*) AS n FROM y GROUP BY year)
SELECT (SELECT min(year) FROM y) AS first_year, (SELECT max(year) FROM y) AS last_year,
       (SELECT year FROM c ORDER BY n DESC, year LIMIT 1) AS mode_year, (SELECT max(n) FROM c) AS mode_count
""")
def z9_coverage(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return Z.year_coverage(subs, "SubmissionStatusDate")
