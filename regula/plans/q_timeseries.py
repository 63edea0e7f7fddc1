"""Registered time-series queries (T-series, Z8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from regula.operators import timeseries as T
from regula.plans.registry import register
from regula.plans.roles import roles, with_roles
from regula.sources.parquet import read_table

# Reference year limits moved onto the data's span (1995-01 .. 2001-11).
MONTHS = ("1995-06-01", "2001-06-01")
YEARS_A = (1996, 2001)
YEARS_B = (1995, 2000)
YEARS_C = (1990, 2024)

_TIMELINES_SQL = """
, tl AS (SELECT ApplNo, CAST(min(SubmissionStatusDate) AS DATE) AS first_approved_date,
                CAST(max(SubmissionStatusDate) AS DATE) AS final_approval_date,
                count(SubmissionNo) AS Total_Submissions,
                date_diff('day', min(SubmissionStatusDate), max(SubmissionStatusDate)) AS Days_to_Approval
         FROM submissions WHERE SubmissionStatus = 'AP' AND SubmissionStatusDate IS NOT NULL
         GROUP BY ApplNo)
, t AS (SELECT * FROM tl WHERE Days_to_Approval BETWEEN 0 AND 3650)
"""

_MONTHLY_SQL = """
, b AS (SELECT CAST(date_trunc('month', SubmissionStatusDate) AS DATE) AS month, * FROM submissions
        WHERE SubmissionStatusDate IS NOT NULL)
, agg AS (SELECT month, count(SubmissionNo) AS TotalSubmissions, count_if(SubmissionStatus = 'AP') AS Approvals,
                 count_if(ReviewPriority = 'PRIORITY') AS PriorityReviews, count(DISTINCT ApplNo) AS UniqueApplications
          FROM b GROUP BY month)
, spine AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(month) FROM agg) AS TIMESTAMP),
                                               CAST((SELECT max(month) FROM agg) AS TIMESTAMP),
                                               INTERVAL 1 MONTH)) AS DATE) AS month)
, ms AS (SELECT s.month, coalesce(a.TotalSubmissions, 0) AS TotalSubmissions, coalesce(a.Approvals, 0) AS Approvals,
                coalesce(a.PriorityReviews, 0) AS PriorityReviews, coalesce(a.UniqueApplications, 0) AS UniqueApplications,
                coalesce(a.Approvals::DOUBLE / nullif(a.TotalSubmissions, 0), 0) AS ApprovalRate,
                coalesce(a.PriorityReviews::DOUBLE / nullif(a.TotalSubmissions, 0), 0) AS PriorityRate
         FROM spine s LEFT JOIN agg a ON s.month = a.month)
, m AS (SELECT * FROM ms WHERE month >= DATE '1995-06-01' AND month < DATE '2001-06-01')
"""


def _monthly(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.monthly_series(subs, start=MONTHS[0], end=MONTHS[1])


@register("T1_approval_timelines", sql=with_roles("submissions") + _TIMELINES_SQL + "SELECT * FROM t")
def t1_timelines(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.approval_timelines(subs)


@register("T1_approval_time_stats", sql=with_roles("submissions") + _TIMELINES_SQL + """
SELECT count(Days_to_Approval) AS n, avg(Days_to_Approval) AS mean, median(Days_to_Approval) AS median,
       stddev_samp(Days_to_Approval) AS std, quantile_cont(Days_to_Approval, 0.25) AS p25,
       quantile_cont(Days_to_Approval, 0.75) AS p75
FROM t
""")
def t1_stats(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.approval_time_stats(T.approval_timelines(subs))


@register("T1_approval_time_by_priority", sql=with_roles("submissions") + _TIMELINES_SQL + """
, tag AS (SELECT DISTINCT ApplNo, ReviewPriority AS priority FROM submissions
          WHERE SubmissionStatus = 'AP' AND ReviewPriority IN ('PRIORITY', 'STANDARD'))
SELECT tag.priority, count(t.Days_to_Approval) AS n, avg(t.Days_to_Approval) AS mean,
       median(t.Days_to_Approval) AS median
FROM t JOIN tag ON t.ApplNo = tag.ApplNo GROUP BY tag.priority
""")
def t1_by_priority(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.approval_time_by_priority(subs, T.approval_timelines(subs))


@register("T2_monthly_series", sql=with_roles("submissions") + _MONTHLY_SQL + "SELECT * FROM m")
def t2_monthly(spark, d):
    return _monthly(spark, d)


@register("X9_months_ahead", sql=with_roles("submissions") + _MONTHLY_SQL + """
, l AS (SELECT max(month) AS month FROM m)
SELECT CAST(i AS INTEGER) AS step, CAST(l.month + to_months(CAST(i AS INTEGER)) AS DATE) AS month FROM l, range(1, 13) r(i)""")
def x9_months(spark, d):
    return T.months_ahead(_monthly(spark, d))


@register("T2_daily_events_by_type", sql="""
WITH agg AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS value_sum
          FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
, b AS (SELECT event_type, min(day) AS lo, max(day) AS hi FROM agg GROUP BY 1)
, spine AS (SELECT event_type, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT s.event_type, s.day, coalesce(a.n, 0) AS n, coalesce(a.value_sum, 0.0) AS value_sum
FROM spine s LEFT JOIN agg a ON s.event_type = a.event_type AND s.day = a.day
""")
def t2_daily(spark, d):
    ev = read_table(spark, d, "events")
    return T.daily_series(ev, "ts", series="event_type", value="value")


@register("T3_series_features", sql=with_roles("submissions") + _MONTHLY_SQL + """
, f AS (SELECT m.*,
          lag(TotalSubmissions::DOUBLE, 1) OVER w AS lag_1, lag(TotalSubmissions::DOUBLE, 3) OVER w AS lag_3,
          lag(TotalSubmissions::DOUBLE, 6) OVER w AS lag_6, lag(TotalSubmissions::DOUBLE, 12) OVER w AS lag_12,
          CASE WHEN count(*) OVER w3 = 3 THEN avg(TotalSubmissions::DOUBLE) OVER w3 END AS rolling_mean_3,
          CASE WHEN count(*) OVER w3 = 3 THEN stddev_samp(TotalSubmissions::DOUBLE) OVER w3 END AS rolling_std_3,
          CASE WHEN count(*) OVER w6 = 6 THEN avg(TotalSubmissions::DOUBLE) OVER w6 END AS rolling_mean_6,
          CASE WHEN count(*) OVER w6 = 6 THEN stddev_samp(TotalSubmissions::DOUBLE) OVER w6 END AS rolling_std_6,
          CASE WHEN count(*) OVER w12 = 12 THEN avg(TotalSubmissions::DOUBLE) OVER w12 END AS rolling_mean_12,
          CASE WHEN count(*) OVER w12 = 12 THEN stddev_samp(TotalSubmissions::DOUBLE) OVER w12 END AS rolling_std_12,
          CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month_of_year,
          CAST(quarter(month) AS INTEGER) AS quarter, CAST(day(last_day(month)) AS INTEGER) AS days_in_month,
          CAST(row_number() OVER w - 1 AS INTEGER) AS time_index
        FROM m
        WINDOW w AS (ORDER BY month),
               w3 AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
               w6 AS (ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
               w12 AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT * FROM f WHERE lag_12 IS NOT NULL AND rolling_std_12 IS NOT NULL
""")
def t3_features(spark, d):
    return T.series_features(_monthly(spark, d))


@register("T5_seasonal_decompose", sql=with_roles("submissions") + _MONTHLY_SQL + """
, b2 AS (SELECT month, TotalSubmissions::DOUBLE AS observed,
           CASE WHEN count(*) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
             (sum(TotalSubmissions::DOUBLE) OVER (ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
              + 0.5 * (lag(TotalSubmissions::DOUBLE, 6) OVER (ORDER BY month)
                       + lead(TotalSubmissions::DOUBLE, 6) OVER (ORDER BY month))) / 12 END AS trend,
           CAST((row_number() OVER (ORDER BY month) - 1) % 12 AS INTEGER) AS position
         FROM m)
, pm AS (SELECT position, avg(observed - trend) AS pm FROM b2 GROUP BY position)
, se AS (SELECT position, pm - avg(pm) OVER () AS seasonal FROM pm)
SELECT b2.month, b2.observed, b2.trend, b2.position, se.seasonal, b2.observed - b2.trend - se.seasonal AS resid
FROM b2 LEFT JOIN se ON b2.position = se.position
""")
def t5_decompose(spark, d):
    return T.seasonal_decompose(_monthly(spark, d))


@register("T10_yearly_approval_stats", sql=with_roles("submissions") + """
, s AS (SELECT CAST(year(SubmissionStatusDate) AS INTEGER) AS Year, * FROM submissions)
SELECT Year, count(SubmissionStatus) AS Total_Submissions, count(DISTINCT ApplNo) AS Unique_Applications,
       CASE WHEN count_if(SubmissionStatus = 'AP') > 0 THEN count_if(SubmissionStatus = 'AP') END AS Approvals,
       round_even(CASE WHEN count_if(SubmissionStatus = 'AP') > 0 THEN count_if(SubmissionStatus = 'AP') END::DOUBLE
                  / count(SubmissionStatus) * 100, 1) AS Approval_Rate
FROM s WHERE Year BETWEEN 1996 AND 2001 GROUP BY Year
""")
def t10_yearly(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.yearly_approval_stats(subs, first_year=YEARS_A[0], last_year=YEARS_A[1])


@register("T10_yearly_approval_trend", sql=with_roles("submissions") + """
, s AS (SELECT CAST(year(SubmissionStatusDate) AS INTEGER) AS Year, * FROM submissions)
SELECT Year, count(SubmissionStatus) AS Total, count_if(SubmissionStatus = 'AP') AS Approved,
       count_if(SubmissionStatus = 'AP')::DOUBLE / count(SubmissionStatus) AS ApprovalRate
FROM s WHERE Year BETWEEN 1995 AND 2000 GROUP BY Year
""")
def t10_trend(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.yearly_approval_trend(subs, first_year=YEARS_B[0], last_year=YEARS_B[1])


@register("T11_yearly_growth_filtered", sql=with_roles("applications", "submissions") + """
, s AS (SELECT CAST(year(SubmissionStatusDate) AS INTEGER) AS Year FROM submissions
        WHERE ReviewPriority = 'PRIORITY' AND ApplNo IN (SELECT ApplNo FROM applications WHERE ApplType = 'F'))
, g AS (SELECT Year, count(*) AS Submissions FROM s WHERE Year BETWEEN 1996 AND 2001 GROUP BY Year)
SELECT Year, Submissions,
       (Submissions - lag(Submissions) OVER (ORDER BY Year))::DOUBLE / lag(Submissions) OVER (ORDER BY Year) * 100 AS YoY_Growth_Pct
FROM g
""")
def t11_growth(spark, d):
    apps, subs = roles(spark, d, "applications", "submissions")
    return T.yearly_growth(subs, apps, priority="PRIORITY", app_type="F", year_range=YEARS_A)


@register("T11_yearly_growth_all", sql=with_roles("submissions") + """
, g AS (SELECT CAST(year(SubmissionStatusDate) AS INTEGER) AS Year, count(*) AS Submissions FROM submissions
        WHERE SubmissionStatusDate IS NOT NULL GROUP BY 1)
SELECT Year, Submissions,
       (Submissions - lag(Submissions) OVER (ORDER BY Year))::DOUBLE / lag(Submissions) OVER (ORDER BY Year) * 100 AS YoY_Growth_Pct
FROM g
""")
def t11_growth_all(spark, d):
    apps, subs = roles(spark, d, "applications", "submissions")
    return T.yearly_growth(subs, apps)


@register("T12_seasonal_by_month", sql=with_roles("submissions") + """
SELECT CAST(month(SubmissionStatusDate) AS INTEGER) AS month, count(*) AS count FROM submissions
WHERE SubmissionStatusDate IS NOT NULL GROUP BY 1
""")
def t12_month(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.seasonal_counts(subs, unit="month")


@register("T12_seasonal_by_quarter", sql=with_roles("submissions") + """
SELECT CAST(quarter(SubmissionStatusDate) AS INTEGER) AS quarter, count(*) AS count FROM submissions
WHERE SubmissionStatusDate IS NOT NULL GROUP BY 1
""")
def t12_quarter(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.seasonal_counts(subs, unit="quarter")


@register("T13_year_month_heatmap", sql=with_roles("submissions") + """
, s AS (SELECT CAST(year(SubmissionStatusDate) AS INTEGER) AS Year, month(SubmissionStatusDate) AS mo
        FROM submissions WHERE SubmissionStatusDate IS NOT NULL)
SELECT Year, """ + ", ".join(f"count_if(mo = {m}) AS m{m:02d}" for m in range(1, 13)) + """
FROM s WHERE Year BETWEEN 1996 AND 2000 GROUP BY Year
""")
def t13_heatmap(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.year_month_heatmap(subs, year_range=(1996, 2000))


@register("T14_submissions_by_year", sql=with_roles("submissions") + """
SELECT CAST(year(SubmissionStatusDate) AS INTEGER) AS Year, count(*) AS Submissions FROM submissions
WHERE year(SubmissionStatusDate) BETWEEN 1990 AND 2024 GROUP BY 1
""")
def t14_by_year(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return T.submissions_by_year(subs, first_year=YEARS_C[0], last_year=YEARS_C[1])


@register("Z8_series_stats_and_trend", sql=with_roles("submissions") + _MONTHLY_SQL + """
, o AS (SELECT TotalSubmissions::DOUBLE AS y, row_number() OVER (ORDER BY month) - 1 AS i FROM m)
SELECT avg(y) AS mean, stddev_samp(y) AS std, CAST(min(y) AS BIGINT) AS min, CAST(max(y) AS BIGINT) AS max,
       regr_slope(y, i) AS trend_slope FROM o
""")
def z8_trend(spark, d):
    return T.series_basic_stats(_monthly(spark, d), "TotalSubmissions")
