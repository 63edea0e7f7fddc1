"""Time-series operators (T-series).

Every operator takes an optional ``series`` key so one job handles many
series (per sponsor, per type ...); windows are partitioned by that key and
ordered by month, which keeps each window partition to one series' months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regula.functions.columns import days_in_month, month_start, ratio, round_half_even
from regula.operators.relational import distribution_stats, global_quantiles, grouped_quantiles
from regula.session import cut_lineage


def _keys(series):
    if series is None:
        return []
    return [series] if isinstance(series, str) else list(series)


# ----------------------------------------------------------- T1 approval time

def approval_timelines(subs: DataFrame, *, key: str = "ApplNo", date: str = "SubmissionStatusDate",
                       status: str = "SubmissionStatus", approved: str = "AP",
                       number: str = "SubmissionNo", min_days: int = 0,
                       max_days: int = 3650) -> DataFrame:
    """Per application: first and last approved date, approved submissions,
    whole days between them; kept when within [min_days, max_days] (T1).
    The first date is the earliest *approved* date, as in the reference."""
    a = subs.filter((F.col(status) == approved) & F.col(date).isNotNull())
    t = a.groupBy(key).agg(F.min(date).alias("_first"), F.max(date).alias("_last"),
                           F.count(number).alias("Total_Submissions"))
    days = F.timestamp_diff("DAY", F.col("_first"), F.col("_last"))
    return (t.select(key, F.to_date("_first").alias("first_approved_date"),
                     F.to_date("_last").alias("final_approval_date"), "Total_Submissions",
                     days.cast("long").alias("Days_to_Approval"))
             .filter(F.col("Days_to_Approval").between(min_days, max_days)))


def approval_time_stats(timelines: DataFrame, days: str = "Days_to_Approval") -> DataFrame:
    """n, mean, median, std, 25th and 75th percentile (exact, N8)."""
    timelines = cut_lineage(timelines.select(days))
    x = F.col(days)
    base = timelines.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    q = global_quantiles(timelines, days, [0.5, 0.25, 0.75], cut=False)
    return base.crossJoin(q).select("n", "mean", F.try_element_at(F.col("_q"), F.lit(1)).alias("median"), "std",
                                    F.try_element_at(F.col("_q"), F.lit(2)).alias("p25"), F.try_element_at(F.col("_q"), F.lit(3)).alias("p75"))


def approval_time_by_priority(subs: DataFrame, timelines: DataFrame, *, key: str = "ApplNo",
                              priority: str = "ReviewPriority", status: str = "SubmissionStatus",
                              approved: str = "AP", levels=("PRIORITY", "STANDARD"),
                              days: str = "Days_to_Approval") -> DataFrame:
    """Mean / median / n of approval time per review priority: an application
    belongs to a level when any approved submission has it (semi join)."""
    tagged = (subs.filter((F.col(status) == approved) & F.col(priority).isin(list(levels)))
                  .select(key, F.col(priority).alias("priority")).distinct())
    j = cut_lineage(timelines.select(key, days).join(tagged, key, "inner").select("priority", days))
    x = F.col(days)
    median = grouped_quantiles(j, ["priority"], days, [0.5]).select("priority", F.get("_q", F.lit(0)).alias("median"))
    return j.groupBy("priority").agg(F.count(x).alias("n"), F.avg(x).alias("mean")).join(median, "priority", "left")


def months_ahead(ts: DataFrame, month: str = "month", horizon: int = 12) -> DataFrame:
    """The ``horizon`` months after the last one of a series."""
    last = ts.agg(F.max(month).alias("_last")).filter(F.col("_last").isNotNull())
    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.struct(i.alias("step"), F.add_months(F.col("_last"), i).alias("month")))
    return last.select(F.explode(steps).alias("_s")).select("_s.step", "_s.month")


# ------------------------------------------------------------ T2 monthly data

def monthly_series(subs: DataFrame, *, date: str = "SubmissionStatusDate", series=None,
                   number: str = "SubmissionNo", status: str = "SubmissionStatus",
                   approved: str = "AP", priority: str = "ReviewPriority",
                   priority_value: str = "PRIORITY", key: str = "ApplNo",
                   start: str = "2000-01-01", end: str = "2024-01-01") -> DataFrame:
    """Monthly totals, approvals, priority reviews, unique applications and
    the two rates (T2).  Months between a series' first and last dated month
    are all present (empty ones with 0, N23), then clipped to [start, end)."""
    ks = _keys(series)
    m = month_start(date)
    base = subs.filter(F.col(date).isNotNull()).withColumn("month", m)
    agg = base.groupBy(*ks, "month").agg(
        F.count(number).alias("TotalSubmissions"),
        F.count_if(F.col(status) == approved).alias("Approvals"),
        F.count_if(F.col(priority) == priority_value).alias("PriorityReviews"),
        F.countDistinct(key).alias("UniqueApplications"))
    bounds = agg.groupBy(*ks).agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    spine = bounds.select(*ks, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    filled = spine.join(agg, [*ks, "month"], "left").na.fill(
        0, ["TotalSubmissions", "Approvals", "PriorityReviews", "UniqueApplications"])
    out = filled.withColumn("ApprovalRate", F.coalesce(ratio("Approvals", "TotalSubmissions"), F.lit(0.0))) \
                .withColumn("PriorityRate", F.coalesce(ratio("PriorityReviews", "TotalSubmissions"), F.lit(0.0)))
    return out.filter((F.col("month") >= F.to_date(F.lit(start))) & (F.col("month") < F.to_date(F.lit(end))))


def daily_series(df: DataFrame, ts: str, series: str | None = None, value: str | None = None) -> DataFrame:
    """Day buckets with count and optional value sum, gaps filled with 0."""
    ks = _keys(series)
    d = df.filter(F.col(ts).isNotNull()).withColumn("day", F.to_date(F.col(ts)))
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.sum(value).alias("value_sum"))
    agg = d.groupBy(*ks, "day").agg(*aggs)
    bounds = agg.groupBy(*ks).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    spine = bounds.select(*ks, F.explode(F.sequence("_lo", "_hi")).alias("day"))
    out = spine.join(agg, [*ks, "day"], "left").na.fill(0, ["n"])
    if value:
        out = out.na.fill(0.0, ["value_sum"])
    return out


# ------------------------------------------------------------- T3 features

def series_features(ts: DataFrame, *, target: str = "TotalSubmissions", order: str = "month",
                    series=None, lags=(1, 3, 6, 12), windows=(3, 6, 12),
                    drop_incomplete: bool = True) -> DataFrame:
    """Lags, rolling mean/std (null until the window is full, N22), calendar
    fields and time_index, all sharing one window ordering (T3)."""
    ks = _keys(series)
    w = Window.partitionBy(*ks).orderBy(order)
    y = F.col(target).cast("double")
    cols = [F.col(x) for x in ts.columns]
    for k in lags:
        cols.append(F.lag(y, k).over(w).alias(f"lag_{k}"))
    for n in windows:
        fw = w.rowsBetween(-(n - 1), 0)
        full = F.count(y).over(fw) == n
        cols.append(F.when(full, F.avg(y).over(fw)).alias(f"rolling_mean_{n}"))
        cols.append(F.when(full, F.stddev_samp(y).over(fw)).alias(f"rolling_std_{n}"))
    cols += [F.year(order).alias("year"), F.month(order).alias("month_of_year"),
             F.quarter(order).alias("quarter"), days_in_month(order).alias("days_in_month"),
             (F.row_number().over(w) - 1).alias("time_index")]
    out = ts.select(*cols)
    if drop_incomplete:
        need = [f"lag_{k}" for k in lags] + [f"rolling_{s}_{n}" for n in windows for s in ("mean", "std")]
        out = out.na.drop(subset=need)
    return out


# ----------------------------------------------------- T5 seasonal decompose

def seasonal_decompose(ts: DataFrame, *, target: str = "TotalSubmissions", order: str = "month",
                       series=None, period: int = 12) -> DataFrame:
    """Additive decomposition (T5): centred moving-average trend (2 x period
    for even periods), seasonal = mean detrended value per position
    ``index mod period`` minus the mean of those means, residual."""
    ks = _keys(series)
    w = Window.partitionBy(*ks).orderBy(order)
    y = F.col(target).cast("double")
    h = period // 2
    if period % 2 == 0:
        inner = w.rowsBetween(-(h - 1), h - 1)
        full = (F.count(y).over(w.rowsBetween(-h, h)) == period + 1)
        trend = (F.sum(y).over(inner) + 0.5 * (F.lag(y, h).over(w) + F.lead(y, h).over(w))) / period
    else:
        fr = w.rowsBetween(-h, h)
        full = F.count(y).over(fr) == period
        trend = F.avg(y).over(fr)
    base = ts.select(*ks, order, y.alias("observed"),
                     F.when(full, trend).alias("trend"),
                     ((F.row_number().over(w) - 1) % period).alias("position"))
    det = base.withColumn("_detr", F.col("observed") - F.col("trend"))
    pos = det.groupBy(*ks, "position").agg(F.avg("_detr").alias("_pm"))
    wk = Window.partitionBy(*ks)
    pos = pos.withColumn("seasonal", F.col("_pm") - F.avg("_pm").over(wk)).drop("_pm")
    out = det.drop("_detr").join(pos, [*ks, "position"], "left")
    return out.withColumn("resid", F.col("observed") - F.col("trend") - F.col("seasonal"))


# --------------------------------------------------------- yearly summaries

def yearly_approval_stats(subs: DataFrame, *, date: str = "SubmissionStatusDate",
                          status: str = "SubmissionStatus", approved: str = "AP",
                          key: str = "ApplNo", first_year: int = 2010,
                          last_year: int = 2024) -> DataFrame:
    """Per year in range: submissions (non-null status), unique applications,
    approvals (null when none, N19) and approval % rounded half-even (T10)."""
    y = F.year(F.col(date))
    s = subs.withColumn("Year", y).filter(F.col("Year").between(first_year, last_year))
    out = s.groupBy("Year").agg(
        F.count(status).alias("Total_Submissions"),
        F.countDistinct(key).alias("Unique_Applications"),
        F.count_if(F.col(status) == approved).alias("_ap"))
    out = out.withColumn("Approvals", F.when(F.col("_ap") > 0, F.col("_ap"))).drop("_ap")
    return out.withColumn("Approval_Rate",
                          round_half_even(ratio("Approvals", "Total_Submissions") * 100, 1))


def yearly_approval_trend(subs: DataFrame, *, date: str = "SubmissionStatusDate",
                          status: str = "SubmissionStatus", approved: str = "AP",
                          first_year: int = 2000, last_year: int = 2023) -> DataFrame:
    """Per year: total, approved and approval rate (fraction), range-limited."""
    s = subs.withColumn("Year", F.year(F.col(date))).filter(F.col("Year").between(first_year, last_year))
    out = s.groupBy("Year").agg(F.count(status).alias("Total"),
                                F.count_if(F.col(status) == approved).alias("Approved"))
    return out.withColumn("ApprovalRate", ratio("Approved", "Total"))


def yearly_growth(subs: DataFrame, apps: DataFrame | None = None, *, date: str = "SubmissionStatusDate",
                  key: str = "ApplNo", priority_col: str = "ReviewPriority", priority: str = "all",
                  type_col: str = "ApplType", app_type: str = "all",
                  year_range: tuple[int, int] | None = None) -> DataFrame:
    """Submissions per year with optional filters and year-over-year growth %
    (T11).  Filters are AND-ed below the aggregate; the type filter is a
    semi join against the applications of that type."""
    s = subs
    if priority != "all":
        s = s.filter(F.col(priority_col) == priority)
    if app_type != "all" and apps is not None:
        s = s.join(apps.filter(F.col(type_col) == app_type).select(key), key, "left_semi")
    s = s.withColumn("Year", F.year(F.col(date))).filter(F.col("Year").isNotNull())
    if year_range:
        s = s.filter(F.col("Year").between(*year_range))
    g = s.groupBy("Year").agg(F.count(F.lit(1)).alias("Submissions"))
    w = Window.orderBy("Year")
    prev = F.lag("Submissions", 1).over(w)
    return g.withColumn("YoY_Growth_Pct", ratio(F.col("Submissions") - prev, prev) * 100)


def seasonal_counts(subs: DataFrame, date: str = "SubmissionStatusDate", unit: str = "month") -> DataFrame:
    """Counts by calendar month or quarter."""
    f = {"month": F.month, "quarter": F.quarter}[unit]
    return (subs.select(f(F.col(date)).alias(unit)).filter(F.col(unit).isNotNull())
                .groupBy(unit).agg(F.count(F.lit(1)).alias("count")))


def year_month_heatmap(subs: DataFrame, date: str = "SubmissionStatusDate",
                       year_range: tuple[int, int] | None = None) -> DataFrame:
    """Year x month submission counts, zero-filled, fixed months 1..12."""
    s = subs.select(F.year(date).alias("Year"), F.month(date).alias("Month")).filter(F.col("Year").isNotNull())
    if year_range:
        s = s.filter(F.col("Year").between(*year_range))
    p = s.groupBy("Year").pivot("Month", list(range(1, 13))).count().na.fill(0)
    return p.select("Year", *[F.col(str(m)).cast("long").alias(f"m{m:02d}") for m in range(1, 13)])


def submissions_by_year(subs: DataFrame, date: str = "SubmissionStatusDate",
                        first_year: int = 1990, last_year: int = 2024) -> DataFrame:
    """Submissions per year within a range."""
    return (subs.select(F.year(date).alias("Year")).filter(F.col("Year").between(first_year, last_year))
                .groupBy("Year").agg(F.count(F.lit(1)).alias("Submissions")))


def series_basic_stats(ts: DataFrame, target: str, order: str = "month") -> DataFrame:
    """Mean / std / min / max and the linear trend slope of a series."""
    st = distribution_stats(ts, target).select("mean", "std", "min", "max")
    w = Window.orderBy(order)
    sl = (ts.select(F.col(target).cast("double").alias("_y"), (F.row_number().over(w) - 1).alias("_i"))
            .agg(F.regr_slope("_y", "_i").alias("trend_slope")))
    return st.crossJoin(sl)
