"""Prescriptive scoring (P-series) and the anomaly feature table.

Per-application indicators are one grouped aggregate over submissions
(partial aggregation before the shuffle).  Data-wide constants (a 95th
percentile, tertile edges, maxima) are one-row aggregates broadcast back to
the rows, so every branch is decided inside the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regula.functions.columns import count_of, first_number, ratio
from regula.operators.relational import global_quantiles, grouped_quantiles, prefix_sums
from regula.session import cut_lineage, dealt


def risk_indicators(subs: DataFrame, *, key: str = "ApplNo", status: str = "SubmissionStatus",
                    date: str = "SubmissionStatusDate", priority: str = "ReviewPriority",
                    withdrawn: str = "WD", rejected=("TA", "RL"), priority_value: str = "PRIORITY",
                    freq_quantile: float = 0.95, weights=(0.3, 0.3, 0.2, 0.2)) -> DataFrame:
    """Risk score per application (P1): 0.3 withdrawal rate + 0.3 rejection
    rate + 0.2 submission frequency normalised by its 95th percentile
    (clipped at 1) + 0.2 priority flag.  Undated applications keep a null
    frequency and therefore a null score (N15)."""
    g = subs.groupBy(key).agg(
        F.count(status).alias("TotalSubmissions"),
        count_of(status, withdrawn).alias("Withdrawals"),
        count_of(status, list(rejected)).alias("Rejections"),
        F.timestamp_diff("DAY", F.min(date), F.max(date)).cast("long").alias("_days"),
        F.coalesce(F.bool_or(F.col(priority) == priority_value), F.lit(False)).alias("HasPriority"))
    g = (g.withColumn("WithdrawalRate", ratio("Withdrawals", "TotalSubmissions"))
          .withColumn("RejectionRate", ratio("Rejections", "TotalSubmissions"))
          .withColumn("DevelopmentDays", F.when(F.col("_days") == 0, F.lit(1)).otherwise(F.col("_days")))
          .withColumn("SubmissionFrequency", F.col("TotalSubmissions") / (F.col("DevelopmentDays") / 365))
          .drop("_days"))
    g = cut_lineage(g)  # read by the percentile, the tertile edges and the rows
    q = global_quantiles(g, "SubmissionFrequency", [freq_quantile], cut=False).select(F.get("_q", F.lit(0)).alias("_maxf"))
    nf = F.when(F.col("_maxf") > 0, F.when(F.col("SubmissionFrequency") / F.col("_maxf") > 1, F.lit(1.0))
                .otherwise(F.col("SubmissionFrequency") / F.col("_maxf"))).otherwise(F.lit(0.0))
    w1, w2, w3, w4 = weights
    out = g.crossJoin(F.broadcast(q)).withColumn("NormalizedFrequency", nf).drop("_maxf")
    score = (w1 * F.coalesce(F.col("WithdrawalRate"), F.lit(0.0)) + w2 * F.coalesce(F.col("RejectionRate"), F.lit(0.0))
             + w3 * F.col("NormalizedFrequency") + w4 * F.col("HasPriority").cast("int"))
    return out.withColumn("RiskScore", score)


def risk_levels(scored: DataFrame, score: str = "RiskScore", cuts=(0.33, 0.67),
                labels=("Low", "Medium", "High")) -> DataFrame:
    """Tertile risk level (P2): exact quantile edges at 0 / .33 / .67 / 1 with
    right-closed bins; when edges collide, equal-width cuts at 33% / 67% of
    the range; a constant score is "Medium".  Null scores stay unlabelled."""
    e = global_quantiles(scored, score, [0.0, cuts[0], cuts[1], 1.0], cut=False)
    # the outer quantiles are the range
    e = e.select("_q", F.get("_q", F.lit(0)).alias("_lo"), F.get("_q", F.lit(3)).alias("_hi"))
    def q(i):
        return F.try_element_at(F.col("_q"), F.lit(i + 1))
    distinct_edges = (q(0) < q(1)) & (q(1) < q(2)) & (q(2) < q(3))
    x = F.col(score)
    by_q = F.when(x <= q(1), labels[0]).when(x <= q(2), labels[1]).otherwise(labels[2])
    rng = F.col("_hi") - F.col("_lo")
    by_w = (F.when(x <= F.col("_lo") + rng * cuts[0], labels[0])
             .when(x <= F.col("_lo") + rng * cuts[1], labels[1]).otherwise(labels[2]))
    level = (F.when(x.isNull(), F.lit(None))
              .when(distinct_edges, by_q)
              .when(rng > 0, by_w)
              .otherwise(F.lit(labels[1])))
    return scored.crossJoin(F.broadcast(e)).withColumn("RiskLevel", level).drop("_q", "_lo", "_hi")


def high_risk_list(levelled: DataFrame, *, key: str = "ApplNo", k: int = 15, weekly_above: float = 0.7) -> DataFrame:
    """Top-k "High" applications by score with a monitoring action."""
    hi = levelled.filter(F.col("RiskLevel") == "High")
    top = hi.orderBy(F.col("RiskScore").desc(), F.col(key)).limit(k)
    # a window over the k rows that are left
    rank = F.row_number().over(Window.orderBy(F.col("RiskScore").desc(), F.col(key))).alias("rank")
    return top.select(rank, key, "RiskScore", "TotalSubmissions", "Withdrawals", "Rejections",
                      F.when(F.col("RiskScore") > weekly_above, "Weekly monitoring")
                       .otherwise("Bi-weekly monitoring").alias("Action"))


def risk_distribution(levelled: DataFrame) -> DataFrame:
    """Applications per risk level with % of scored applications."""
    from regula.operators.relational import value_counts
    return value_counts(levelled, "RiskLevel")


def approval_readiness(subs: DataFrame, apps: DataFrame, products: DataFrame, *, key: str = "ApplNo",
                       status: str = "SubmissionStatus", date: str = "SubmissionStatusDate",
                       number: str = "SubmissionNo", priority: str = "ReviewPriority",
                       priority_value: str = "PRIORITY", closed=("AP", "WD"), type_col: str = "ApplType",
                       ref: str = "ReferenceDrug", weights=(0.3, 0.2, 0.3, 0.2),
                       priority_bonus: float = 0.2, limit: int | None = None) -> DataFrame:
    """Readiness of pending applications.

    Latest status = last non-null status in date order, undated rows last
    (N18, ties by submission number then status).  Pending = latest status
    not approved/withdrawn.  All pending applications are scored (D5; set
    ``limit`` for the reference's first-100 cut).  Metrics come from grouped
    aggregates joined on the key, not per-application scans (J7)."""
    from regula.operators.relational import last_non_null_by
    latest = last_non_null_by(subs, key, date, [status], tie=[number, status])
    latest = latest.withColumnRenamed(status, "CurrentStatus")
    pending = latest.filter(~F.coalesce(F.col("CurrentStatus").isin(list(closed)), F.lit(False)))
    if limit is not None:
        pending = pending.orderBy(key).limit(limit)
    s = subs.groupBy(key).agg(
        F.count(F.lit(1)).alias("TotalSubmissions"),
        F.coalesce(F.bool_or(F.col(priority) == priority_value), F.lit(False)).alias("HasPriorityReview"),
        F.coalesce(F.timestamp_diff("DAY", F.min(date), F.max(date)), F.lit(0)).cast("long").alias("DaysSinceFirst"))
    p = products.groupBy(key).agg(F.count(F.lit(1)).alias("ProductCount"), F.sum(ref).alias("ReferenceProducts"))
    a = apps.groupBy(key).agg(F.min(type_col).alias(type_col))
    r = cut_lineage(pending.join(a, key, "inner").join(s, key, "inner").join(p, key, "left")
                    .na.fill(0, ["ProductCount", "ReferenceProducts"]))
    mx = r.agg(F.greatest(F.max("TotalSubmissions"), F.lit(1)).alias("_ms"),
               F.greatest(F.max("ProductCount"), F.lit(1)).alias("_mp"),
               F.greatest(F.max("DaysSinceFirst"), F.lit(1)).alias("_md"))
    w1, w2, w3, w4 = weights
    r = (r.crossJoin(F.broadcast(mx))
          .withColumn("SubmissionScore", F.col("TotalSubmissions") / F.col("_ms"))
          .withColumn("ProductScore", F.col("ProductCount") / F.col("_mp"))
          .withColumn("TimeScore", F.col("DaysSinceFirst") / F.col("_md"))
          .withColumn("PriorityBonus", F.col("HasPriorityReview").cast("int") * priority_bonus)
          .drop("_ms", "_mp", "_md"))
    r = r.withColumn("ReadinessScore", w1 * F.col("SubmissionScore") + w2 * F.col("ProductScore")
                     + w3 * F.col("TimeScore") + w4 * F.col("PriorityBonus"))
    # dense rank = 1 + number of distinct higher scores: a prefix count over
    # the distinct scores, joined back to the very scores it was made from
    r = cut_lineage(r)
    ds = r.select("ReadinessScore").distinct().withColumn("_one", F.lit(1))
    ds = prefix_sums(ds, "ReadinessScore", ["_one"], descending=True)
    ds = ds.select("ReadinessScore", (F.col("_one_before") + 1).cast("int").alias("ReadinessRank"))
    return r.join(ds, "ReadinessScore", "inner")


def top_ready(readiness: DataFrame, key: str = "ApplNo", k: int = 20) -> DataFrame:
    return readiness.orderBy("ReadinessRank", key).limit(k)


def readiness_by_type(readiness: DataFrame, type_col: str = "ApplType") -> DataFrame:
    return readiness.groupBy(type_col).agg(F.avg("ReadinessScore").alias("mean_readiness"),
                                           F.count(F.lit(1)).alias("n"))


def readiness_components(readiness: DataFrame) -> DataFrame:
    """Mean of each score component."""
    return readiness.agg(*[F.avg(c).alias(c) for c in
                           ("SubmissionScore", "ProductScore", "TimeScore", "PriorityBonus")])


def sponsor_success(subs: DataFrame, apps: DataFrame, *, key: str = "ApplNo", sponsor: str = "SponsorName",
                    status: str = "SubmissionStatus", approved: str = "AP", priority: str = "ReviewPriority",
                    priority_value: str = "PRIORITY", min_submissions: int = 10,
                    weights=(0.4, 0.3, 0.3)) -> DataFrame:
    """Sponsor success score (P5): 0.4 approval rate + 0.3 / (submissions per
    application) + 0.3 priority share, sponsors with >= 10 submissions."""
    per_app = subs.groupBy(key).agg(F.count(status).alias("_n"), count_of(status, approved).alias("_ap"),
                                    count_of(priority, priority_value).alias("_pr"))
    j = per_app.join(apps.select(key, sponsor), key, "inner").filter(F.col(sponsor).isNotNull())
    m = j.groupBy(sponsor).agg(F.sum("_n").alias("TotalSubmissions"), F.sum("_ap").alias("Approvals"),
                               F.sum("_pr").alias("PriorityReviews"),
                               F.countDistinct(key).alias("UniqueApplications"))
    w1, w2, w3 = weights
    m = (m.withColumn("ApprovalRate", ratio("Approvals", "TotalSubmissions"))
          .withColumn("SubmissionEfficiency", ratio("TotalSubmissions", "UniqueApplications")))
    m = m.withColumn("SuccessScore", w1 * F.col("ApprovalRate") + w2 * ratio(F.lit(1.0), F.col("SubmissionEfficiency"))
                     + w3 * ratio("PriorityReviews", "TotalSubmissions"))
    return m.filter(F.col("TotalSubmissions") >= min_submissions)


def sponsor_success_list(scored: DataFrame, *, sponsor: str = "SponsorName", k: int = 20) -> DataFrame:
    """The ``k`` sponsors with the greatest success score and their rank, ties
    by name (P5, W9).  Only the k rows of the sorted list are numbered."""
    order = [F.col("SuccessScore").desc(), F.col(sponsor)]
    return scored.orderBy(*order).limit(k).withColumn("Rank", F.row_number().over(Window.orderBy(*order)))


def dose_table(products: DataFrame, subs: DataFrame, *, key: str = "ApplNo", strength: str = "Strength",
               status: str = "SubmissionStatus", approved: str = "AP") -> DataFrame:
    """Products with a parsed dose and the application's approval flag (any
    approved submission; null when the application has no submissions)."""
    appr = subs.groupBy(key).agg(F.bool_or(F.coalesce(F.col(status) == approved, F.lit(False))).alias("IsApproved"))
    p = products.withColumn("DosageValue", first_number(strength)).filter(F.col("DosageValue").isNotNull())
    return dealt(p, key).join(appr, key, "left")


def dose_by_form(doses: DataFrame, form: str = "Form", min_n: int = 10, k: int = 10) -> DataFrame:
    """Dose mean +- std, range, n and approval rate per form."""
    x = F.col("DosageValue")
    g = doses.filter(F.col(form).isNotNull()).groupBy(form).agg(
        F.avg(x).alias("mean_dose"), F.stddev_samp(x).alias("std_dose"), F.min(x).alias("min_dose"),
        F.max(x).alias("max_dose"), F.count(x).alias("n"),
        F.avg(F.col("IsApproved").cast("int")).alias("approval_rate"))
    g = g.filter(F.col("n") >= min_n).orderBy(F.col("n").desc(), F.col(form)).limit(k)
    return g.withColumn("range_low", F.col("mean_dose") - F.col("std_dose")) \
            .withColumn("range_high", F.col("mean_dose") + F.col("std_dose"))


def dose_deciles(doses: DataFrame, q: int = 10, min_n: int = 20, k: int = 3) -> DataFrame:
    """Approval rate per dose decile (P7): exact quantile edges with
    duplicates dropped, right-closed bins; best k bins with n >= min_n."""
    from regula.functions.columns import right_closed_bin
    probs = [i / q for i in range(q + 1)]
    edges = global_quantiles(doses, "DosageValue", probs).select(F.array_distinct("_q").alias("_edges"))
    b = doses.crossJoin(F.broadcast(edges)).withColumn("bin", right_closed_bin("DosageValue", F.col("_edges")))
    g = b.groupBy("bin").agg(F.avg(F.col("IsApproved").cast("int")).alias("approval_rate"),
                             F.count("IsApproved").alias("n"),
                             F.first(F.col("_edges")).alias("_edges"))
    g = g.select("bin", F.col("_edges")[F.col("bin")].alias("bin_lower"),
                 F.col("_edges")[F.col("bin") + 1].alias("bin_upper"), "approval_rate", "n")
    return g.filter(F.col("n") >= min_n).orderBy(F.col("approval_rate").desc(), F.col("bin")).limit(k)


# The dashboard's dose bin edges and labels.
DOSE_EDGES = [0, 10, 50, 100, 200, 300, 400, 500, 600]
DOSE_LABELS = ["0-10", "10-50", "50-100", "100-200", "200-300", "300-400", "400-500", "500+"]


def dose_histogram_top_forms(products: DataFrame, *, form: str = "Form", strength: str = "Strength",
                             top: int = 5) -> DataFrame:
    """Dose histogram for the top forms by product count (P8) with fixed
    edges; the last bin is open-ended (D7).  Zero-filled per form."""
    tf = (products.filter(F.col(form).isNotNull()).groupBy(form).agg(F.count(F.lit(1)).alias("_n"))
                  .orderBy(F.col("_n").desc(), F.col(form)).limit(top).select(form))
    d = (products.join(tf, form, "left_semi").withColumn("_v", first_number(strength))
                 .filter(F.col("_v").isNotNull() & (F.col("_v") >= 0)))
    v = F.col("_v")
    b = F.when((v >= DOSE_EDGES[0]) & (v < DOSE_EDGES[1]), F.lit(0))
    for i in range(1, len(DOSE_LABELS) - 1):
        b = b.when((v >= DOSE_EDGES[i]) & (v < DOSE_EDGES[i + 1]), F.lit(i))
    b = b.when(v >= DOSE_EDGES[-2], F.lit(len(DOSE_LABELS) - 1))
    g = d.withColumn("bin", b).groupBy(form, "bin").agg(F.count(F.lit(1)).alias("count"))
    spine = tf.crossJoin(F.broadcast(
        products.sparkSession.range(len(DOSE_LABELS)).select(F.col("id").cast("int").alias("bin"))))
    labels = F.array(*[F.lit(x) for x in DOSE_LABELS])
    return (spine.join(g, [form, "bin"], "left")
                 .select(form, "bin", labels[F.col("bin")].alias("label"),
                         F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def dose_summary_by_approval(doses: DataFrame, trim_q: float = 0.95) -> DataFrame:
    """Five-number summary of doses by approval, each group trimmed at its
    own 95th percentile (P9)."""
    d = doses.filter(F.col("IsApproved").isNotNull())
    d = cut_lineage(d.select("IsApproved", "DosageValue"))
    q = grouped_quantiles(d, ["IsApproved"], "DosageValue", [trim_q]).select("IsApproved", F.get("_q", F.lit(0)).alias("_cap"))
    # two groups at most: a join by them would put the rows into two tasks
    t = d.join(F.broadcast(q), "IsApproved").filter(F.col("DosageValue") <= F.col("_cap"))
    x = F.col("DosageValue")
    five = grouped_quantiles(t, ["IsApproved"], "DosageValue", [0.25, 0.5, 0.75])
    return t.groupBy("IsApproved").agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max")).join(five, "IsApproved").select(
        "IsApproved", "n", "min", F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("median"),
        F.get("_q", F.lit(2)).alias("q3"), "max")


def trimmed_dose_histograms(doses: DataFrame, *, form: str = "Form", top: int = 5, min_rows: int = 10,
                            trim_q: float = 0.95, nbins: int = 20) -> DataFrame:
    """Per top-5 form (by rows of the dose table) with more than 10 rows: a
    20-bin histogram of the doses at or below the form's 95th percentile (P11)."""
    from regula.functions.columns import equal_width_bin
    cnt = doses.filter(F.col(form).isNotNull()).groupBy(form).agg(F.count(F.lit(1)).alias("_n"))
    tf = cnt.orderBy(F.col("_n").desc(), F.col(form)).limit(top).filter(F.col("_n") > min_rows).select(form)
    d = cut_lineage(doses.join(tf, form, "left_semi").select(form, "DosageValue"))
    cap = grouped_quantiles(d, [form], "DosageValue", [trim_q]).select(form, F.get("_q", F.lit(0)).alias("_cap"))
    t = d.join(cap, form).filter(F.col("DosageValue") <= F.col("_cap"))
    rng = t.groupBy(form).agg(F.min("DosageValue").alias("_lo"), F.max("DosageValue").alias("_hi"))
    b = (t.join(rng, form).withColumn("bin", equal_width_bin("DosageValue", "_lo", "_hi", nbins))
           .groupBy(form, "bin").agg(F.count(F.lit(1)).alias("count")))
    spine = rng.select(form, F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"))
    return spine.join(b, [form, "bin"], "left").select(form, "bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def anomaly_features(subs: DataFrame, products: DataFrame, *, key: str = "ApplNo",
                     status: str = "SubmissionStatus", number: str = "SubmissionNo",
                     priority: str = "ReviewPriority", withdrawn: str = "WD", priority_value: str = "PRIORITY",
                     product_no: str = "ProductNo", ref: str = "ReferenceDrug") -> DataFrame:
    """Per-application anomaly features (M25): withdrawals, submissions,
    priority count, product and reference counts, withdrawal and priority
    rates; missing product info -> 0."""
    s = subs.groupBy(key).agg(count_of(status, withdrawn).alias("WithdrawalCount"),
                              F.count(number).alias("TotalSubmissions"),
                              count_of(priority, priority_value).alias("PriorityCount"))
    p = products.groupBy(key).agg(F.count(product_no).alias("ProductCount"), F.sum(ref).alias("ReferenceCount"))
    j = s.join(p, key, "left").na.fill(0, ["ProductCount", "ReferenceCount"])
    return (j.withColumn("WithdrawalRate", F.coalesce(ratio("WithdrawalCount", "TotalSubmissions"), F.lit(0.0)))
             .withColumn("PriorityRate", F.coalesce(ratio("PriorityCount", "TotalSubmissions"), F.lit(0.0))))
