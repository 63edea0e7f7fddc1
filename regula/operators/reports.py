"""Domain reports: compositions of the relational operators (R-series)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.functions.columns import ratio, round_half_even


def sponsor_performance(apps: DataFrame, products: DataFrame, subs: DataFrame, *,
                        key: str = "ApplNo", sponsor: str = "SponsorName",
                        product_no: str = "ProductNo", submission_no: str = "SubmissionNo",
                        status: str = "SubmissionStatus", approved: str = "AP") -> DataFrame:
    """Per-sponsor applications, products, submissions, approvals and rate.

    Products and submissions are first reduced to one row per application
    (partial aggregation before any shuffle), joined to the applications on
    the application key (one co-partitioned shuffle), and only then rolled up
    per sponsor.  A sponsor without products / submissions keeps a null count,
    as index-aligned assignment does.
    """
    p = products.groupBy(key).agg(F.count(product_no).alias("_np"))
    s = subs.groupBy(key).agg(F.count(submission_no).alias("_ns"),
                              F.count_if(F.col(status) == approved).alias("_na"))
    a = apps.select(key, sponsor).filter(F.col(sponsor).isNotNull())
    out = (a.join(p, key, "left").join(s, key, "left")
            .groupBy(sponsor)
            .agg(F.count(key).alias("Total_Applications"),
                 F.sum("_np").alias("Total_Products"),
                 F.sum("_ns").alias("Total_Submissions"),
                 F.sum("_na").alias("Approved_Submissions")))
    return out.withColumn(
        "Approval_Rate",
        round_half_even(ratio("Approved_Submissions", "Total_Submissions") * 100, 1))


def top_sponsors(stats: DataFrame, *, sponsor: str = "SponsorName",
                 by: str = "Total_Applications", k: int = 20,
                 hide=("", "UNKNOWN")) -> DataFrame:
    """``nlargest(k)`` with the key as tie-break (N12); hidden names dropped
    after the cut, as the report prints them."""
    top = stats.orderBy(F.col(by).desc(), F.col(sponsor).asc()).limit(k)
    return top.filter(~F.col(sponsor).isin(list(hide)))


def overall_approval(subs: DataFrame, status: str = "SubmissionStatus", approved: str = "AP") -> DataFrame:
    """Total submissions, approvals and approval % over all rows."""
    return subs.agg(F.count(F.lit(1)).alias("total_submissions"),
                    F.count_if(F.col(status) == approved).alias("approved"),
                    (F.avg(F.when(F.col(status) == approved, 1).otherwise(0)) * 100).alias("approval_rate_pct"))


def approval_by(df: DataFrame, by: str, status: str = "SubmissionStatus", approved: str = "AP",
                levels=None) -> DataFrame:
    """Approval rate (fraction, nulls count as misses) per value of ``by``
    (R2 / R9); null groups dropped as pandas does (N3)."""
    d = df.filter(F.col(by).isNotNull())
    if levels is not None:
        d = d.filter(F.col(by).isin(list(levels)))
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                             F.avg(F.when(F.col(status) == approved, 1).otherwise(0)).alias("approval_rate"))


def form_diversity(products: DataFrame, form: str = "Form", thresholds=(100, 1000)) -> DataFrame:
    """Distinct forms and forms with more than each threshold of products."""
    g = products.filter(F.col(form).isNotNull()).groupBy(form).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.count(F.lit(1)).alias("unique_forms"),
                 *[F.count_if(F.col("_n") > t).alias(f"forms_over_{t}") for t in thresholds])


def reference_drug_share(products: DataFrame, col: str = "ReferenceDrug") -> DataFrame:
    """Reference vs non-reference products and the reference share %."""
    return products.agg(F.count_if(F.col(col) == 1).alias("reference_drugs"),
                        F.count_if(F.col(col) == 0).alias("non_reference_drugs"),
                        (F.try_divide(F.count_if(F.col(col) == 1), F.count(F.lit(1))) * 100).alias("reference_pct"))


def ingredient_clean(products: DataFrame, col: str = "ActiveIngredient", sep: str = ";") -> DataFrame:
    """Upper-cased, stripped ingredient and the combination flag."""
    clean = F.upper(F.trim(F.col(col)))
    return products.withColumn("ActiveIngredient_Clean", clean).withColumn(
        "Is_Combination", F.coalesce(F.col("ActiveIngredient_Clean").contains(sep), F.lit(False)))


def ingredient_complexity(products: DataFrame, col: str = "ActiveIngredient") -> DataFrame:
    """Single vs combination products with shares."""
    p = ingredient_clean(products, col)
    n = F.count(F.lit(1))
    comb = F.count_if(F.col("Is_Combination"))
    return p.agg((n - comb).alias("single_products"), comb.alias("combination_products"),
                 (comb / n * 100).alias("combination_pct"))


def top_single_ingredients(products: DataFrame, col: str = "ActiveIngredient", k: int = 20) -> DataFrame:
    """Top-k single-ingredient names with % of single-ingredient products;
    empty names dropped after the cut, as the report prints them (R6)."""
    from regula.operators.relational import value_counts
    p = ingredient_clean(products, col).filter(~F.col("Is_Combination"))
    vc = value_counts(p, "ActiveIngredient_Clean", k=k, count_name="products", pct_name="pct")
    return vc.filter(F.col("ActiveIngredient_Clean") != "")


def dataset_overview(apps: DataFrame, products: DataFrame, subs: DataFrame, *,
                     sponsor: str = "SponsorName", drug: str = "DrugName", form: str = "Form",
                     status: str = "SubmissionStatus", approved: str = "AP",
                     key: str = "ApplNo") -> DataFrame:
    """Totals, distinct counts, approval rate and most common status.
    One aggregate per table, combined as one-row frames."""
    a = apps.agg(F.count(F.lit(1)).alias("total_applications"),
                 F.countDistinct(sponsor).alias("unique_sponsors"))
    p = products.agg(F.count(F.lit(1)).alias("total_products"),
                     F.countDistinct(drug).alias("unique_drug_names"),
                     F.countDistinct(form).alias("unique_forms"))
    s = subs.agg(F.count(F.lit(1)).alias("total_submissions"),
                 F.avg(F.when(F.col(status) == approved, 1).otherwise(0)).alias("approval_rate"),
                 F.countDistinct(key).alias("applications_with_submissions"))
    mode = (subs.filter(F.col(status).isNotNull()).groupBy(status).agg(F.count(F.lit(1)).alias("_n"))
                .agg(F.min(F.struct(-F.col("_n"), F.col(status))).alias("_s"))
                .select(F.col("_s").getField(status).alias("most_common_status")))
    return a.crossJoin(p).crossJoin(s).crossJoin(mode)


def sponsor_drug_pairs(apps: DataFrame, products: DataFrame, *, key: str = "ApplNo",
                       sponsor: str = "SponsorName", drug: str = "DrugName", k: int = 10,
                       label_len: int = 20) -> DataFrame:
    """Top sponsor-drug pairs by product count with truncated labels."""
    from regula.functions.columns import truncate_label
    j = products.select(key, drug).join(apps.select(key, sponsor), key, "inner")
    g = (j.filter(F.col(sponsor).isNotNull() & F.col(drug).isNotNull())
          .groupBy(sponsor, drug).agg(F.count(F.lit(1)).alias("products")))
    top = g.orderBy(F.col("products").desc(), F.col(sponsor), F.col(drug)).limit(k)
    return top.withColumn("label", F.concat(truncate_label(sponsor, label_len), F.lit(" - "),
                                            truncate_label(drug, label_len)))


def kpi_row(apps: DataFrame, products: DataFrame, subs: DataFrame, timelines: DataFrame, *,
            key: str = "ApplNo", status: str = "SubmissionStatus", approved: str = "AP") -> DataFrame:
    """Dashboard KPIs with the real mean time to approval."""
    a = apps.agg(F.countDistinct(key).alias("total_applications"))
    p = products.agg(F.count(F.lit(1)).alias("total_products"))
    s = subs.agg((F.avg(F.when(F.col(status) == approved, 1).otherwise(0)) * 100).alias("approval_rate_pct"))
    t = timelines.agg(F.avg("Days_to_Approval").alias("avg_days_to_approval"))
    return a.crossJoin(p).crossJoin(s).crossJoin(t)


def explorer_summary(apps: DataFrame, products: DataFrame, subs: DataFrame, *, key: str = "ApplNo",
                     sponsor: str = "SponsorName", type_col: str = "ApplType", drug: str = "DrugName",
                     form: str = "Form", ref: str = "ReferenceDrug", status: str = "SubmissionStatus",
                     approved: str = "AP", priority: str = "ReviewPriority",
                     priority_value: str = "PRIORITY") -> DataFrame:
    """Explorer page summaries of the three tables in one row (R13); modes
    pick the smallest of tied values (N11)."""
    def mode_of(df, col, name):
        g = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
        return g.agg(F.min(F.struct(-F.col("_n"), F.col(col))).getField(col).alias(name))
    with_products = apps.join(products.select(key).distinct(), key, "left_semi") \
                        .agg(F.count(F.lit(1)).alias("applications_with_products"))
    a = apps.agg(F.countDistinct(key).alias("total_applications"),
                 F.countDistinct(sponsor).alias("unique_sponsors"))
    p = products.agg(F.count(F.lit(1)).alias("total_products"),
                     F.countDistinct(drug).alias("unique_drug_names"),
                     F.count_if(F.col(ref) == 1).alias("reference_drugs"))
    s = subs.agg(F.count(F.lit(1)).alias("total_submissions"),
                 F.count_if(F.col(status) == approved).alias("approved"),
                 (F.avg(F.when(F.col(status) == approved, 1).otherwise(0)) * 100).alias("approval_rate_pct"),
                 F.count_if(F.col(priority) == priority_value).alias("priority_reviews"))
    return (a.crossJoin(mode_of(apps, type_col, "most_common_type")).crossJoin(with_products)
             .crossJoin(p).crossJoin(mode_of(products, form, "most_common_form")).crossJoin(s))


def portfolio_summary(apps: DataFrame, subs: DataFrame, *, key: str = "ApplNo",
                      sponsor: str = "SponsorName", date: str = "SubmissionStatusDate",
                      status: str = "SubmissionStatus", approved: str = "AP",
                      priority: str = "ReviewPriority", priority_value: str = "PRIORITY",
                      recent_year: int = 2020, min_subs: int = 10) -> DataFrame:
    """Portfolio totals, approval and priority rates, recent approval rate
    and the top performer over *all* sponsors with more than ``min_subs``
    submissions (R14, D11); ties go to the smallest name."""
    is_ap = F.when(F.col(status) == approved, 1).otherwise(0)
    a = apps.agg(F.countDistinct(key).alias("total_applications"),
                 F.countDistinct(sponsor).alias("total_sponsors"))
    s = subs.agg((F.avg(is_ap) * 100).alias("approval_rate_pct"),
                 (F.avg(F.when(F.col(priority) == priority_value, 1).otherwise(0)) * 100).alias("priority_rate_pct"),
                 (F.avg(F.when(F.year(date) >= recent_year, is_ap)) * 100).alias("_recent"))
    s = s.select("approval_rate_pct", "priority_rate_pct",
                 F.coalesce(F.col("_recent"), F.col("approval_rate_pct")).alias("recent_approval_rate_pct"))
    per_app = subs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(is_ap).alias("_ap"))
    sp = (apps.select(key, sponsor).filter(F.col(sponsor).isNotNull()).distinct()
              .join(per_app, key, "inner").groupBy(sponsor)
              .agg(F.sum("_n").alias("_n"), F.sum("_ap").alias("_ap"))
              .filter(F.col("_n") > min_subs)
              .withColumn("_rate", F.col("_ap") / F.col("_n")))
    best = sp.agg(F.min(F.struct(-F.col("_rate"), F.col(sponsor))).alias("_b"))
    best = best.select(F.col("_b").getField(sponsor).alias("top_performer"),
                       (-F.col("_b").getField("col1")).alias("top_performer_approval_rate"))
    return a.crossJoin(s).crossJoin(best)


def univariate_panel(apps: DataFrame, products: DataFrame, subs: DataFrame, marketing: DataFrame) -> DataFrame:
    """Counts of the panel's columns in long form with a column label (R16):
    type, status (top 10), priority, form (top 15), reference flag,
    marketing status, sponsor (top 10)."""
    from regula.operators.relational import value_counts
    specs = [(apps, "ApplType", None), (subs, "SubmissionStatus", 10), (subs, "ReviewPriority", None),
             (products, "Form", 15), (products, "ReferenceDrug", None),
             (marketing, "MarketingStatusID", None), (apps, "SponsorName", 10)]
    parts = []
    for df, col, k in specs:
        vc = value_counts(df, col, k=k, count_name="count", pct_name=None)
        parts.append(vc.select(F.lit(col).alias("column_name"), F.col(col).cast("string").alias("value"), "count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sponsor_readiness(apps: DataFrame, products: DataFrame, subs: DataFrame, *, key: str = "ApplNo",
                      sponsor: str = "SponsorName", status: str = "SubmissionStatus", approved: str = "AP",
                      priority: str = "ReviewPriority", priority_value: str = "PRIORITY", k: int = 10,
                      w_approval: float = 0.5, product_factor: float = 10.0, product_cap: float = 30.0,
                      w_priority: float = 0.2) -> DataFrame:
    """Readiness of the top-k sponsors by application count (P10): one
    grouped join instead of a per-sponsor scan loop (J7)."""
    from regula.functions.columns import truncate_label
    cnt = (apps.filter(F.col(sponsor).isNotNull()).groupBy(sponsor)
               .agg(F.count(F.lit(1)).alias("Applications")))
    top = cnt.orderBy(F.col("Applications").desc(), F.col(sponsor)).limit(k)
    sa = apps.select(key, sponsor).join(top.select(sponsor), sponsor, "left_semi").distinct()
    s = (subs.join(sa, key, "inner").groupBy(sponsor)
             .agg((F.avg(F.when(F.col(status) == approved, 1).otherwise(0)) * 100).alias("Approval_Rate"),
                  (F.avg(F.when(F.col(priority) == priority_value, 1).otherwise(0)) * 100).alias("Priority_Ratio")))
    pp = (products.join(sa, key, "inner").groupBy(sponsor, key).agg(F.count(F.lit(1)).alias("_np"))
                  .groupBy(sponsor).agg(F.avg("_np").alias("Avg_Products")))
    out = top.join(s, sponsor, "inner").join(pp, sponsor, "left")
    prod_part = F.when(F.col("Avg_Products") * product_factor > product_cap, F.lit(product_cap)) \
                 .otherwise(F.col("Avg_Products") * product_factor)
    score = F.col("Approval_Rate") * w_approval + prod_part + F.col("Priority_Ratio") * w_priority
    return out.select(truncate_label(sponsor, 20).alias("Sponsor"), sponsor, "Applications",
                      "Approval_Rate", "Avg_Products", "Priority_Ratio", score.alias("Readiness_Score"))
