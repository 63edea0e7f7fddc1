"""Registered domain reports (R-series)."""

from __future__ import annotations

from regula.operators import reports as R
from regula.plans.registry import register
from regula.plans.roles import roles, with_roles


@register("R3_sponsor_performance_top20", sql=with_roles("applications", "products", "submissions") + """
, base AS (SELECT SponsorName, count(ApplNo) AS Total_Applications
           FROM applications WHERE SponsorName IS NOT NULL GROUP BY SponsorName)
, prod AS (SELECT a.SponsorName, count(p.ProductNo) AS Total_Products
           FROM products p LEFT JOIN applications a ON p.ApplNo = a.ApplNo GROUP BY a.SponsorName)
, subm AS (SELECT a.SponsorName, count(s.SubmissionNo) AS Total_Submissions,
                  count_if(s.SubmissionStatus = 'AP') AS Approved_Submissions
           FROM submissions s LEFT JOIN applications a ON s.ApplNo = a.ApplNo GROUP BY a.SponsorName)
, st AS (SELECT b.SponsorName, b.Total_Applications, p.Total_Products, s.Total_Submissions,
                s.Approved_Submissions,
                round_even(s.Approved_Submissions::DOUBLE / s.Total_Submissions * 100, 1) AS Approval_Rate
         FROM base b LEFT JOIN prod p ON b.SponsorName = p.SponsorName
                     LEFT JOIN subm s ON b.SponsorName = s.SponsorName)
SELECT * FROM (SELECT * FROM st ORDER BY Total_Applications DESC, SponsorName LIMIT 20)
WHERE SponsorName NOT IN ('', 'UNKNOWN')
""")
def r3_sponsor_performance(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return R.top_sponsors(R.sponsor_performance(apps, prods, subs))


# Year limits of the reference (2010-2024, 2000-2023, 1990-2024) moved onto
# the synthetic data's span (1995-01 .. 2001-11).
YEARS_A = (1996, 2001)
YEARS_B = (1995, 2000)
YEARS_C = (1990, 2024)


@register("R1_status_distribution", sql=with_roles("submissions") + """
, g AS (SELECT SubmissionStatus, count(*) AS count FROM submissions GROUP BY SubmissionStatus)
SELECT SubmissionStatus, count, count::DOUBLE / (SELECT sum(count) FROM g) * 100 AS pct
FROM g WHERE SubmissionStatus IS NOT NULL
""")
def r1_status(spark, d):
    from regula.operators.relational import value_counts
    (subs,) = roles(spark, d, "submissions")
    return value_counts(subs, "SubmissionStatus")


@register("R1_overall_approval_rate", sql=with_roles("submissions") + """
SELECT count(*) AS total_submissions, count_if(SubmissionStatus = 'AP') AS approved,
       avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) * 100 AS approval_rate_pct
FROM submissions
""")
def r1_overall(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return R.overall_approval(subs)


@register("R2_priority_distribution", sql=with_roles("submissions") + """
, g AS (SELECT ReviewPriority, count(*) AS count FROM submissions GROUP BY ReviewPriority)
SELECT ReviewPriority, count, count::DOUBLE / (SELECT sum(count) FROM g) * 100 AS pct
FROM g WHERE ReviewPriority IS NOT NULL
""")
def r2_priority(spark, d):
    from regula.operators.relational import value_counts
    (subs,) = roles(spark, d, "submissions")
    return value_counts(subs, "ReviewPriority")


@register("R2_approval_by_priority", sql=with_roles("submissions") + """
SELECT ReviewPriority, count(*) AS n, avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) AS approval_rate
FROM submissions WHERE ReviewPriority IN ('PRIORITY', 'STANDARD') GROUP BY ReviewPriority
""")
def r2_approval_by_priority(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return R.approval_by(subs, "ReviewPriority", levels=("PRIORITY", "STANDARD"))


@register("R3_sponsor_summary", sql=with_roles("applications") + """
, s AS (SELECT SponsorName, count(ApplNo) AS apps FROM applications WHERE SponsorName IS NOT NULL GROUP BY 1)
SELECT count(*) AS unique_sponsors, avg(apps) AS mean_apps, median(apps) AS median_apps,
       stddev_samp(apps) AS std_apps
FROM s
""")
def r3_summary(spark, d):
    from pyspark.sql import functions as F
    (apps,) = roles(spark, d, "applications")
    s = apps.filter(F.col("SponsorName").isNotNull()).groupBy("SponsorName").agg(F.count("ApplNo").alias("apps"))
    from regula.operators.relational import distribution_stats
    return distribution_stats(s, "apps").select(F.col("n").alias("unique_sponsors"), F.col("mean").alias("mean_apps"),
                                                F.col("median").alias("median_apps"), F.col("std").alias("std_apps"))


@register("R4_form_top15", sql=with_roles("products") + """
, g AS (SELECT Form, count(*) AS count FROM products GROUP BY Form)
SELECT * FROM (SELECT Form, count, count::DOUBLE / (SELECT sum(count) FROM g) * 100 AS pct
               FROM g WHERE Form IS NOT NULL ORDER BY count DESC, Form LIMIT 15)
WHERE Form <> ''
""")
def r4_forms(spark, d):
    from pyspark.sql import functions as F

    from regula.operators.relational import value_counts
    (prods,) = roles(spark, d, "products")
    return value_counts(prods, "Form", k=15).filter(F.col("Form") != "")


@register("R4_form_diversity", sql=with_roles("products") + """
, g AS (SELECT Form, count(*) AS n FROM products WHERE Form IS NOT NULL GROUP BY Form)
SELECT count(*) AS unique_forms, count_if(n > 100) AS forms_over_100, count_if(n > 1000) AS forms_over_1000 FROM g
""")
def r4_diversity(spark, d):
    (prods,) = roles(spark, d, "products")
    return R.form_diversity(prods)


@register("R5_reference_drug_share", sql=with_roles("products") + """
SELECT count_if(ReferenceDrug = 1) AS reference_drugs, count_if(ReferenceDrug = 0) AS non_reference_drugs,
       count_if(ReferenceDrug = 1)::DOUBLE / count(*) * 100 AS reference_pct
FROM products
""")
def r5_reference(spark, d):
    (prods,) = roles(spark, d, "products")
    return R.reference_drug_share(prods)


@register("R6_ingredient_complexity", sql=with_roles("products") + """
, p AS (SELECT coalesce(contains(upper(trim(ActiveIngredient)), ';'), false) AS comb FROM products)
SELECT count(*) - count_if(comb) AS single_products, count_if(comb) AS combination_products,
       count_if(comb)::DOUBLE / count(*) * 100 AS combination_pct
FROM p
""")
def r6_complexity(spark, d):
    (prods,) = roles(spark, d, "products")
    return R.ingredient_complexity(prods)


@register("R6_top_single_ingredients", sql=with_roles("products") + """
, p AS (SELECT upper(trim(ActiveIngredient)) AS ActiveIngredient_Clean FROM products
        WHERE NOT coalesce(contains(upper(trim(ActiveIngredient)), ';'), false))
, g AS (SELECT ActiveIngredient_Clean, count(*) AS products FROM p GROUP BY 1)
SELECT * FROM (SELECT ActiveIngredient_Clean, products, products::DOUBLE / (SELECT sum(products) FROM g) * 100 AS pct
               FROM g WHERE ActiveIngredient_Clean IS NOT NULL ORDER BY products DESC, ActiveIngredient_Clean LIMIT 20)
WHERE ActiveIngredient_Clean <> ''
""")
def r6_top(spark, d):
    (prods,) = roles(spark, d, "products")
    return R.top_single_ingredients(prods)


@register("R7_products_per_application", sql=with_roles("products") + """
, g AS (SELECT ApplNo, count(*) AS s FROM products WHERE ApplNo IS NOT NULL GROUP BY ApplNo)
SELECT count(s) AS n, avg(s) AS mean, stddev_samp(s) AS std, min(s) AS min, max(s) AS max, median(s) AS median FROM g
""")
def r7_products(spark, d):
    from regula.operators.relational import group_size_stats
    (prods,) = roles(spark, d, "products")
    return group_size_stats(prods, "ApplNo")


@register("R7_submissions_per_application", sql=with_roles("submissions") + """
, g AS (SELECT ApplNo, count(*) AS s FROM submissions WHERE ApplNo IS NOT NULL GROUP BY ApplNo)
SELECT count(s) AS n, avg(s) AS mean, stddev_samp(s) AS std, min(s) AS min, max(s) AS max, median(s) AS median FROM g
""")
def r7_subs(spark, d):
    from regula.operators.relational import group_size_stats
    (subs,) = roles(spark, d, "submissions")
    return group_size_stats(subs, "ApplNo")


@register("R8_dataset_overview", sql=with_roles("applications", "products", "submissions") + """
SELECT (SELECT count(*) FROM applications) AS total_applications,
       (SELECT count(DISTINCT SponsorName) FROM applications) AS unique_sponsors,
       (SELECT count(*) FROM products) AS total_products,
       (SELECT count(DISTINCT DrugName) FROM products) AS unique_drug_names,
       (SELECT count(DISTINCT Form) FROM products) AS unique_forms,
       (SELECT count(*) FROM submissions) AS total_submissions,
       (SELECT avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) FROM submissions) AS approval_rate,
       (SELECT count(DISTINCT ApplNo) FROM submissions) AS applications_with_submissions,
       (SELECT SubmissionStatus FROM submissions WHERE SubmissionStatus IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_status
""")
def r8_overview(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return R.dataset_overview(apps, prods, subs)


@register("R9_approval_by_application_type", sql=with_roles("applications", "submissions") + """
SELECT a.ApplType, count(*) AS n, avg(CASE WHEN s.SubmissionStatus = 'AP' THEN 1 ELSE 0 END) AS approval_rate
FROM submissions s JOIN applications a ON s.ApplNo = a.ApplNo
WHERE a.ApplType IS NOT NULL GROUP BY a.ApplType
""")
def r9_by_type(spark, d):
    apps, subs = roles(spark, d, "applications", "submissions")
    j = subs.join(apps.select("ApplNo", "ApplType"), "ApplNo", "inner")
    return R.approval_by(j, "ApplType")


@register("R9_approval_by_priority_all", sql=with_roles("submissions") + """
SELECT ReviewPriority, count(*) AS n, avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) AS approval_rate
FROM submissions WHERE ReviewPriority IS NOT NULL GROUP BY ReviewPriority
""")
def r9_by_priority(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return R.approval_by(subs, "ReviewPriority")


@register("R10_top_sponsor_drug_pairs", sql=with_roles("applications", "products") + """
, g AS (SELECT a.SponsorName, p.DrugName, count(*) AS products
        FROM products p JOIN applications a ON p.ApplNo = a.ApplNo
        WHERE a.SponsorName IS NOT NULL AND p.DrugName IS NOT NULL GROUP BY 1, 2
        ORDER BY products DESC, SponsorName, DrugName LIMIT 10)
SELECT *, (CASE WHEN length(SponsorName) > 20 THEN substr(SponsorName, 1, 20) || '...' ELSE SponsorName END)
          || ' - ' ||
          (CASE WHEN length(DrugName) > 20 THEN substr(DrugName, 1, 20) || '...' ELSE DrugName END) AS label
FROM g
""")
def r10_pairs(spark, d):
    apps, prods = roles(spark, d, "applications", "products")
    return R.sponsor_drug_pairs(apps, prods)


@register("R11_kpi_row", sql=with_roles("applications", "products", "submissions") + """
, t AS (SELECT ApplNo, date_diff('day', min(SubmissionStatusDate), max(SubmissionStatusDate)) AS d
        FROM submissions WHERE SubmissionStatus = 'AP' AND SubmissionStatusDate IS NOT NULL GROUP BY ApplNo)
SELECT (SELECT count(DISTINCT ApplNo) FROM applications) AS total_applications,
       (SELECT count(*) FROM products) AS total_products,
       (SELECT avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) * 100 FROM submissions) AS approval_rate_pct,
       (SELECT avg(d) FROM t WHERE d BETWEEN 0 AND 3650) AS avg_days_to_approval
""")
def r11_kpi(spark, d):
    from regula.operators.timeseries import approval_timelines
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return R.kpi_row(apps, prods, subs, approval_timelines(subs))


@register("R12_top15_sponsors_by_type", sql=with_roles("applications") + """
, f AS (SELECT * FROM applications WHERE ApplType = 'F')
, g AS (SELECT SponsorName, count(*) AS count FROM f GROUP BY SponsorName)
SELECT SponsorName, count FROM g WHERE SponsorName IS NOT NULL ORDER BY count DESC, SponsorName LIMIT 15
""")
def r12_top_sponsors(spark, d):
    from regula.operators.relational import optional_filters, value_counts
    (apps,) = roles(spark, d, "applications")
    f = optional_filters(apps, equals={"ApplType": "F"})
    return value_counts(f, "SponsorName", k=15, pct_name=None)


@register("R12_top15_sponsors_all", sql=with_roles("applications") + """
, g AS (SELECT SponsorName, count(*) AS count FROM applications GROUP BY SponsorName)
SELECT SponsorName, count FROM g WHERE SponsorName IS NOT NULL ORDER BY count DESC, SponsorName LIMIT 15
""")
def r12_top_sponsors_all(spark, d):
    from regula.operators.relational import optional_filters, value_counts
    (apps,) = roles(spark, d, "applications")
    f = optional_filters(apps, equals={"ApplType": "all"})
    return value_counts(f, "SponsorName", k=15, pct_name=None)


@register("R13_explorer_summary", sql=with_roles("applications", "products", "submissions") + """
SELECT (SELECT count(DISTINCT ApplNo) FROM applications) AS total_applications,
       (SELECT count(DISTINCT SponsorName) FROM applications) AS unique_sponsors,
       (SELECT ApplType FROM applications WHERE ApplType IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_type,
       (SELECT count(*) FROM applications WHERE ApplNo IN (SELECT ApplNo FROM products)) AS applications_with_products,
       (SELECT count(*) FROM products) AS total_products,
       (SELECT count(DISTINCT DrugName) FROM products) AS unique_drug_names,
       (SELECT count_if(ReferenceDrug = 1) FROM products) AS reference_drugs,
       (SELECT Form FROM products WHERE Form IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_form,
       (SELECT count(*) FROM submissions) AS total_submissions,
       (SELECT count_if(SubmissionStatus = 'AP') FROM submissions) AS approved,
       (SELECT avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) * 100 FROM submissions) AS approval_rate_pct,
       (SELECT count_if(ReviewPriority = 'PRIORITY') FROM submissions) AS priority_reviews
""")
def r13_explorer(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return R.explorer_summary(apps, prods, subs)


@register("R14_portfolio_summary", sql=with_roles("applications", "submissions") + """
, pa AS (SELECT ApplNo, count(*) AS n, sum(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) AS ap
         FROM submissions GROUP BY ApplNo)
, sp AS (SELECT a.SponsorName, sum(pa.n) AS n, sum(pa.ap) AS ap
         FROM (SELECT DISTINCT ApplNo, SponsorName FROM applications WHERE SponsorName IS NOT NULL) a
         JOIN pa ON a.ApplNo = pa.ApplNo GROUP BY a.SponsorName HAVING sum(pa.n) > 10)
, best AS (SELECT SponsorName, ap::DOUBLE / n AS r FROM sp ORDER BY r DESC, SponsorName LIMIT 1)
SELECT (SELECT count(DISTINCT ApplNo) FROM applications) AS total_applications,
       (SELECT count(DISTINCT SponsorName) FROM applications) AS total_sponsors,
       (SELECT avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) * 100 FROM submissions) AS approval_rate_pct,
       (SELECT avg(CASE WHEN ReviewPriority = 'PRIORITY' THEN 1 ELSE 0 END) * 100 FROM submissions) AS priority_rate_pct,
       coalesce((SELECT avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) * 100 FROM submissions
                 WHERE year(SubmissionStatusDate) >= 2000),
                (SELECT avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) * 100 FROM submissions)) AS recent_approval_rate_pct,
       (SELECT SponsorName FROM best) AS top_performer,
       (SELECT r FROM best) AS top_performer_approval_rate
""")
def r14_portfolio(spark, d):
    apps, subs = roles(spark, d, "applications", "submissions")
    return R.portfolio_summary(apps, subs, recent_year=2000)


@register("R15_risk_radar_inputs", sql=with_roles("applications", "submissions") + """
, k AS (SELECT (SELECT count(*) FROM applications) AS total_applications,
               (SELECT avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) FROM submissions) AS approval_rate)
SELECT total_applications, approval_rate,
       CASE WHEN total_applications > 20000 THEN 80 ELSE 70 END AS data_quality_score,
       CASE WHEN approval_rate < 0.95 THEN 80 ELSE 90 END AS compliance_score
FROM k
""")
def r15_radar(spark, d):
    from pyspark.sql import functions as F
    apps, subs = roles(spark, d, "applications", "submissions")
    a = apps.agg(F.count(F.lit(1)).alias("total_applications"))
    s = subs.agg(F.avg(F.when(F.col("SubmissionStatus") == "AP", 1).otherwise(0)).alias("approval_rate"))
    k = a.crossJoin(s)
    return k.select("total_applications", "approval_rate",
                    F.when(F.col("total_applications") > 20000, 80).otherwise(70).alias("data_quality_score"),
                    F.when(F.col("approval_rate") < 0.95, 80).otherwise(90).alias("compliance_score"))


@register("R16_univariate_panel", sql=with_roles("applications", "products", "submissions", "marketing_status") + """
, t AS (SELECT 'ApplType' AS column_name, CAST(ApplType AS VARCHAR) AS value, count(*) AS count FROM applications WHERE ApplType IS NOT NULL GROUP BY 2)
, s AS (SELECT 'SubmissionStatus' AS column_name, SubmissionStatus AS value, count(*) AS count FROM submissions WHERE SubmissionStatus IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
, p AS (SELECT 'ReviewPriority' AS column_name, ReviewPriority AS value, count(*) AS count FROM submissions WHERE ReviewPriority IS NOT NULL GROUP BY 2)
, f AS (SELECT 'Form' AS column_name, Form AS value, count(*) AS count FROM products WHERE Form IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 15)
, r AS (SELECT 'ReferenceDrug' AS column_name, CAST(ReferenceDrug AS VARCHAR) AS value, count(*) AS count FROM products WHERE ReferenceDrug IS NOT NULL GROUP BY 2)
, m AS (SELECT 'MarketingStatusID' AS column_name, CAST(MarketingStatusID AS VARCHAR) AS value, count(*) AS count FROM marketing_status WHERE MarketingStatusID IS NOT NULL GROUP BY 2)
, sp AS (SELECT 'SponsorName' AS column_name, SponsorName AS value, count(*) AS count FROM applications WHERE SponsorName IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
SELECT * FROM t UNION ALL SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM f
UNION ALL SELECT * FROM r UNION ALL SELECT * FROM m UNION ALL SELECT * FROM sp
""")
def r16_panel(spark, d):
    apps, prods, subs, ms = roles(spark, d, "applications", "products", "submissions", "marketing_status")
    return R.univariate_panel(apps, prods, subs, ms)


@register("P10_sponsor_readiness", sql=with_roles("applications", "products", "submissions") + """
, top AS (SELECT SponsorName, count(*) AS Applications FROM applications WHERE SponsorName IS NOT NULL
          GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
, sa AS (SELECT DISTINCT a.ApplNo, a.SponsorName FROM applications a JOIN top t ON a.SponsorName = t.SponsorName)
, s AS (SELECT sa.SponsorName, avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) * 100 AS Approval_Rate,
               avg(CASE WHEN ReviewPriority = 'PRIORITY' THEN 1 ELSE 0 END) * 100 AS Priority_Ratio
        FROM submissions x JOIN sa ON x.ApplNo = sa.ApplNo GROUP BY 1)
, pp AS (SELECT SponsorName, avg(np) AS Avg_Products FROM
           (SELECT sa.SponsorName, p.ApplNo, count(*) AS np FROM products p JOIN sa ON p.ApplNo = sa.ApplNo GROUP BY 1, 2) GROUP BY 1)
SELECT CASE WHEN length(t.SponsorName) > 20 THEN substr(t.SponsorName, 1, 20) || '...' ELSE t.SponsorName END AS Sponsor,
       t.SponsorName, t.Applications, s.Approval_Rate, pp.Avg_Products, s.Priority_Ratio,
       s.Approval_Rate * 0.5 + CASE WHEN pp.Avg_Products * 10 > 30 THEN 30 ELSE pp.Avg_Products * 10 END
       + s.Priority_Ratio * 0.2 AS Readiness_Score
FROM top t JOIN s ON t.SponsorName = s.SponsorName LEFT JOIN pp ON t.SponsorName = pp.SponsorName
""")
def p10_readiness(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return R.sponsor_readiness(apps, prods, subs)
