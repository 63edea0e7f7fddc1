"""Registered ML feature tables and metrics with SQL oracles (M-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from regula.operators import clean as C
from regula.operators import ml_tables as M
from regula.plans.q_profile import _CLEAN_SUBS_SQL
from regula.plans.registry import register
from regula.plans.roles import roles, with_roles
from regula.sources.parquet import read_table

RECENT_YEAR = 1998          # the reference's ">= 2015" moved onto the data span
TYPES = ["F", "O", "P"]     # application types of the role view

_M1_SQL = _CLEAN_SUBS_SQL + """
, pc AS (SELECT ApplNo, count(ProductNo) AS ProductCount, count(DISTINCT Form) AS UniqueFormCount,
                count(DISTINCT ActiveIngredient) AS UniqueIngredientCount, CAST(sum(ReferenceDrug) AS BIGINT) AS ReferenceProductCount
         FROM products GROUP BY ApplNo)
, t AS (SELECT s.*, CAST(year(s.SubmissionStatusDate) AS INTEGER) AS Year, CAST(month(s.SubmissionStatusDate) AS INTEGER) AS Month,
               CAST(coalesce(s.SubmissionStatus = 'AP', false) AS INTEGER) AS IsApproved, a.ApplType, a.SponsorName,
               coalesce(pc.ProductCount, 0) AS ProductCount, coalesce(pc.UniqueFormCount, 0) AS UniqueFormCount,
               coalesce(pc.UniqueIngredientCount, 0) AS UniqueIngredientCount,
               coalesce(pc.ReferenceProductCount, 0) AS ReferenceProductCount
        FROM csubs s LEFT JOIN applications a ON s.ApplNo = a.ApplNo LEFT JOIN pc ON s.ApplNo = pc.ApplNo)
"""

_M2_SQL = _M1_SQL + f"""
, atc AS (SELECT ApplType, CAST(dense_rank() OVER (ORDER BY ApplType) - 1 AS INTEGER) AS ApplType_Encoded
         FROM (SELECT DISTINCT ApplType FROM t WHERE ApplType IS NOT NULL))
, rp AS (SELECT ReviewPriority, CAST(dense_rank() OVER (ORDER BY ReviewPriority) - 1 AS INTEGER) AS ReviewPriority_Encoded
         FROM (SELECT DISTINCT ReviewPriority FROM t WHERE ReviewPriority IS NOT NULL))
, sp AS (SELECT SponsorName, count(ApplNo) AS SponsorSubmissionCount, avg(IsApproved) AS SponsorApprovalRate
         FROM t WHERE SponsorName IS NOT NULL GROUP BY SponsorName)
, f0 AS (SELECT t.*, atc.ApplType_Encoded, rp.ReviewPriority_Encoded, sp.SponsorSubmissionCount, sp.SponsorApprovalRate,
                CAST(coalesce(t.Year >= {RECENT_YEAR}, false) AS INTEGER) AS IsRecentSubmission,
                CAST(coalesce(t.Month IN (10, 11, 12), false) AS INTEGER) AS IsQ4Submission
         FROM t LEFT JOIN atc ON t.ApplType = atc.ApplType LEFT JOIN rp ON t.ReviewPriority = rp.ReviewPriority
                LEFT JOIN sp ON t.SponsorName = sp.SponsorName)
, f AS (SELECT * FROM f0 WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in M.FEATURES + ["IsApproved"]) + ")\n"


def _training_table(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return M.approval_training_table(C.clean_table(subs, "submissions"), apps, prods)


def _features(spark, d):
    return M.approval_features(_training_table(spark, d), recent_year=RECENT_YEAR)


@register("M1_approval_training_table", sql=with_roles("applications", "products", "submissions") + _M1_SQL
          + "SELECT * FROM t")
def m1_table(spark, d):
    return _training_table(spark, d)


@register("M2_M3_approval_features", sql=with_roles("applications", "products", "submissions") + _M2_SQL
          + "SELECT * FROM f")
def m2_features(spark, d):
    return _features(spark, d)


@register("M6_auc_sponsor_rate_score", sql=with_roles("applications", "products", "submissions") + _M2_SQL + """
, r AS (SELECT IsApproved, rank() OVER (ORDER BY SponsorApprovalRate) AS rk,
               count(*) OVER (PARTITION BY SponsorApprovalRate) AS ties FROM f)
SELECT count(CASE WHEN IsApproved = 1 THEN 1 END) AS n_pos, count(CASE WHEN IsApproved = 0 THEN 1 END) AS n_neg,
       (sum(CASE WHEN IsApproved = 1 THEN rk + (ties - 1) / 2.0 END)
        - count(CASE WHEN IsApproved = 1 THEN 1 END) * (count(CASE WHEN IsApproved = 1 THEN 1 END) + 1) / 2.0)
       / (count(CASE WHEN IsApproved = 1 THEN 1 END)::DOUBLE * count(CASE WHEN IsApproved = 0 THEN 1 END)) AS auc
FROM r
""")
def m6_auc(spark, d):
    return M.auc(_features(spark, d), "SponsorApprovalRate", "IsApproved")


@register("M6_roc_sponsor_rate_score", sql=with_roles("applications", "products", "submissions") + _M2_SQL + """
, g AS (SELECT SponsorApprovalRate AS threshold, count(CASE WHEN IsApproved = 1 THEN 1 END) AS pos,
               count(CASE WHEN IsApproved = 0 THEN 1 END) AS neg FROM f GROUP BY 1)
SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC)::DOUBLE / sum(pos) OVER () AS tpr,
       sum(neg) OVER (ORDER BY threshold DESC)::DOUBLE / sum(neg) OVER () AS fpr FROM g
""")
def m6_roc(spark, d):
    return M.roc_points(_features(spark, d), "SponsorApprovalRate", "IsApproved")


@register("M14_approval_time_table", sql=with_roles("applications", "products", "submissions") + """
, t AS (SELECT ApplNo, date_diff('day', min(SubmissionStatusDate), max(SubmissionStatusDate)) AS DaysToApproval,
               CAST(coalesce(bool_or(ReviewPriority = 'PRIORITY'), false) AS INTEGER) AS HasPriority
        FROM submissions WHERE SubmissionStatus = 'AP' GROUP BY ApplNo)
, pc AS (SELECT ApplNo, count(*) AS ProductCount FROM products GROUP BY ApplNo)
SELECT a.ApplNo, t.DaysToApproval, t.HasPriority, pc.ProductCount,
       CAST(coalesce(a.ApplType = 'F', false) AS INTEGER) AS ApplType_F,
       CAST(coalesce(a.ApplType = 'O', false) AS INTEGER) AS ApplType_O,
       CAST(coalesce(a.ApplType = 'P', false) AS INTEGER) AS ApplType_P
FROM applications a JOIN t ON a.ApplNo = t.ApplNo LEFT JOIN pc ON a.ApplNo = pc.ApplNo
WHERE t.DaysToApproval BETWEEN 0 AND 3650
""")
def m14_table(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return M.approval_time_table(subs, apps, prods, TYPES)


_M15_SQL = with_roles("applications", "products", "submissions") + """
, a AS (SELECT ApplNo, SponsorName FROM applications WHERE SponsorName IS NOT NULL)
, base AS (SELECT SponsorName, count(ApplNo) AS TotalApplications FROM a GROUP BY 1)
, ps AS (SELECT a.SponsorName, count(p.ProductNo) AS TotalProducts, count(DISTINCT p.Form) AS UniqueForms,
                count(DISTINCT p.ActiveIngredient) AS UniqueIngredients, CAST(sum(p.ReferenceDrug) AS BIGINT) AS ReferenceProducts
         FROM products p JOIN a ON p.ApplNo = a.ApplNo GROUP BY 1)
, ss AS (SELECT a.SponsorName, count(s.SubmissionNo) AS TotalSubmissions,
                count(CASE WHEN s.SubmissionStatus = 'AP' THEN 1 END) AS ApprovedSubmissions,
                count(CASE WHEN s.ReviewPriority = 'PRIORITY' THEN 1 END) AS PriorityReviews,
                CAST(min(year(s.SubmissionStatusDate)) AS INTEGER) AS FirstYear,
                CAST(max(year(s.SubmissionStatusDate)) AS INTEGER) AS LastYear
         FROM submissions s JOIN a ON s.ApplNo = a.ApplNo GROUP BY 1)
, f AS (SELECT b.SponsorName, b.TotalApplications, ps.TotalProducts, ps.UniqueForms, ps.UniqueIngredients, ps.ReferenceProducts,
               ss.TotalSubmissions, ss.ApprovedSubmissions, ss.PriorityReviews, ss.FirstYear, ss.LastYear,
               ss.ApprovedSubmissions::DOUBLE / nullif(ss.TotalSubmissions, 0) AS ApprovalRate,
               ps.TotalProducts::DOUBLE / nullif(b.TotalApplications, 0) AS ProductsPerApplication,
               ss.LastYear - ss.FirstYear + 1 AS YearsActive
        FROM base b LEFT JOIN ps ON b.SponsorName = ps.SponsorName LEFT JOIN ss ON b.SponsorName = ss.SponsorName
        WHERE b.TotalApplications >= 5)
SELECT SponsorName, TotalApplications, coalesce(TotalProducts, 0) AS TotalProducts, coalesce(UniqueForms, 0) AS UniqueForms,
       coalesce(UniqueIngredients, 0) AS UniqueIngredients, coalesce(ReferenceProducts, 0) AS ReferenceProducts,
       coalesce(TotalSubmissions, 0) AS TotalSubmissions, coalesce(ApprovedSubmissions, 0) AS ApprovedSubmissions,
       coalesce(PriorityReviews, 0) AS PriorityReviews, coalesce(FirstYear, 0) AS FirstYear, coalesce(LastYear, 0) AS LastYear,
       coalesce(ApprovalRate, 0.0) AS ApprovalRate, coalesce(ProductsPerApplication, 0.0) AS ProductsPerApplication,
       CAST(coalesce(YearsActive, 0) AS INTEGER) AS YearsActive,
       coalesce(TotalSubmissions::DOUBLE / nullif(YearsActive, 0), 0.0) AS SubmissionsPerYear,
       coalesce(PriorityReviews::DOUBLE / nullif(TotalSubmissions, 0), 0.0) AS PriorityRate
FROM f
"""


@register("M15_sponsor_features", sql=_M15_SQL)
def m15_sponsor(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return M.sponsor_features(apps, prods, subs)


@register("M20_drug_features", sql=with_roles("applications", "products", "submissions") + """
, s AS (SELECT ApplNo, count(SubmissionNo) AS TotalSubmissions,
               CAST(coalesce(bool_or(SubmissionStatus = 'AP'), false) AS INTEGER) AS IsApproved,
               CAST(coalesce(bool_or(ReviewPriority = 'PRIORITY'), false) AS INTEGER) AS HadPriorityReview
        FROM submissions GROUP BY ApplNo)
SELECT p.ApplNo, p.ProductNo, s.TotalSubmissions, s.IsApproved, s.HadPriorityReview,
       coalesce(p.ReferenceDrug, 0) AS IsReferenceDrug,
       CAST(coalesce(p.ReferenceStandard IS NOT NULL AND p.ReferenceStandard <> '' AND p.ReferenceStandard <> '0', false) AS INTEGER)
         AS HasReferenceStandard,
       CAST(coalesce(a.ApplType = 'F', false) AS INTEGER) AS ApplType_F,
       CAST(coalesce(a.ApplType = 'O', false) AS INTEGER) AS ApplType_O,
       CAST(coalesce(a.ApplType = 'P', false) AS INTEGER) AS ApplType_P
FROM products p LEFT JOIN applications a ON p.ApplNo = a.ApplNo JOIN s ON p.ApplNo = s.ApplNo
""")
def m20_drug(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return M.drug_features(prods, apps, subs, TYPES)


_EMB_SQL = """
WITH e AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS v,
                  CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings)
, c AS (SELECT label, pos, avg(v) AS m FROM e GROUP BY label, pos)
"""


@register("M19_davies_bouldin_embeddings", sql=_EMB_SQL + """
, dist AS (SELECT e.label, e.vec_id, sqrt(sum((e.v - c.m) * (e.v - c.m))) AS dd
           FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY e.label, e.vec_id)
, s AS (SELECT label, avg(dd) AS s FROM dist GROUP BY label)
, cd AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d
         FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY 1, 2)
, r AS (SELECT cd.la, max((sa.s + sb.s) / cd.d) AS mr FROM cd JOIN s sa ON cd.la = sa.label JOIN s sb ON cd.lb = sb.label
        GROUP BY cd.la)
SELECT avg(mr) AS davies_bouldin, count(*) AS n_clusters FROM r
""")
def m19_db(spark, d):
    return M.davies_bouldin(read_table(spark, d, "embeddings"), "embedding", "label")


@register("M21_cluster_sizes_embeddings", sql="""
WITH g AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label)
SELECT label, size, size::DOUBLE / (SELECT sum(size) FROM g) * 100 AS pct FROM g WHERE label IS NOT NULL
""")
def m21_sizes(spark, d):
    return M.cluster_sizes(read_table(spark, d, "embeddings"), "label")


@register("M21_cluster_vector_means_embeddings", sql=_EMB_SQL + "SELECT label, pos AS position, m AS mean FROM c")
def m21_means(spark, d):
    return M.cluster_vector_means(read_table(spark, d, "embeddings"), "embedding", "label")


def _sponsor_types_sql() -> str:
    body = _M15_SQL.rstrip()
    head, tail = body[:body.rindex("SELECT SponsorName, TotalApplications")], body[body.rindex("SELECT SponsorName, TotalApplications"):]
    return head + f""", sf AS ({tail})
, n AS (SELECT SponsorName, ApplType, count(*) AS n FROM applications WHERE SponsorName IS NOT NULL GROUP BY 1, 2)
, t AS (SELECT SponsorName, ApplType AS cluster FROM n QUALIFY row_number() OVER (PARTITION BY SponsorName ORDER BY n DESC, ApplType NULLS FIRST) = 1)
, l AS (SELECT sf.*, t.cluster FROM sf JOIN t ON sf.SponsorName = t.SponsorName)
"""


def _sponsor_types(spark, d):
    """Sponsor features labelled with the most frequent application type."""
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    f = M.sponsor_features(apps, prods, subs)
    t = (apps.filter(F.col("SponsorName").isNotNull()).groupBy("SponsorName", "ApplType").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy("SponsorName").agg(F.min(F.struct(-F.col("_n"), F.col("ApplType"))).getField("ApplType").alias("cluster")))
    return f.join(t, "SponsorName")


@register("M21_sponsor_cluster_profile_by_type", sql=_sponsor_types_sql() + """
SELECT cluster, avg(TotalApplications) AS "mean_TotalApplications", avg(ApprovalRate) AS "mean_ApprovalRate",
       avg(PriorityRate) AS "mean_PriorityRate" FROM l GROUP BY cluster
""")
def m21_profile(spark, d):
    """Cluster profile over sponsor features with a given label column
    (here: the sponsor's most frequent application type)."""
    return M.cluster_means(_sponsor_types(spark, d), "cluster", ["TotalApplications", "ApprovalRate", "PriorityRate"])


@register("M21_sponsor_cluster_top_members", sql=_sponsor_types_sql() + """
SELECT cluster, SponsorName, TotalApplications, CAST(row_number() OVER (PARTITION BY cluster ORDER BY TotalApplications DESC, SponsorName) AS INTEGER) AS rank
FROM l QUALIFY rank <= 3
""")
def m21_members(spark, d):
    return M.cluster_top_members(_sponsor_types(spark, d), "cluster", "SponsorName", "TotalApplications")


_DRUGS_SQL = with_roles("applications", "products", "submissions") + """
, s AS (SELECT ApplNo, max(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) AS IsApproved,
               max(CASE WHEN ReviewPriority = 'PRIORITY' THEN 1 ELSE 0 END) AS HadPriorityReview FROM submissions GROUP BY ApplNo)
, l AS (SELECT p.ApplNo % 5 AS cluster, p.Form, a.ApplType, s.IsApproved, s.HadPriorityReview
        FROM products p LEFT JOIN applications a ON p.ApplNo = a.ApplNo JOIN s ON p.ApplNo = s.ApplNo)
"""


def _mix_sql(category: str, k: int | None) -> str:
    return _DRUGS_SQL + f"""
, n AS (SELECT cluster, {category}, count(*) AS n FROM l WHERE {category} IS NOT NULL GROUP BY 1, 2)
SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY cluster) * 100 AS pct,
       CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, {category}) AS INTEGER) AS rank
FROM n QUALIFY rank <= {k or 1 << 30}
"""


def labelled_drugs(spark, d):
    """Drugs (product rows) with form, type, approval and priority flags."""
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return M.drug_features(prods, apps, subs, TYPES, carry=("Form", "DrugName", "ApplType"))


@register("M21_drug_cluster_top_forms", sql=_mix_sql("Form", 3))
def m21_forms(spark, d):
    """Top forms per cluster for a given label (here: a residue of the key)."""
    return M.cluster_category_mix(labelled_drugs(spark, d).withColumn("cluster", F.col("ApplNo") % 5), "cluster", "Form", 3)


@register("M21_drug_cluster_type_mix", sql=_mix_sql("ApplType", None))
def m21_types(spark, d):
    return M.cluster_category_mix(labelled_drugs(spark, d).withColumn("cluster", F.col("ApplNo") % 5), "cluster", "ApplType")


@register("M21_drug_cluster_rates", sql=_DRUGS_SQL + """
SELECT cluster, avg(IsApproved) AS "mean_IsApproved", avg(HadPriorityReview) AS "mean_HadPriorityReview" FROM l GROUP BY cluster
""")
def m21_rates(spark, d):
    return M.cluster_means(labelled_drugs(spark, d).withColumn("cluster", F.col("ApplNo") % 5), "cluster", ["IsApproved", "HadPriorityReview"])
