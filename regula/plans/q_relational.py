"""Registered relational building blocks not covered by a report
(A21, F10, K5, U1-U3) and the one-row summary statistics (S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from regula.operators import keysets as K
from regula.operators import relational as R
from regula.plans.registry import register
from regula.plans.roles import roles, with_roles


def _size_hist_sql(table: str, max_size: int) -> str:
    return with_roles(table) + f"""
, g AS (SELECT ApplNo, count(*) AS s FROM {table} WHERE ApplNo IS NOT NULL GROUP BY ApplNo HAVING count(*) <= {max_size})
, r AS (SELECT min(s)::DOUBLE AS lo, max(s)::DOUBLE AS hi FROM g)
, r2 AS (SELECT lo, hi, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS a, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS b FROM r)
, b AS (SELECT CAST(least(greatest(floor((s - a) / (b - a) * {max_size}), 0), {max_size - 1}) AS INTEGER) AS bin, count(*) AS c
        FROM g, r2 GROUP BY 1)
SELECT s.bin, a + s.bin * CASE WHEN lo = hi THEN 1.0 ELSE (hi - lo) / {max_size} END AS bin_start,
       a + (s.bin + 1) * CASE WHEN lo = hi THEN 1.0 ELSE (hi - lo) / {max_size} END AS bin_end, coalesce(b.c, 0) AS count
FROM (SELECT CAST(unnest(range(0, {max_size})) AS INTEGER) AS bin) s CROSS JOIN r2 LEFT JOIN b ON s.bin = b.bin
"""


@register("A21_products_per_application_histogram", sql=_size_hist_sql("products", 20))
def a21_products(spark, d):
    (p,) = roles(spark, d, "products")
    return R.size_histogram(p, "ApplNo", 20, 20)


@register("A21_submissions_per_application_histogram", sql=_size_hist_sql("submissions", 30))
def a21_subs(spark, d):
    (s,) = roles(spark, d, "submissions")
    return R.size_histogram(s, "ApplNo", 30, 30)


_PAGE_ORDER = ["SubmissionStatusDate", "ApplNo", "SubmissionNo", "SubmissionClassCodeID", "SubmissionStatus",
               "ReviewPriority"]


@register("F10_table_view_page", sql=with_roles("submissions") + """
SELECT * FROM (SELECT * FROM submissions WHERE SubmissionStatus = 'WD' AND ReviewPriority = 'PRIORITY'
               ORDER BY SubmissionStatusDate DESC, ApplNo, SubmissionNo, SubmissionClassCodeID NULLS FIRST,
                        SubmissionStatus, ReviewPriority LIMIT 100)
ORDER BY SubmissionStatusDate DESC, ApplNo, SubmissionNo, SubmissionClassCodeID NULLS FIRST, SubmissionStatus, ReviewPriority
LIMIT 20 OFFSET 20
""")
def f10_page(spark, d):
    """Table view (F10): dynamic filter, multi-column sort, second page of 20
    (of the first 100 rows), read from the last key of the first page on."""
    (s,) = roles(spark, d, "submissions")
    f = R.optional_filters(s, equals={"SubmissionStatus": "WD", "ReviewPriority": "PRIORITY"})
    order = [(c, c == "SubmissionStatusDate") for c in _PAGE_ORDER]
    return K.page_after(f, order, 20, K.last_key(K.page_after(f, order, 20), order))


@register("K5_top3_forms_per_application_type", sql=with_roles("applications", "products") + """
, g AS (SELECT a.ApplType, p.Form, count(*) AS products FROM products p JOIN applications a ON p.ApplNo = a.ApplNo
        WHERE a.ApplType IS NOT NULL AND p.Form IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ApplType ORDER BY products DESC, Form) AS INTEGER) AS rank FROM g)
WHERE rank <= 3
""")
def k5_top_forms(spark, d):
    apps, prods = roles(spark, d, "applications", "products")
    g = (prods.join(apps.select("ApplNo", "ApplType"), "ApplNo", "inner")
              .filter(F.col("ApplType").isNotNull() & F.col("Form").isNotNull())
              .groupBy("ApplType", "Form").agg(F.count(F.lit(1)).alias("products")))
    return R.top_k_per_group(g, "ApplType", 3, [F.col("products").desc(), F.col("Form")])


@register("U1_U2_U3_application_key_sets", sql=with_roles("applications", "submissions") + """
SELECT (SELECT count(*) FROM (SELECT DISTINCT ApplNo FROM applications)) AS distinct_applications,
       (SELECT count(*) FROM (SELECT ApplNo FROM applications INTERSECT SELECT ApplNo FROM submissions)) AS in_both,
       (SELECT count(*) FROM (SELECT ApplNo FROM applications EXCEPT SELECT ApplNo FROM submissions)) AS applications_only,
       (SELECT count(*) FROM (SELECT ApplNo FROM submissions EXCEPT SELECT ApplNo FROM applications)) AS submissions_only
""")
def u_sets(spark, d):
    apps, subs = roles(spark, d, "applications", "submissions")
    one = K.key_overlaps({"applications": (apps, "ApplNo"), "submissions": (subs, "ApplNo")}, dense=True)
    return one.select(F.col("left_keys").alias("distinct_applications"), "in_both",
                      (F.col("left_keys") - F.col("in_both")).alias("applications_only"),
                      (F.col("right_keys") - F.col("in_both")).alias("submissions_only"))


@register("S10_eda_summary_statistics", sql=with_roles("applications", "products", "submissions") + """
SELECT (SELECT count(*) FROM applications) AS total_applications,
       (SELECT count(*) FROM products) AS total_products,
       (SELECT count(*) FROM submissions) AS total_submissions,
       (SELECT count(DISTINCT SponsorName) FROM applications) AS unique_sponsors,
       (SELECT count(DISTINCT Form) FROM products) AS unique_forms,
       (SELECT avg(CASE WHEN SubmissionStatus = 'AP' THEN 1 ELSE 0 END) FROM submissions) AS approval_rate,
       (SELECT avg(CASE WHEN ReviewPriority = 'PRIORITY' THEN 1 ELSE 0 END) FROM submissions) AS priority_rate
""")
def s10_summary(spark, d):
    """The seven-metric summary row written by the EDA step (S10); write it
    with ``regula.sources.delimited.write_single_row_csv``."""
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    a = apps.agg(F.count(F.lit(1)).alias("total_applications"), F.countDistinct("SponsorName").alias("unique_sponsors"))
    p = prods.agg(F.count(F.lit(1)).alias("total_products"), F.countDistinct("Form").alias("unique_forms"))
    s = subs.agg(F.count(F.lit(1)).alias("total_submissions"),
                 F.avg(F.when(F.col("SubmissionStatus") == "AP", 1).otherwise(0)).alias("approval_rate"),
                 F.avg(F.when(F.col("ReviewPriority") == "PRIORITY", 1).otherwise(0)).alias("priority_rate"))
    return a.crossJoin(p).crossJoin(s)


@register("X15_reference_drug_yes_no", sql=with_roles("products") + """
SELECT CASE WHEN ReferenceDrug = 1 THEN 'Yes' WHEN ReferenceDrug = 0 THEN 'No' END AS label, count(*) AS count
FROM products WHERE ReferenceDrug IN (0, 1) GROUP BY 1
""")
def x15_yes_no(spark, d):
    """Yes/No labels for a 0/1 flag (X15) with their counts."""
    from regula.functions.columns import yes_no
    (p,) = roles(spark, d, "products")
    lab = p.select(yes_no("ReferenceDrug").alias("label")).filter(F.col("label").isNotNull())
    return lab.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


@register("C10_display_applications", sql=with_roles("applications") + """
SELECT ApplNo, ApplType, SponsorName FROM applications
""")
def c10_display(spark, d):
    """Columns dropped before display (C10): notes, reference and flag columns."""
    from regula.operators.clean import drop_columns
    (a,) = roles(spark, d, "applications")
    return drop_columns(["ApplPublicNotes", "ReferenceStandard", "HasReferenceStandard", "SubmissionDateMissing"])(a)
