"""Registered profiling, data-quality and cleaning queries (B- and C-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from regula.operators import clean as C
from regula.operators import profile as B
from regula.plans.registry import register
from regula.plans.roles import roles, with_roles
from regula.sources.parquet import read_table

# The driver tables' columns and Spark type names, used to write
# the per-column oracle SQL.
COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}
ROLE_COLUMNS = {
    "applications": [("ApplNo", "bigint"), ("ApplType", "string"), ("ApplPublicNotes", "string"),
                     ("SponsorName", "string")],
    "submissions": [("ApplNo", "bigint"), ("SubmissionNo", "int"), ("SubmissionClassCodeID", "int"),
                    ("SubmissionStatus", "string"), ("SubmissionStatusDate", "timestamp_ntz"),
                    ("ReviewPriority", "string")],
    "products": [("ApplNo", "bigint"), ("ProductNo", "int"), ("Form", "string"), ("Strength", "string"),
                 ("ReferenceDrug", "int"), ("DrugName", "string"), ("ActiveIngredient", "string"),
                 ("ReferenceStandard", "string")],
    "marketing_status": [("MarketingStatusID", "int"), ("ApplNo", "bigint"), ("ProductNo", "int")],
}
CORE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
ALL = list(COLUMNS)


def _nulls_sum(cols) -> str:
    return " + ".join(f"count(CASE WHEN {c} IS NULL THEN 1 END)" for c, _ in cols)


def _load_summary_sql(tables) -> str:
    parts = []
    for t in tables:
        cols = COLUMNS[t]
        parts.append(f"SELECT '{t}' AS \"table\", count(*) AS rows, {len(cols)} AS columns, "
                     f"{_nulls_sum(cols)} AS null_values, "
                     f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows FROM {t}")
    return "\nUNION ALL ".join(parts)


def _profile_sql(src: str, cols) -> str:
    parts = []
    for i, (c, ty) in enumerate(cols):
        parts.append(f"SELECT '{c}' AS column_name, {i} AS position, '{ty}' AS dtype, "
                     f"count(CASE WHEN {c} IS NULL THEN 1 END) AS null_count, "
                     f"count(CASE WHEN {c} IS NULL THEN 1 END)::DOUBLE / count(*) * 100 AS null_pct, "
                     f"count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct, count(*) AS rows FROM {src}")
    return "\nUNION ALL ".join(parts)


@register("B1_table_shape_lineitem", sql="SELECT 'lineitem' AS \"table\", count(*) AS rows, 11 AS columns FROM lineitem")
def b1_shape(spark, d):
    return B.table_shape(read_table(spark, d, "lineitem"), "lineitem")


@register("B2_load_summary_all_tables", sql=_load_summary_sql(ALL))
def b2_load(spark, d):
    return B.load_summary({t: read_table(spark, d, t) for t in ALL})


@register("B3_column_profile_orders", sql=_profile_sql("orders", COLUMNS["orders"]))
def b3_profile(spark, d):
    return B.column_profile(read_table(spark, d, "orders"))


@register("B3_column_profile_submissions", sql=with_roles("submissions") + _profile_sql("submissions", ROLE_COLUMNS["submissions"]))
def b3_profile_subs(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return B.column_profile(subs)


@register("B4_null_analysis_applications", sql=with_roles("applications") + """
, p AS (""" + _profile_sql("applications", ROLE_COLUMNS["applications"]) + """)
SELECT column_name, null_count, null_pct FROM p WHERE null_count > 0
""")
def b4_nulls(spark, d):
    (apps,) = roles(spark, d, "applications")
    return B.null_analysis(apps)


def _sample_sql(src, cols, order):
    parts = []
    for c, _ in cols:
        parts.append(f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct, "
                     f"(SELECT CAST({c} AS VARCHAR) FROM {src} ORDER BY {order}, {c} IS NULL, CAST({c} AS VARCHAR) LIMIT 1) AS sample "
                     f"FROM {src}")
    return "\nUNION ALL ".join(parts)


@register("B5_clean_column_profile_applications", sql=with_roles("applications") + """
, p AS (""" + _sample_sql("applications", ROLE_COLUMNS["applications"], "ApplNo") + """)
SELECT p.column_name, t.dtype, p.non_null, p.n_distinct, p.sample FROM p JOIN (VALUES """ +
    ", ".join(f"('{c}', '{ty}')" for c, ty in ROLE_COLUMNS["applications"]) + """) t(column_name, dtype) ON p.column_name = t.column_name
""")
def b5_clean_profile(spark, d):
    (apps,) = roles(spark, d, "applications")
    return B.clean_column_profile(apps, ["ApplNo"])


@register("B6_duplicate_rows_marketing_status", sql=with_roles("marketing_status") + """
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM marketing_status)) AS duplicate_rows FROM marketing_status
""")
def b6_dups(spark, d):
    (ms,) = roles(spark, d, "marketing_status")
    return B.duplicate_rows(ms)


@register("B7_all_null_columns_applications", sql=with_roles("applications") + """
, p AS (""" + _profile_sql("applications", ROLE_COLUMNS["applications"]) + """)
SELECT column_name FROM p WHERE non_null = 0
""")
def b7_all_null(spark, d):
    (apps,) = roles(spark, d, "applications")
    return B.all_null_columns(apps)


def _value_dist_sql(src, cols, max_distinct, top, first=None):
    pairs = "\nUNION ALL ".join(f"SELECT {i} AS position, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {src}"
                                for i, c in enumerate(cols))
    first_clause = f"QUALIFY row_number() OVER (ORDER BY position) <= {first}" if first else ""
    return f"""
, pr AS ({pairs})
, g AS (SELECT position, column_name, value, count(*) AS count FROM pr GROUP BY ALL)
, card AS (SELECT position, count(value) AS d, sum(count) AS r FROM g GROUP BY position HAVING count(value) < {max_distinct}
           {first_clause})
, v AS (SELECT g.*, card.r, row_number() OVER (PARTITION BY g.position ORDER BY g.count DESC, g.value) AS rank
        FROM g JOIN card ON g.position = card.position WHERE g.value IS NOT NULL)
SELECT column_name, value, count, count::DOUBLE / r * 100 AS pct, CAST(rank AS INTEGER) AS rank FROM v WHERE rank <= {top}
"""


_SUB_STR = ["SubmissionStatus", "ReviewPriority"]
_APP_STR = ["ApplType", "ApplPublicNotes", "SponsorName"]


@register("B8_value_distributions_applications",
          sql=with_roles("applications") + _value_dist_sql("applications", _APP_STR, 20, 10))
def b8_values(spark, d):
    (apps,) = roles(spark, d, "applications")
    return B.value_distributions(apps, B.string_columns(apps))


@register("B9_key_column_distributions_submissions",
          sql=with_roles("submissions") + _value_dist_sql(
              "submissions", ["SubmissionClassCodeID", "SubmissionStatus", "ReviewPriority"], 50, 5, 5))
def b9_keys(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return B.key_column_distributions(subs)


_CLEAN_APPS_SQL = """
, capps AS (SELECT ApplNo, ApplType, coalesce(ApplPublicNotes, '') AS ApplPublicNotes, SponsorName FROM applications)
"""
_CLEAN_PRODS_SQL = """
, probe AS (SELECT coalesce(bool_or(regexp_matches(ReferenceStandard, '[A-Za-z]')), false) AS is_text FROM products)
, cprods AS (SELECT ApplNo, ProductNo, Form, coalesce(Strength, '') AS Strength, coalesce(ReferenceDrug, 0) AS ReferenceDrug,
                    DrugName, ActiveIngredient,
                    CASE WHEN (SELECT is_text FROM probe) THEN coalesce(ReferenceStandard, '')
                         ELSE CAST(coalesce(TRY_CAST(ReferenceStandard AS INTEGER), 0) AS VARCHAR) END AS ReferenceStandard,
                    CAST(coalesce(ReferenceStandard IS NOT NULL AND ReferenceStandard <> '' AND ReferenceStandard <> '0', false) AS INTEGER)
                      AS HasReferenceStandard
             FROM products)
"""
_CLEAN_SUBS_SQL = """
, csubs AS (SELECT ApplNo, SubmissionNo, coalesce(SubmissionClassCodeID, -1) AS SubmissionClassCodeID,
                   coalesce(SubmissionStatus, 'UNK') AS SubmissionStatus, SubmissionStatusDate,
                   coalesce(ReviewPriority, 'STANDARD') AS ReviewPriority,
                   CAST(SubmissionStatusDate IS NULL AS INTEGER) AS SubmissionDateMissing
            FROM submissions)
"""


def _cleaned(spark, d, name):
    (df,) = roles(spark, d, name)
    return C.clean_table(df, name)


@register("C1_clean_applications", sql=with_roles("applications") + _CLEAN_APPS_SQL + "SELECT * FROM capps")
def c1_apps(spark, d):
    return _cleaned(spark, d, "applications")


@register("C5_C6_clean_products", sql=with_roles("products") + _CLEAN_PRODS_SQL + "SELECT * FROM cprods")
def c6_prods(spark, d):
    return _cleaned(spark, d, "products")


@register("C2_C3_C4_clean_submissions", sql=with_roles("submissions") + _CLEAN_SUBS_SQL + "SELECT * FROM csubs")
def c3_subs(spark, d):
    return _cleaned(spark, d, "submissions")


def _null_report_sql(src, before_cols, after_src, after_cols, table):
    b = "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(CASE WHEN {c} IS NULL THEN 1 END) AS nb FROM {src}"
                            for c in before_cols)
    a = "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(CASE WHEN {c} IS NULL THEN 1 END) AS na FROM {after_src}"
                            for c in after_cols)
    return f"""
, nb AS ({b})
, na AS ({a})
SELECT '{table}' AS "table", coalesce(nb.column_name, na.column_name) AS column_name, coalesce(nb.nb, 0) AS nulls_before,
       coalesce(na.na, 0) AS nulls_after
FROM nb FULL OUTER JOIN na ON nb.column_name = na.column_name
"""


@register("C9_null_report_submissions", sql=with_roles("submissions") + _CLEAN_SUBS_SQL + _null_report_sql(
    "submissions", [c for c, _ in ROLE_COLUMNS["submissions"]], "csubs",
    [c for c, _ in ROLE_COLUMNS["submissions"]] + ["SubmissionDateMissing"], "submissions"))
def c9_report(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return C.null_report(subs, C.clean_table(subs, "submissions"), "submissions")


@register("C9_null_report_products", sql=with_roles("products") + _CLEAN_PRODS_SQL + _null_report_sql(
    "products", [c for c, _ in ROLE_COLUMNS["products"]], "cprods",
    [c for c, _ in ROLE_COLUMNS["products"]] + ["HasReferenceStandard"], "products"))
def c9_report_p(spark, d):
    (p,) = roles(spark, d, "products")
    return C.null_report(p, C.clean_table(p, "products"), "products")


@register("B10_empty_strings_clean_applications", sql=with_roles("applications") + _CLEAN_APPS_SQL + """
SELECT count(CASE WHEN ApplType = '' THEN 1 END) + count(CASE WHEN ApplPublicNotes = '' THEN 1 END)
       + count(CASE WHEN SponsorName = '' THEN 1 END) AS empty_strings FROM capps
""")
def b10_empty(spark, d):
    return B.empty_string_count(_cleaned(spark, d, "applications"))


@register("B11_flag_columns_clean_products", sql=with_roles("products") + _CLEAN_PRODS_SQL + """
SELECT 'HasReferenceStandard' AS column_name, count(CASE WHEN HasReferenceStandard = 1 THEN 1 END) AS flagged FROM cprods
""")
def b11_flags(spark, d):
    return B.flag_columns(_cleaned(spark, d, "products"))


@register("B12_quality_summary_cleaned", sql=with_roles("applications", "products", "submissions")
          + _CLEAN_APPS_SQL + _CLEAN_PRODS_SQL + _CLEAN_SUBS_SQL + """
SELECT 'applications' AS "table", count(*) AS rows, 4 AS columns,
       count(CASE WHEN ApplNo IS NULL THEN 1 END) + count(CASE WHEN ApplType IS NULL THEN 1 END)
       + count(CASE WHEN ApplPublicNotes IS NULL THEN 1 END) + count(CASE WHEN SponsorName IS NULL THEN 1 END) AS nulls,
       count(CASE WHEN ApplType = '' THEN 1 END) + count(CASE WHEN ApplPublicNotes = '' THEN 1 END)
       + count(CASE WHEN SponsorName = '' THEN 1 END) AS empty_strings,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM capps)) AS duplicates, 0 AS flag_columns FROM capps
UNION ALL
SELECT 'products', count(*), 9,
       count(CASE WHEN ApplNo IS NULL THEN 1 END) + count(CASE WHEN ProductNo IS NULL THEN 1 END)
       + count(CASE WHEN Form IS NULL THEN 1 END) + count(CASE WHEN Strength IS NULL THEN 1 END)
       + count(CASE WHEN ReferenceDrug IS NULL THEN 1 END) + count(CASE WHEN DrugName IS NULL THEN 1 END)
       + count(CASE WHEN ActiveIngredient IS NULL THEN 1 END) + count(CASE WHEN ReferenceStandard IS NULL THEN 1 END)
       + count(CASE WHEN HasReferenceStandard IS NULL THEN 1 END),
       count(CASE WHEN Form = '' THEN 1 END) + count(CASE WHEN Strength = '' THEN 1 END)
       + count(CASE WHEN DrugName = '' THEN 1 END) + count(CASE WHEN ActiveIngredient = '' THEN 1 END)
       + count(CASE WHEN ReferenceStandard = '' THEN 1 END),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cprods)), 0 FROM cprods
UNION ALL
SELECT 'submissions', count(*), 7,
       count(CASE WHEN ApplNo IS NULL THEN 1 END) + count(CASE WHEN SubmissionNo IS NULL THEN 1 END)
       + count(CASE WHEN SubmissionClassCodeID IS NULL THEN 1 END) + count(CASE WHEN SubmissionStatus IS NULL THEN 1 END)
       + count(CASE WHEN SubmissionStatusDate IS NULL THEN 1 END) + count(CASE WHEN ReviewPriority IS NULL THEN 1 END)
       + count(CASE WHEN SubmissionDateMissing IS NULL THEN 1 END),
       count(CASE WHEN SubmissionStatus = '' THEN 1 END) + count(CASE WHEN ReviewPriority = '' THEN 1 END),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM csubs)), 1 FROM csubs
""")
def b12_quality(spark, d):
    return B.union_all([B.quality_summary(_cleaned(spark, d, t), t)
                        for t in ("applications", "products", "submissions")])


@register("B13_non_ascii_rows_documents", sql="""
SELECT 'text' AS column_name, count(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 1 END) AS non_ascii_rows FROM documents
UNION ALL SELECT 'lang', count(CASE WHEN regexp_matches(lang, '[^\\x00-\\x7F]') THEN 1 END) FROM documents
UNION ALL SELECT 'source', count(CASE WHEN regexp_matches(source, '[^\\x00-\\x7F]') THEN 1 END) FROM documents
""")
def b13_non_ascii(spark, d):
    return B.non_ascii_rows(read_table(spark, d, "documents"))


@register("B14_date_columns_submissions", sql="""
SELECT 'SubmissionStatusDate' AS column_name, 'name_or_type' AS reason
""")
def b14_dates(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return B.date_columns(subs)


# order dates as text in the usual layouts, with junk and gaps
_TEXT_DATES = """
SELECT o_orderkey, o_clerk,
       CASE o_orderkey % 7 WHEN 0 THEN {iso} WHEN 1 THEN {iso} || ' 00:00:00' WHEN 2 THEN {us} WHEN 3 THEN replace({iso}, '-', '/')
                           WHEN 4 THEN 'not a date' WHEN 5 THEN NULL ELSE {iso} END AS shipped,
       CASE o_orderkey % 7 WHEN 0 THEN {iso} ELSE o_orderstatus END AS mixed
FROM (SELECT *, 'x' AS o_clerk FROM orders)"""


def _text_dates(spark, d):
    read_table(spark, d, "orders").createOrReplaceTempView("orders")
    iso, us = "date_format(o_orderdate, 'yyyy-MM-dd')", "date_format(o_orderdate, 'MM/dd/yyyy')"
    return spark.sql(_TEXT_DATES.format(iso=iso, us=us))


_TEXT_DATES_SQL = "WITH t AS (" + _TEXT_DATES.format(iso="strftime(o_orderdate, '%Y-%m-%d')", us="strftime(o_orderdate, '%m/%d/%Y')") + """)
, p AS (SELECT *, coalesce(try_strptime(shipped, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d']), NULL) AS ts,
               try_strptime(mixed, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%m/%d/%Y', '%Y/%m/%d']) AS ms FROM t)
"""


@register("B14_date_columns_text", sql=_TEXT_DATES_SQL + """
SELECT column_name, 'parsed_values' AS reason FROM (
  SELECT 'shipped' AS column_name, count(ts) AS parsed, count(shipped) AS filled FROM p
  UNION ALL SELECT 'mixed', count(ms), count(mixed) FROM p) WHERE parsed > 0.5 * filled
""")
def b14_text_dates(spark, d):
    return B.date_columns(_text_dates(spark, d))


@register("C7_text_dates_coerced", sql=_TEXT_DATES_SQL + """
SELECT o_orderkey, CAST(ts AS DATE) AS shipped, (shipped IS NOT NULL AND ts IS NULL) AS unparsed FROM p
""")
def c7_text_dates(spark, d):
    from regula.operators.clean import coerce_timestamp
    t = _text_dates(spark, d).withColumn("raw", F.col("shipped"))
    parsed = coerce_timestamp("shipped")(t)
    return parsed.select("o_orderkey", F.to_date("shipped").alias("shipped"), (F.col("raw").isNotNull() & F.col("shipped").isNull()).alias("unparsed"))


@register("B15_date_range_orders", sql="""
SELECT min(o_orderdate) AS min_date, max(o_orderdate) AS max_date, count(o_orderdate) AS valid, count(*) AS total FROM orders
""")
def b15_range(spark, d):
    return B.date_range(read_table(spark, d, "orders"), "o_orderdate")


@register("B17_primary_key_candidates_orders", sql="WITH p AS (" + _profile_sql("orders", COLUMNS["orders"]) + """)
SELECT column_name FROM p WHERE n_distinct = rows AND null_count = 0
""")
def b17_pk(spark, d):
    return B.primary_key_candidates(read_table(spark, d, "orders"))


@register("B18_id_column_ratios_submissions", sql=with_roles("submissions") + """
SELECT 'ApplNo' AS column_name, count(DISTINCT ApplNo)::DOUBLE / count(*) AS unique_ratio,
       count(CASE WHEN ApplNo IS NULL THEN 1 END)::DOUBLE / count(*) AS null_ratio FROM submissions
UNION ALL SELECT 'SubmissionNo', count(DISTINCT SubmissionNo)::DOUBLE / count(*),
       count(CASE WHEN SubmissionNo IS NULL THEN 1 END)::DOUBLE / count(*) FROM submissions
UNION ALL SELECT 'SubmissionClassCodeID', count(DISTINCT SubmissionClassCodeID)::DOUBLE / count(*),
       count(CASE WHEN SubmissionClassCodeID IS NULL THEN 1 END)::DOUBLE / count(*) FROM submissions
""")
def b18_ids(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return B.id_column_ratios(subs)


@register("B19_referential_integrity", sql=with_roles("applications", "products", "submissions", "marketing_status") + """
, base AS (SELECT DISTINCT ApplNo FROM applications)
SELECT 'products' AS "table", count(CASE WHEN ApplNo IN (SELECT ApplNo FROM base) THEN 1 END) AS matching,
       count(CASE WHEN ApplNo NOT IN (SELECT ApplNo FROM base) THEN 1 END) AS orphaned
FROM (SELECT DISTINCT ApplNo FROM products)
UNION ALL
SELECT 'submissions', count(CASE WHEN ApplNo IN (SELECT ApplNo FROM base) THEN 1 END),
       count(CASE WHEN ApplNo NOT IN (SELECT ApplNo FROM base) THEN 1 END) FROM (SELECT DISTINCT ApplNo FROM submissions)
UNION ALL
SELECT 'marketing_status', count(CASE WHEN ApplNo IN (SELECT ApplNo FROM base) THEN 1 END),
       count(CASE WHEN ApplNo NOT IN (SELECT ApplNo FROM base) THEN 1 END) FROM (SELECT DISTINCT ApplNo FROM marketing_status)
UNION ALL
SELECT 'applications_without_submissions', count(CASE WHEN ApplNo IN (SELECT ApplNo FROM submissions) THEN 1 END),
       count(CASE WHEN ApplNo NOT IN (SELECT ApplNo FROM submissions) THEN 1 END) FROM base
""")
def b19_ri(spark, d):
    apps, prods, subs, ms = roles(spark, d, "applications", "products", "submissions", "marketing_status")
    return B.referential_integrity({"applications": apps, "products": prods, "submissions": subs, "marketing_status": ms}, "ApplNo", [
        ("applications", "products", "products"), ("applications", "submissions", "submissions"),
        ("applications", "marketing_status", "marketing_status"), ("submissions", "applications", "applications_without_submissions")])


def _totals_sql(tables) -> str:
    return "WITH s AS (" + "\nUNION ALL ".join(f"SELECT count(*) AS r, {len(COLUMNS[t])} AS c FROM {t}" for t in tables) + """)
SELECT CAST(count(*) AS INTEGER) AS tables, CAST(sum(r) AS BIGINT) AS rows, CAST(sum(c) AS BIGINT) AS columns,
       CAST(sum(r * c) AS BIGINT) AS cells FROM s
"""


def _totals(spark, d, tables):
    shapes = B.union_all([B.table_shape(read_table(spark, d, t), t) for t in tables])
    return shapes.agg(F.count(F.lit(1)).cast("int").alias("tables"), F.sum("rows").alias("rows"),
                      F.sum("columns").cast("long").alias("columns"),
                      F.sum(F.col("rows") * F.col("columns")).alias("cells"))


@register("B20_overall_totals", sql=_totals_sql(ALL))
def b20_totals(spark, d):
    return _totals(spark, d, ALL)


@register("B20_overall_totals_core_tables", sql=_totals_sql(CORE))
def b20_core_totals(spark, d):
    return _totals(spark, d, CORE)


@register("B21_dtype_tally", sql="""
WITH c AS (SELECT table_name, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>'
                  WHEN 'DOUBLE[]' THEN 'array<double>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS dtype
           FROM information_schema.columns WHERE table_name IN (""" + ", ".join(f"'{t}'" for t in ALL) + """))
, n AS (""" + "\nUNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS r FROM {t}" for t in ALL) + """)
SELECT table_name AS "table", dtype, CAST(count(*) AS INTEGER) AS n_columns, any_value(r) AS rows
FROM c JOIN n ON n.t = c.table_name GROUP BY 1, 2
""")
def b21_dtypes(spark, d):
    return B.union_all([B.dtype_tally(read_table(spark, d, t), t) for t in ALL])


@register("B22_column_classes_lineitem", sql="""
WITH p AS (""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, "
    + (f"skewness({c}::DOUBLE)" if ty in ("int", "bigint", "double") else "NULL::DOUBLE") + " AS skew, "
    + ("true" if ty in ("int", "bigint", "double") else "false") + " AS isnum FROM lineitem"
    for c, ty in COLUMNS["lineitem"]) + """)
SELECT column_name, n_distinct,
       CASE WHEN isnum AND n_distinct >= 20 THEN 'numeric' WHEN n_distinct > 100 THEN 'high_cardinality'
            WHEN n_distinct <= 10 THEN 'low_cardinality' ELSE 'categorical' END AS class,
       CASE WHEN isnum AND n_distinct >= 20 THEN skew END AS skewness,
       coalesce(isnum AND n_distinct >= 20 AND abs(skew) > 1, false) AS is_skewed,
       contains(lower(column_name), 'date') AS is_date
FROM p
""")
def b22_classes(spark, d):
    return B.column_classes(read_table(spark, d, "lineitem"))


@register("B23_numeric_stats_lineitem", sql="\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std, "
    f"min({c}::DOUBLE) AS min, max({c}::DOUBLE) AS max FROM lineitem"
    for c, ty in COLUMNS["lineitem"] if ty in ("int", "bigint", "double")))
def b23_numeric(spark, d):
    return B.numeric_stats(read_table(spark, d, "lineitem"))


@register("B24_trimmed_histogram_extendedprice", sql="""
WITH v AS (SELECT l_extendedprice::DOUBLE AS v FROM lineitem WHERE l_extendedprice IS NOT NULL)
, q AS (SELECT quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM v)
, k AS (SELECT v FROM v, q WHERE v >= q.lo AND v <= q.hi)
, r AS (SELECT min(v) AS lo, max(v) AS hi FROM k)
, b AS (SELECT CAST(least(greatest(floor((v - r.lo) / (r.hi - r.lo) * 30), 0), 29) AS INTEGER) AS bin, count(*) AS c
        FROM k, r GROUP BY 1)
SELECT s.bin, coalesce(b.c, 0) AS count FROM (SELECT CAST(unnest(range(0, 30)) AS INTEGER) AS bin) s LEFT JOIN b ON s.bin = b.bin
""")
def b24_trimmed(spark, d):
    return B.trimmed_histogram(read_table(spark, d, "lineitem"), "l_extendedprice")


@register("B25_top20_forms", sql=with_roles("products") + """
, g AS (SELECT Form, count(*) AS count FROM products GROUP BY Form)
SELECT Form, count, count::DOUBLE / (SELECT sum(count) FROM g) * 100 AS pct FROM g WHERE Form IS NOT NULL
ORDER BY count DESC, Form LIMIT 20
""")
def b25_top(spark, d):
    (prods,) = roles(spark, d, "products")
    return B.top_categories(prods, "Form", 20)


@register("B26_year_histogram_orderdate", sql="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders
WHERE year(o_orderdate) BETWEEN 1980 AND 2025 GROUP BY 1
""")
def b26_years(spark, d):
    return B.year_histogram(read_table(spark, d, "orders"), "o_orderdate")


_SHOWCASE = [("applications", "ApplType"), ("submissions", "SubmissionStatus"), ("submissions", "ReviewPriority"),
             ("products", "Form"), ("marketing_status", "MarketingStatusID"), ("applications", "SponsorName")]


@register("B27_key_distribution_showcase", sql=with_roles("applications", "submissions", "products", "marketing_status")
          + "\n".join(f""", s{i} AS (SELECT '{t}' AS "table", '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count,
        count(*)::DOUBLE / (SELECT count(*) FROM {t}) * 100 AS pct, (SELECT count(*) FROM {t}) AS total_rows,
        (SELECT count(DISTINCT {c}) FROM {t}) AS unique_values
        FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 10)"""
                      for i, (t, c) in enumerate(_SHOWCASE))
          + "\nSELECT * FROM s0" + "".join(f" UNION ALL SELECT * FROM s{i}" for i in range(1, len(_SHOWCASE))))
def b27_showcase(spark, d):
    frames = dict(zip(["applications", "submissions", "products", "marketing_status"],
                      roles(spark, d, "applications", "submissions", "products", "marketing_status")))
    parts = []
    for t, c in _SHOWCASE:
        df = frames[t]
        tot = df.agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct(c).alias("unique_values"))
        top = (df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("count"))
                 .orderBy(F.col("count").desc(), F.col(c).cast("string")).limit(10))
        parts.append(top.crossJoin(F.broadcast(tot)).select(
            F.lit(t).alias("table"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), "count",
            (F.col("count") / F.col("total_rows") * 100).alias("pct"), "total_rows", "unique_values"))
    return B.union_all(parts)


@register("B28_lookup_preview_nation", sql="SELECT * FROM nation ORDER BY n_nationkey LIMIT 20")
def b28_nation(spark, d):
    return B.lookup_preview(read_table(spark, d, "nation"), "n_nationkey")


@register("B28_lookup_preview_region", sql="SELECT * FROM region ORDER BY r_regionkey LIMIT 20")
def b28_region(spark, d):
    return B.lookup_preview(read_table(spark, d, "region"), "r_regionkey")


@register("B29_head_orders", sql="SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def b29_head(spark, d):
    return B.head(read_table(spark, d, "orders"), ["o_orderkey"], 5)


@register("B30_top10_tables_by_rows", sql="WITH s AS (" + "\nUNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ALL) + """)
SELECT * FROM s ORDER BY rows DESC, "table" LIMIT 10
""")
def b30_top_tables(spark, d):
    shapes = B.union_all([read_table(spark, d, t).agg(F.count(F.lit(1)).alias("rows"))
                          .select(F.lit(t).alias("table"), "rows") for t in ALL])
    return shapes.orderBy(F.col("rows").desc(), F.col("table")).limit(10)


@register("B31_histogram_extendedprice_50", sql="""
WITH v AS (SELECT l_extendedprice::DOUBLE AS v FROM lineitem WHERE l_extendedprice IS NOT NULL)
, r AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
, b AS (SELECT CAST(least(greatest(floor((v - r.lo) / (r.hi - r.lo) * 50), 0), 49) AS INTEGER) AS bin, count(*) AS c FROM v, r GROUP BY 1)
SELECT s.bin, r.lo + s.bin * (r.hi - r.lo) / 50 AS bin_start, r.lo + (s.bin + 1) * (r.hi - r.lo) / 50 AS bin_end,
       coalesce(b.c, 0) AS count
FROM (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin) s CROSS JOIN r LEFT JOIN b ON s.bin = b.bin
""")
def b31_hist(spark, d):
    from regula.operators.relational import histogram
    return histogram(read_table(spark, d, "lineitem"), "l_extendedprice", 50)


