"""Domain roles over the driver's synthetic tables.

The operators are written against the drug-approval schema (ApplNo,
SponsorName, SubmissionStatus, ...).  These role views bind that schema to
the driver's tables.  The same CASE text is used in the Spark views and in
the SQL oracles, so both sides see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regula.sources.parquet import read_table

# Fixed role definitions: one SQL body per role.  Spark evaluates them through
# spark.sql over temp views of the parquet scans; DuckDB evaluates the very
# same text as CTEs over its pre-registered views.
ROLE_SQL = {
    "applications": """
        SELECT o_orderkey AS ApplNo,
               o_orderstatus AS ApplType,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS ApplPublicNotes,
               c_name AS SponsorName
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "submissions": """
        SELECT l_orderkey AS ApplNo,
               l_linenumber AS SubmissionNo,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 28 + 1 AS INT) END AS SubmissionClassCodeID,
               CASE l_returnflag WHEN 'N' THEN 'AP' WHEN 'A' THEN 'TA' WHEN 'R' THEN 'WD' END AS SubmissionStatus,
               l_shipdate AS SubmissionStatusDate,
               CASE WHEN l_linestatus = 'F' THEN 'PRIORITY' ELSE 'STANDARD' END AS ReviewPriority
        FROM lineitem""",
    "products": """
        SELECT l_orderkey AS ApplNo,
               l_linenumber AS ProductNo,
               p_type AS Form,
               p_brand AS Strength,
               CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS INT) AS ReferenceDrug,
               p_name AS DrugName,
               CASE WHEN p_size < 25 THEN replace(p_name, ' ', ';') ELSE p_name END AS ActiveIngredient,
               CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END AS ReferenceStandard
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "marketing_status": """
        SELECT CAST(p_size % 5 + 1 AS INT) AS MarketingStatusID,
               l_orderkey AS ApplNo,
               l_linenumber AS ProductNo
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
}

ROLE_BASE_TABLES = {
    "applications": ("orders", "customer"),
    "submissions": ("lineitem",),
    "products": ("lineitem", "part"),
    "marketing_status": ("lineitem", "part"),
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy role DataFrame; base tables are registered as temp views."""
    for t in ROLE_BASE_TABLES[name]:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(ROLE_SQL[name])


def roles(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [role(spark, sf_dir, n) for n in names]


def with_roles(*names: str) -> str:
    """SQL prefix defining the named roles as CTEs (for the DuckDB oracle)."""
    parts = [f"{n} AS ({ROLE_SQL[n]})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"
