"""Scalable demo data (S12): applications, products and submissions drawn
with ``spark.range`` + seeded ``rand`` (status p = .6/.2/.15/.05, priority
p = .3/.7, dates 2010-2024).  For demonstrations and tests only; no
registered query reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The demo generator's categories and probabilities.
STATUSES = [("AP", 0.6), ("TA", 0.2), ("WD", 0.15), ("RL", 0.05)]
PRIORITIES = [("PRIORITY", 0.3), ("STANDARD", 0.7)]
APPL_TYPES = ["NDA", "ANDA", "BLA"]
FORMS = ["TABLET", "CAPSULE", "INJECTION", "SOLUTION", "CREAM"]


def _pick(r, choices):
    expr, acc = None, 0.0
    for value, p in choices:
        acc += p
        expr = F.when(r < acc, F.lit(value)) if expr is None else expr.when(r < acc, F.lit(value))
    return expr.otherwise(F.lit(choices[-1][0]))


def sample_tables(spark: SparkSession, n_apps: int = 500, n_products: int = 500, n_subs: int = 1000,
                  seed: int = 42) -> dict[str, DataFrame]:
    apps = spark.range(n_apps).select(
        F.format_string("%06d", F.col("id") + 1).alias("ApplNo"),
        F.element_at(F.array(*[F.lit(t) for t in APPL_TYPES]), (F.floor(F.rand(seed) * 3) + 1).cast("int")).alias("ApplType"),
        F.format_string("SPONSOR_%d", F.floor(F.rand(seed + 1) * 50).cast("int")).alias("SponsorName"))
    prods = spark.range(n_products).select(
        F.format_string("%06d", (F.floor(F.rand(seed + 2) * n_apps) + 1).cast("int")).alias("ApplNo"),
        F.format_string("%03d", F.col("id") % 10 + 1).alias("ProductNo"),
        F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.floor(F.rand(seed + 3) * 5) + 1).cast("int")).alias("Form"),
        F.format_string("%dMG", (F.floor(F.rand(seed + 4) * 500) + 1).cast("int")).alias("Strength"),
        (F.rand(seed + 5) < 0.3).cast("int").alias("ReferenceDrug"))
    subs = spark.range(n_subs).select(
        F.format_string("%06d", (F.floor(F.rand(seed + 6) * n_apps) + 1).cast("int")).alias("ApplNo"),
        (F.col("id") % 20 + 1).cast("int").alias("SubmissionNo"),
        _pick(F.rand(seed + 7), STATUSES).alias("SubmissionStatus"),
        _pick(F.rand(seed + 8), PRIORITIES).alias("ReviewPriority"),
        F.timestamp_seconds(F.lit(1262304000) + F.floor(F.rand(seed + 9) * 15 * 365 * 86400)).alias("SubmissionStatusDate"))
    return {"applications": apps, "products": prods, "submissions": subs}
