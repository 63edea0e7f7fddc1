"""Table catalog (S4-S8): name -> lazy DataFrame, registered as temp views."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regula.sources.delimited import read_delimited

log = logging.getLogger(__name__)

# The reference's table names and their source file names.
TABLE_FILES = {
    "action_types_lookup": "ActionTypes_Lookup.txt",
    "applications": "Applications.txt",
    "application_docs": "ApplicationDocs.txt",
    "application_docs_type_lookup": "ApplicationsDocsType_Lookup.txt",
    "marketing_status": "MarketingStatus.txt",
    "marketing_status_lookup": "MarketingStatus_Lookup.txt",
    "products": "Products.txt",
    "submission_class_lookup": "SubmissionClass_Lookup.txt",
    "submission_property_type": "SubmissionPropertyType.txt",
    "submissions": "Submissions.txt",
    "te": "TE.txt",
    "join_submission_action_type": "Join_Submission_ActionTypes_Lookup.txt",
}


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern on whatever store the path names, through
    Hadoop's file system, which the executors use too."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


class Catalog:
    """Lazy tables by name; missing files are skipped with a warning."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def load(self, directory: str, specs: dict[str, str] | None = None, schemas: dict | None = None,
             **read_kw) -> Catalog:
        for name, fname in (specs or TABLE_FILES).items():
            path = f"{directory.rstrip('/')}/{fname}"
            if not _matching(self.spark, path):
                log.warning("table %s: %s not found, skipped", name, path)
                continue
            self.register(name, read_delimited(self.spark, path, schema=(schemas or {}).get(name), **read_kw))
        return self

    def load_cleaned(self, directory: str, suffix: str = "_no_nulls", fmt: str = "parquet",
                     names: list[str] | None = None) -> Catalog:
        """Cleaned tables by glob, name from the file name (S7); with
        ``names`` only those, absent ones skipped (S8)."""
        ext = {"parquet": "", "csv": ".csv"}[fmt]
        for path in _matching(self.spark, f"{directory.rstrip('/')}/*{suffix}{ext}"):
            name = path.rsplit("/", 1)[-1][: -len(suffix + ext)]
            if names is not None and name not in names:
                continue
            df = (self.spark.read.parquet(path) if fmt == "parquet"
                  else self.spark.read.option("header", True).csv(path))
            self.register(name, df)
        return self

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def get(self, name: str) -> DataFrame | None:
        """Table or None."""
        return self.tables.get(name)

    def missing(self, expected: list[str] | None = None) -> DataFrame:
        """Expected table names that were not loaded, plus the "n of m" count."""
        exp = expected or list(TABLE_FILES)
        e = self.spark.createDataFrame([(n,) for n in exp], "table string")
        got = self.spark.createDataFrame([(n,) for n in self.tables] or [("",)], "table string")
        miss = e.subtract(got)
        return miss.crossJoin(self.spark.range(1).select(F.lit(len(set(exp) & set(self.tables))).alias("loaded"),
                                                         F.lit(len(exp)).alias("expected")))
