"""Delimited-file sources and sinks.

* S1: header TSV with a declared schema (keys stay strings, so zero padding
  survives) and pandas' default null tokens mapped to null on every string
  column (N1) - Spark's CSV reader knows only one null token.  Quoted fields may
  hold separators, quotes and line breaks; files are split all the same
  (``records``).
* S2: encoding fallback: files with bytes that are not valid UTF-8 are decoded
  as ISO-8859-1 (which never fails), the rest as UTF-8.  The verdict comes from
  the scan that finds where records start and is joined by file.
* S3: rows with MORE fields than the header are dropped (pandas
  ``on_bad_lines='skip'``); short rows are kept and padded with nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regula.functions.columns import null_tokens_to_null
from regula.sources.records import read_records

def _header(spark: SparkSession, paths: list[str], sep: str) -> list[str]:
    """Column names: the first line of the first file that has one."""
    first = spark.read.option("lineSep", "\n").text(paths).where("_metadata.file_block_start = 0").limit(1).collect()
    return [h.strip().strip('"') for h in first[0][0].lstrip("\ufeff").rstrip("\r").split(sep)] if first else []


def read_delimited(spark: SparkSession, path: str | list[str], *, sep: str = "\t",
                   schema: T.StructType | None = None, encoding: str = "UTF-8", fallback: str | None = None,
                   null_tokens: bool = True, drop_long_rows: bool = True) -> DataFrame:
    """Header-delimited scan (S1 + S3).  Without a schema every column is
    read as string (no inference, keys keep their zero padding); a folder
    without files then gives a table without columns."""
    paths = [path] if isinstance(path, str) else list(path)
    if schema is None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in _header(spark, paths, sep)])
    if not schema.fields:
        return spark.createDataFrame([], schema)
    records = read_records(spark, paths, sep=sep, encoding=encoding, fallback=fallback)
    if drop_long_rows:
        records = records.where(F.col("fields") <= len(schema.fields))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "",
               "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(schema.fields) + 1))}
    ddl = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    df = records.select(F.from_csv("record", ddl, options).alias("r")).select(
        *[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema.fields)])
    if null_tokens:
        df = df.select(*[null_tokens_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.StringType)
                         else F.col(f"`{f.name}`") for f in schema.fields])
    return df


def read_delimited_with_fallback(spark: SparkSession, path: str | list[str], *, fallback: str = "ISO-8859-1",
                                 **kw) -> DataFrame:
    """UTF-8 for clean files, ``fallback`` for files that do not decode."""
    return read_delimited(spark, path, fallback=fallback, **kw)


def write_cleaned(before: DataFrame, clean, path: str, fmt: str = "parquet") -> DataFrame:
    """Write ``clean(before)`` and return the null report of the very rows
    written (S9, C9): column_name, nulls_before, nulls_after, rows_before,
    rows_after.

    The counts are metrics of the job that writes (``Observation``), so the
    table is read once and the report cannot differ from what was stored."""
    def counts(df: DataFrame, observation: Observation) -> DataFrame:
        nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
        return df.observe(observation, F.count(F.lit(1)).alias("rows"), *nulls)

    seen, kept = Observation(), Observation()
    after = clean(counts(before, seen))
    write_table(counts(after, kept), path, fmt)
    first, last = seen.get, kept.get
    names = list(dict.fromkeys([*before.columns, *after.columns]))
    nulls = [{c: m.get(f"n{i}", 0) for i, c in enumerate(df.columns)} for df, m in ((before, first), (after, last))]
    return before.sparkSession.createDataFrame([(c, nulls[0].get(c), nulls[1].get(c), first.get("rows", 0), last.get("rows", 0)) for c in names],
                                               "column_name string, nulls_before long, nulls_after long, rows_before long, rows_after long")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Cleaned-table sink (S9/S11).  Parquet keeps '' distinct from null;
    CSV writes a header and, like any CSV, reads '' back as null (N2)."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).option("emptyValue", "").csv(path)
    else:
        raise ValueError(fmt)


def write_single_row_csv(df: DataFrame, path: str) -> None:
    """One-row summary sink (S10): the row is already one partition's worth."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
