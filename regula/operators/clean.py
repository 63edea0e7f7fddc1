"""Null-handling and projection rules (C-series).

A table's rules are applied as ONE ``select`` (every output column is one
expression), so cleaning adds no pass over the data.  Data-dependent choices
(is this column text?) are decided inside the same plan by a one-row
aggregate joined to the rows, not by a driver-side branch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regula.functions.columns import has_letter
from regula.operators.profile import NUMERIC

Rule = Callable[[DataFrame], DataFrame]


def fill_text(cols: list[str]) -> Rule:
    """Text nulls -> '' (C1)."""
    def rule(df: DataFrame) -> DataFrame:
        present = [c for c in cols if c in df.columns]
        return df.na.fill("", present) if present else df
    return rule


def fill_values(mapping: dict[str, object]) -> Rule:
    """Category nulls -> a fixed value per column."""
    def rule(df: DataFrame) -> DataFrame:
        present = {k: v for k, v in mapping.items() if k in df.columns}
        return df.na.fill(present) if present else df
    return rule


def fill_id(col: str, value: int = -1, flag: str | None = None) -> Rule:
    """Id nulls -> -1 cast to int (C3); optional flag of filled rows (C4)."""
    def rule(df: DataFrame) -> DataFrame:
        if col not in df.columns:
            return df
        out = df
        if flag:
            out = out.withColumn(flag, F.col(col).isNull().cast("int"))
        return out.withColumn(col, F.coalesce(F.col(col).cast("int"), F.lit(value)))
    return rule


def missing_flag(col: str, flag: str) -> Rule:
    """0/1 flag of null values, taken before any fill (C4)."""
    def rule(df: DataFrame) -> DataFrame:
        return df.withColumn(flag, F.col(col).isNull().cast("int")) if col in df.columns else df
    return rule


def coerce_timestamp(col: str) -> Rule:
    """Date parse with coerce (C7): unparseable -> null."""
    from regula.operators.profile import parse_timestamp

    def rule(df: DataFrame) -> DataFrame:
        if col not in df.columns:
            return df
        dt = df.schema[col].dataType
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return df
        return df.withColumn(col, parse_timestamp(col))
    return rule


def fill_by_type(col: str) -> Rule:
    """Type-dependent fill (C5): numeric column -> 0 as int, text -> ''."""
    def rule(df: DataFrame) -> DataFrame:
        if col not in df.columns:
            return df
        if isinstance(df.schema[col].dataType, NUMERIC):
            return df.withColumn(col, F.coalesce(F.col(col).cast("int"), F.lit(0)))
        return df.withColumn(col, F.coalesce(F.col(col), F.lit("")))
    return rule


def fill_text_or_number(col: str, flag: str) -> Rule:
    """ReferenceStandard-style fill (C6).  A string column holding letters in
    any value is text: nulls -> '' and ``flag`` = 1 where a real value is
    present (null, '' and '0' give 0, D2).  Otherwise the values are
    numbers: nulls -> '0'.  The letter test is a one-row aggregate joined to
    the rows, so the branch is taken inside the plan for every row alike."""
    def rule(df: DataFrame) -> DataFrame:
        if col not in df.columns:
            return df
        if isinstance(df.schema[col].dataType, NUMERIC):
            return (df.withColumn(col, F.coalesce(F.col(col).cast("int"), F.lit(0)))
                      .withColumn(flag, (F.col(col) != 0).cast("int")))
        probe = df.agg(F.coalesce(F.bool_or(has_letter(col)), F.lit(False)).alias("_is_text"))
        x = F.col(col)
        text_val = F.coalesce(x, F.lit(""))
        num_val = F.coalesce(x.try_cast("int"), F.lit(0)).cast("string")
        present = F.coalesce((x.isNotNull() & (x != "") & (x != "0")), F.lit(False)).cast("int")
        cols = [F.when(F.col("_is_text"), text_val).otherwise(num_val).alias(c) if c == col else F.col(c)
                for c in df.columns]
        return df.crossJoin(F.broadcast(probe)).select(*cols, present.alias(flag))
    return rule


def clip_upper(col: str, upper) -> Rule:
    """``clip(upper=u)`` that keeps nulls."""
    def rule(df: DataFrame) -> DataFrame:
        return df.withColumn(col, F.when(F.col(col) > upper, F.lit(upper)).otherwise(F.col(col)))
    return rule


def replace_value(col: str, old, new) -> Rule:
    """Replace one value (C12, e.g. 0 days -> 1)."""
    def rule(df: DataFrame) -> DataFrame:
        return df.withColumn(col, F.when(F.col(col) == old, F.lit(new)).otherwise(F.col(col)))
    return rule


def drop_columns(cols: list[str]) -> Rule:
    """Column drop before display."""
    def rule(df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in cols if c in df.columns])
    return rule


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Apply a table's rules in order; Catalyst collapses the projections."""
    for r in rules:
        df = r(df)
    return df


# The reference's per-table null rules (fill values and flag names).
RULES: dict[str, list[Rule]] = {
    "applications": [fill_text(["ApplPublicNotes"])],
    "products": [fill_text(["Strength"]), fill_by_type("ReferenceDrug"),
                 fill_text_or_number("ReferenceStandard", "HasReferenceStandard")],
    "submissions": [fill_id("SubmissionClassCodeID", -1), fill_values({"SubmissionStatus": "UNK"}),
                    coerce_timestamp("SubmissionStatusDate"),
                    missing_flag("SubmissionStatusDate", "SubmissionDateMissing"),
                    fill_text(["SubmissionsPublicNotes"]), fill_values({"ReviewPriority": "STANDARD"})],
    "te": [fill_values({"TECode": "NONE"})],
    "action_types_lookup": [fill_values({"ActionTypes_LookupDescription": "UNKNOWN",
                                         "SupplCategoryLevel1Code": "UNK", "SupplCategoryLevel2Code": "UNK"})],
    "submission_class_lookup": [fill_values({"SubmissionClassCode": "UNK",
                                             "SubmissionClassCodeDescription": "NOT SPECIFIED"})],
    "join_submission_action_type": [fill_id("ActionTypes_LookupID", -1, flag="ActionTypeMissing")],
}


def clean_table(df: DataFrame, table: str, rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """Per-table rule routing with pass-through of unknown tables."""
    return apply_rules(df, (rules or RULES).get(table, []))


def null_report(before: DataFrame, after: DataFrame, table: str) -> DataFrame:
    """Null counts per column before and after cleaning."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
        return one.unpivot([], df.columns, "column_name", name)
    b = counts(before, "nulls_before")
    a = counts(after, "nulls_after")
    j = b.join(a, "column_name", "full_outer")
    return j.select(F.lit(table).alias("table"), "column_name",
                    F.coalesce("nulls_before", F.lit(0)).cast("long").alias("nulls_before"),
                    F.coalesce("nulls_after", F.lit(0)).cast("long").alias("nulls_after"))


def not_null_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.na.drop(subset=cols)


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null-to-zero after joins (C14)."""
    return df.na.fill(0, cols)


