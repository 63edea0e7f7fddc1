"""Profiles by fingerprint: counts that hold for nulls, nested values and rows
that only a whole comparison tells apart."""

import pytest
from pyspark.sql import functions as F

from regula.operators import profile as B

SCHEMA = "a string, b string, n double, v array<int>, `odd name` long"


@pytest.fixture(scope="module")
def table(spark):
    rows = [("x", None, 0.0, [1, None], 1), (None, "x", -0.0, [1], 1), ("x", None, 0.0, [1, None], 1), ("x", None, None, [None, 1], 1),
            (None, None, None, None, None), (None, None, None, None, None), ("", "", 1.5, [], 2)]
    return spark.createDataFrame(rows, SCHEMA)


def test_duplicates_tell_shifted_nulls_apart(table):
    assert B.duplicate_rows(table).first()[0] == table.count() - table.distinct().count() == 2


def test_colliding_fingerprints_are_compared_in_whole(table, monkeypatch):
    monkeypatch.setattr(B, "_hashes", lambda *cols: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    assert B.duplicate_rows(table).first()[0] == 2
    monkeypatch.setattr(B, "FEW_REPEATED", 0)
    assert B.duplicate_rows(table).first()[0] == 2


def test_load_summary_of_several_tables(spark, table):
    got = {r["table"]: (r["rows"], r["columns"], r["null_values"], r["duplicate_rows"]) for r in
           B.load_summary({"t": table, "none": table.limit(0), "ids": spark.range(50)}).collect()}
    nulls = sum(x is None for r in table.collect() for x in r)
    assert got == {"t": (7, 5, nulls, 2), "none": (0, 5, 0, 0), "ids": (50, 1, 0, 0)}


def test_column_counts_equal_count_distinct(table):
    got = {r["column_name"]: (r["rows"], r["null_count"], r["n_distinct"]) for r in B.column_counts(table).collect()}
    for c in table.columns:
        x = F.col(f"`{c}`")
        want = table.agg(F.count("*"), F.count_if(x.isNull()), F.countDistinct(x)).first()
        assert got[c] == tuple(want), c
    assert {r["n_distinct"] for r in B.column_counts(table.limit(0)).collect()} == {0}


def test_shuffle_carries_fingerprints_only(spark):
    docs = spark.createDataFrame([(1, "a long text")], "id long, text string")
    for df in (B.column_counts(docs), B.column_profile(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan
        exchanged = [line for line in plan.splitlines() if "Exchange hash" in line]
        assert exchanged and not any("text" in line for line in exchanged)


def test_sketches_merge_and_estimate(spark):
    rows = spark.range(20000).select("id", (F.col("id") % 300).alias("m"), F.when(F.col("id") < 0, 1).alias("none"))
    parts = B.column_sketches(rows.where("id < 9000")).unionByName(B.column_sketches(rows.where("id >= 8000")))
    whole = B.merge_sketches(parts)
    got = {r["column_name"]: r for r in whole.select("*", F.hll_sketch_estimate("sketch").alias("about")).collect()}
    assert got["id"]["about"] == pytest.approx(20000, rel=0.06) and got["m"]["about"] == pytest.approx(300, rel=0.06)
    assert got["id"]["rows"] == 21000 and got["none"]["non_null"] == 0 and got["none"]["about"] == 0


def test_key_candidates_are_screened_then_counted(spark):
    rows = spark.range(5000).select("id", F.greatest(F.col("id"), F.lit(1)).alias("nearly"), (F.col("id") % 10).alias("few"),
                                    F.when(F.col("id") > 0, F.col("id")).alias("with_null"))
    assert [r[0] for r in B.primary_key_candidates(rows).collect()] == ["id"]
    assert B.primary_key_candidates(rows.select("few")).count() == 0


def test_shared_columns(spark):
    got = B.shared_columns(spark, {"a": ["k", "x", "y"], "b": ["y", "k"], "c": ["z"]}).collect()
    assert [tuple(r) for r in got] == [("a", "b", "k, y")]
