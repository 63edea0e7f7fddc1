"""Steps that read their input once, deal rows by their number and join few values without a shuffle."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from regula import session
from regula.operators import forest_grid as G
from regula.operators import ml_tables as M
from regula.operators import models, similarity
from regula.operators.prescriptive import dose_summary_by_approval
from regula.operators.profile import date_columns
from regula.operators.relational import grouped_quantiles
from regula.operators.stats import lorenz_points
from regula.operators.ward import ward_clusters


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_threshold(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _counted(spark, rows=60):
    """A frame and how often one of its rows was made."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return float(x % 11)

    base = spark.range(0, rows, 1, 2)
    return base.select("id", F.udf(seen, "double").asNondeterministic()("id").alias("a"), (F.col("id") * F.col("id") % 17).cast("double").alias("b"),
                       (F.col("id") % 2).cast("int").alias("y")), made


@pytest.mark.parametrize("step", [
    lambda d: models.pca_summary(d, ["a", "b"])[1].collect(),
    lambda d: models.bisecting_clusters(d, ["a", "b"], k=3).collect(),
    lambda d: ward_clusters(d, ["a", "b"], k=3).collect(),
    lambda d: lorenz_points(d, "a").collect(),
    lambda d: M.roc_points(d, "a", "y").collect(),
    lambda d: models.kmeans_select(d, ["a", "b"], ks=[2], n_init=2)[0].collect(),
    lambda d: models.approval_time_regression(d.withColumn("t", F.col("b")), ["a", "b"], "t", ("id",), rf_depth=2)[0].collect(),
], ids=["pca", "bisecting", "ward", "lorenz", "roc", "kmeans", "regression"])
def test_input_is_made_once(spark, step):
    d, made = _counted(spark)
    step(d)
    assert made.value == 60


def test_codes_of_few_values_are_broadcast(spark, no_threshold):
    d = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    out = M.label_encode(d, "v", "code")
    assert "BroadcastHashJoin" in _plan(out)
    assert sorted(out.collect(), key=str) == sorted([("b", 1), ("a", 0), (None, None), ("b", 1)], key=str)


def test_split_by_a_label_of_few_classes_needs_no_shuffle_of_the_rows(spark, no_threshold):
    d = spark.range(200).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("y"))
    out = M.split_flag(d, ["id"], 0.2, 1, stratify="y")
    assert "BroadcastHashJoin" in _plan(out) and out.count() == 200


def test_quantiles_of_few_groups_and_trimmed_doses(spark, no_threshold):
    d = spark.range(100).select((F.col("id") % 2 == 0).alias("IsApproved"), F.col("id").cast("double").alias("DosageValue"))
    q = {r[0]: r[1] for r in grouped_quantiles(d, ["IsApproved"], "DosageValue", [0.0, 0.5, 1.0]).collect()}
    assert q == {True: [0.0, 49.0, 98.0], False: [1.0, 50.0, 99.0]}
    got = {r["IsApproved"]: (r["n"], r["min"], r["max"]) for r in dose_summary_by_approval(d).collect()}
    assert got == {True: (47, 0.0, 92.0), False: (47, 1.0, 93.0)}


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert session.dealt(spark.range(205), "id").rdd.getNumPartitions() == 21
    few = spark.range(50)
    assert session.dealt(few, "id") is few


def test_classifiers_keep_what_the_reports_read(spark):
    d = spark.range(0, 400, 1, 2).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), (F.col("id") % 3).alias("z"), (F.col("id") % 2).alias("IsApproved"))
    metrics, out = models.train_classifiers(d, d, ["x", "z"], key_cols=("k",), models=["Logistic Regression", "SVM"])
    assert all(p.columns == ["IsApproved", "prediction", "p1"] and p.count() == 400 for _, p in out.values())
    assert {r["model"] for r in metrics.collect()} == set(out)
    assert models.train_classifiers(d, d, ["x", "z"], key_cols=("k",), models=["Logistic Regression"], score=False)[0] is None


def test_fourier_features_are_those_of_the_formula(spark):
    import math
    import random

    from pyspark.ml.functions import array_to_vector, vector_to_array
    d = spark.createDataFrame([([0.5, -1.0],), ([2.0, 0.25],)], "v array<double>").withColumn("v", array_to_vector("v"))
    got = [r[0] for r in models._rff(d, "v", "o", 3, 2, 0.7, 5).select(vector_to_array("o")).collect()]
    rnd, want = random.Random(5), [[], []]
    for _ in range(3):
        w, b = [rnd.gauss(0.0, math.sqrt(1.4)) for _ in range(2)], rnd.uniform(0.0, 2 * math.pi)
        for row, x in zip(want, [[0.5, -1.0], [2.0, 0.25]]):
            row.append(math.sqrt(2 / 3) * math.cos(x[0] * w[0] + x[1] * w[1] + b))
    assert np.allclose(got, want, atol=1e-12)


def test_kmeans_over_equal_rows_fits_weighted_points(spark, monkeypatch):
    monkeypatch.setattr(models, "FIT_ROWS", 10)
    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: (seen.append(df.count()), fit(self, df))[1])
    d = spark.range(400).select("id", (F.col("id") % 4 * 10 + F.when(F.col("id") < 40, 1).otherwise(0)).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    res, labelled = models.kmeans_select(d, ["a", "b"], ks=[4], n_init=3)
    assert set(seen) == {8} and labelled.count() == 400
    whole, _ = models.scaled(models.assembled(d, ["a", "b"]))
    assert np.isclose(res.first()["inertia"], min(fit(KMeans(featuresCol="scaled", k=4, seed=s), whole).summary.trainingCost for s in range(4)))


def test_dates_are_counted_by_rows_and_parsed_by_value(spark):
    d = spark.createDataFrame([("2020-01-01", "x", None)] * 3 + [("no", "2020-01-01", None)] * 2, "a string, b string, c string")
    out = date_columns(d)
    assert [tuple(r) for r in out.collect()] == [("a", "parsed_values")]
    assert "keys=[column_name" in _plan(out)


def test_profiles_of_listed_items_only(spark):
    items = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, n string")
    entries = spark.createDataFrame([(1, "a", "f", 2.0), (2, None, "g", 1.0), (9, "z", "f", 1.0), (1, "a", "e", 1.0)], "k long, n string, feature string, value double")
    out = similarity._listed(items, entries, ["k", "n"])
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
    got = {tuple(r["item"]): [tuple(e) for e in r["profile"]] for r in out.collect()}
    assert got == {(1, "a"): [("e", 1.0), ("f", 2.0)], (2, None): [("g", 1.0)], (3, "c"): []}


def test_ended_trees_score_as_cut_paths():
    tree = (np.array([0, 1, -1, -1, -1]), np.array([0.5, 0.5, 0, 0, 0]), np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]),
            np.array([10, 6, 4, 3, 3]), np.array([0.5, 0.4, 0.7, 0.1, 0.9]))
    x = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    for deepest, least in [(30, 2), (1, 2), (0, 2), (30, 7), (30, 11)]:
        assert (G.leaf_shares(G.cut_tree(tree, deepest, least), x) == G.cut_shares(tree, x, [(deepest, least)])[:, 0]).all()
