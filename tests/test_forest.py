"""Forests on all rows: single trees against a plain search, shared levels, bins and the rows that each fit sees."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.sql import functions as F

from regula.operators import forest as T
from regula.operators import forest_grid as G
from regula.operators import ml_tables, models
from regula.plans import q_models
from regula.plans.registry import QUERIES

FEATURES = ["x0", "x1", "x2"]


class Stop(Exception):
    pass


@pytest.fixture(scope="module")
def table(spark):
    n = spark.range(0, 6000, 1, 4).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) / 50.0).alias(f"x{i}") for i in range(3)])
    noise = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)) < 2
    return n.withColumn("label", F.when(noise, F.col("id") % 2).otherwise((F.col("x0") + F.col("x1") > 1).cast("long")))


def _parts(table):
    return table.withColumn("part", (F.col("id") % 5 == 0).cast("int"))


def _gini(y):
    return 2 * y.sum() * (len(y) - y.sum()) / max(len(y), 1)


def _walk(tree, codes, y, node, depth, most, min_leaf):
    """The tree below a node against a plain search of its only feature."""
    feature, threshold, left, right, n_rows, share = tree
    assert n_rows[node] == len(y) and share[node] == pytest.approx(y.mean())
    gains = {t: _gini(y) - _gini(y[codes <= t]) - _gini(y[codes > t]) for t in range(codes.max() + 1)
             if min((codes <= t).sum(), (codes > t).sum()) >= min_leaf}
    if depth == most or max(gains.values(), default=0) <= 1e-9:
        assert left[node] == right[node] == feature[node] == -1
        return 0.0
    t = threshold[node]
    assert gains[t] == pytest.approx(max(gains.values()))
    below = codes <= t
    return gains[t] + (_walk(tree, codes[below], y[below], left[node], depth + 1, most, min_leaf)
                       + _walk(tree, codes[~below], y[~below], right[node], depth + 1, most, min_leaf))


@pytest.mark.parametrize("most, min_leaf, cells", [(30, 1, 1 << 20), (4, 3, 1 << 20), (30, 2, 64)])
def test_a_tree_equals_the_plain_search(monkeypatch, most, min_leaf, cells):
    monkeypatch.setattr(T, "CELLS", cells)
    rng = np.random.default_rng(most + min_leaf)
    codes, w = rng.integers(0, 20, (300, 1)).astype(np.uint8), rng.integers(1, 4, 300)
    y = (rng.random(300) < codes[:, 0] / 25).astype(np.uint8)
    tree, gains = T.grow(codes, y, w, rng, most, min_leaf)
    every = np.repeat(np.arange(300), w)
    assert gains.sum() == pytest.approx(_walk(tree, codes[every, 0], y[every], 0, 0, most, min_leaf))


def test_trees_of_many_features_end_in_pure_leaves():
    rng = np.random.default_rng(1)
    codes, y = rng.integers(0, 32, (500, 9)).astype(np.uint8), rng.integers(0, 2, 500).astype(np.uint8)
    tree, gains = T.grow(codes, y, np.ones(500, int), rng, 60)
    assert (T.leaf_shares(tree, codes) == y).all() and (gains > 0).all()
    assert tree[4][tree[2] < 0].sum() == 500 and gains.sum() == pytest.approx(_gini(y))
    alone, _ = T.grow(codes[:0], y[:0], np.ones(0, int), rng, 5)
    assert len(alone[0]) == 1


def test_bins_are_cut_by_all_rows(spark):
    d = spark.range(0, 40000, 1, 4).select((F.col("id") % 3).alias("a"), F.col("id").cast("double").alias("b"), F.lit(7).alias("c"),
                                           F.when(F.col("id") == 39999, 1).otherwise(0).alias("d"))
    a, b, c, rare = T.bin_limits(d, ["a", "b", "c", "d"])
    assert a.tolist() == [0.5, 1.5] and c.tolist() == [] and rare.tolist() == [0.5]
    assert len(b) == 31 and np.allclose(b, np.arange(1, 32) * 1250, atol=40000 * T.RANK_ERROR + 1)


def test_packed_rows_hold_every_row(spark, table):
    rows = T.packed(_parts(table), FEATURES, "label", "part", T.bin_limits(table, FEATURES), 3)
    assert rows.counts == {0: 4800, 1: 1200}
    found = [(y, p) for r in rows.blocks.collect() for y, p in zip(r["y"], r["part"])]
    assert len(found) == 6000 and sum(y for y, _ in found) == table.where("label = 1").count() and sum(p for _, p in found) == 1200


def test_shared_levels_split_as_one_task_does(spark, table, monkeypatch):
    """A single feature leaves no chance but the bag, which is the same."""
    rows = T.packed(_parts(table), ["x0"], "label", "part", T.bin_limits(table, ["x0"]), 3)
    plans = [T.Plan(0, t, held=1, min_leaf=2) for t in range(3)]
    cuts = [(4, 2), (6, 2), (30, 9)]

    def run():
        forests, scored = T.grown(rows, plans, 7, 30, cuts, [1, 3])
        return forests[0].featureImportances.toArray(), sorted((r["y"], [round(p, 9) for p in r["p"]]) for r in scored.collect())

    whole = run()
    monkeypatch.setattr(T, "TASK_BAG", 300)
    assert any(len(t.left) > 3 for t in T._shared_levels(rows, plans, 7, 4, 300))
    monkeypatch.setattr(T, "DEALT_BYTES", 12000)  # two batches
    parts = run()
    assert parts[1] == whole[1] and len(whole[1]) == 1200 and len(whole[1][0][1]) == 6
    assert whole[0].tolist() == parts[0].tolist() == [1.0]


def test_a_forest_scores_as_well_as_sparks(spark, table):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    train, test = (table.where(f"id % 5 {how} 0").withColumnRenamed("label", "IsApproved") for how in ("<>", "="))
    metrics, out = models.train_classifiers(train, test, FEATURES, key_cols=("id",), models=["Random Forest"])
    spark_s = RandomForestClassifier(labelCol="IsApproved", numTrees=100, maxDepth=30, seed=3).fit(models.assembled(train, FEATURES))
    pred = spark_s.transform(models.assembled(test, FEATURES)).withColumn("p1", vector_to_array("probability")[1])
    (got,), (want,) = metrics.collect(), models._metrics(pred, "Spark", "IsApproved").collect()
    assert abs(got["auc"] - want["auc"]) < 0.02 and abs(got["accuracy"] - want["accuracy"]) < 0.03
    model, scored = out["Random Forest"]
    assert np.allclose(model.featureImportances.toArray(), spark_s.featureImportances.toArray(), atol=0.05)
    assert scored.count() == 1200 and scored.where("prediction <> cast(p1 > 0.5 as double)").count() == 0


@pytest.mark.parametrize("kind, name", [(LogisticRegression, "Logistic Regression"), (GBTClassifier, "Gradient Boosting"), (LinearSVC, "SVM")])
def test_classifiers_are_fitted_on_all_training_rows(spark, table, monkeypatch, kind, name):
    seen = []

    def fit(self, df):
        seen.append(df.count())
        raise Stop

    monkeypatch.setattr(kind, "fit", fit)
    d = table.withColumnRenamed("label", "IsApproved")
    with pytest.raises(Stop):
        models.train_classifiers(d.where("id < 5000"), d.where("id >= 5000"), FEATURES, key_cols=("id",), models=[name], score=False)
    assert seen == [5000]


@pytest.mark.parametrize("query", ["K6_best_classifier_by_auc", "M6_roc_per_model", "M10_M11_reports_per_model"])
def test_queries_fit_all_models_on_all_training_rows(spark, monkeypatch, query):
    seen = {}
    d = spark.range(0, 6000, 1, 4).select(F.col("id").alias("ApplNo"), (F.col("id") % 7).alias("SubmissionNo"), (F.col("id") % 2).alias("IsApproved"),
                                          *[(F.col("id") % (i + 3)).alias(c) for i, c in enumerate(ml_tables.FEATURES)])
    monkeypatch.setattr(q_models, "_split_features", lambda *_: (d.where("ApplNo < 5000"), d.where("ApplNo >= 5000")))

    def stop(name, rows):
        seen[name] = rows
        raise Stop

    for kind in (LogisticRegression, GBTClassifier, LinearSVC):
        monkeypatch.setattr(kind, "fit", lambda self, df: stop(type(self).__name__, df.count()))
    monkeypatch.setattr(models, "grown", lambda rows, plans, *_: stop("Forest", {T._bag_rows(rows, p) for p in plans}))
    with pytest.raises(Stop):
        QUERIES[query](spark, "")
    assert seen == {"LogisticRegression": 5000, "GBTClassifier": 5000, "LinearSVC": 5000, "Forest": {5000}}


def _grown_on(monkeypatch, module):
    seen, real = [], T.grown
    monkeypatch.setattr(module, "grown", lambda rows, plans, *more: (seen.append([T._bag_rows(rows, p) for p in plans]), real(rows, plans, *more))[1])
    return seen


def test_the_forest_is_grown_on_all_training_rows(spark, table, monkeypatch):
    seen = _grown_on(monkeypatch, models)
    d = table.withColumnRenamed("label", "IsApproved")
    models.train_classifiers(d.where("id < 5000"), d.where("id >= 5000"), FEATURES, key_cols=("id",), models=["Random Forest"], score=False)
    assert seen == [[5000] * 100]


def test_the_grid_search_grows_on_all_rows_of_the_other_folds(spark, table, monkeypatch):
    seen = _grown_on(monkeypatch, G)
    found = G.forest_grid_search(table.where("id < 5000"), table.where("id >= 5000"), FEATURES, "label", ("id",), folds=4, trees=(1, 2),
                                 depths=(2, 6), splits=(2,), leaves=(1,)).collect()
    folds, refit = seen
    assert sum(folds) == 2 * 3 * 5000 and set(refit) == {5000}
    assert sorted(r["rank"] for r in found) == [1, 2, 3, 4] and all(r["cv_auc"] > 0.7 for r in found)
