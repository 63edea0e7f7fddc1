"""Custom algorithms against brute force / known values on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regula.operators import ml_tables as M
from regula.operators.anomaly import isolation_forest
from regula.operators.similarity import similar_items


def test_isolation_forest_flags_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    rows += [(1000 + i, 8.0 + i, -8.0 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = isolation_forest(df, ["id"], ["a", "b"], n_trees=50, max_samples=128, contamination=0.05)
    r = {x["id"]: (x["AnomalyScore"], x["IsAnomaly"]) for x in out.collect()}
    assert len(r) == 405
    assert all(r[1000 + i][1] for i in range(5))
    inliers = sorted(v[0] for k, v in r.items() if k < 1000)
    assert max(r[1000 + i][0] for i in range(5)) < inliers[len(inliers) // 2]


def test_similarity_matches_dense_brute_force(spark):
    rng = np.random.default_rng(3)
    feats = ["f0", "f1", "f2", "f3"]
    items = [(i,) for i in range(40)]
    dense = rng.integers(0, 3, size=(40, 4)).astype(float)
    entries = [(i, feats[j], float(dense[i, j])) for i in range(40) for j in range(4) if dense[i, j] != 0]
    e = spark.createDataFrame(entries, "item long, feature string, value double")
    it = spark.createDataFrame(items, "item long")
    q = spark.createDataFrame([(0,), (1,)], "item long")
    got = {(r["q_item"], r["rank"]): (r["item"], r["SimilarityScore"]) for r in
           similar_items(e, it, ["item"], q, k=3).collect()}
    m, s = dense.mean(axis=0), dense.std(axis=0)
    z = np.where(s > 0, (dense - m) / np.where(s > 0, s, 1), 0.0)
    for qi in (0, 1):
        sims = []
        for i in range(40):
            if i == qi:
                continue
            den = np.linalg.norm(z[i]) * np.linalg.norm(z[qi])
            sims.append((round(float(z[i] @ z[qi] / den) if den > 1e-12 else 0.0, 10), i))
        sims.sort(key=lambda t: (-t[0], t[1]))
        for rank, (sv, i) in enumerate(sims[:3], 1):
            assert got[(qi, rank)][0] == i and got[(qi, rank)][1] == pytest.approx(sv)


def test_classification_report_and_confusion(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 3
    df = spark.createDataFrame([(a, float(b)) for a, b in pairs], "label int, prediction double")
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    assert rep["1"]["precision"] == pytest.approx(6 / 7) and rep["1"]["recall"] == pytest.approx(6 / 8)
    assert rep["0"]["support"] == 4 and rep["macro avg"]["support"] == 12
    cm = {r["label"]: (r["pred_0"], r["pred_1"]) for r in M.confusion_matrix(df).collect()}
    assert cm == {0: (3, 1), 1: (2, 6)}


def test_auc_matches_pairwise(spark):
    rng = np.random.default_rng(4)
    s = rng.integers(0, 10, size=200).astype(float)
    y = (rng.random(200) < s / 10).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert M.auc(df, "s", "y").first()["auc"] == pytest.approx(brute)


def test_split_is_disjoint_and_balanced(spark):
    df = spark.range(20000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    s = M.split_flag(df, ["id"], 0.2, 42)
    shares = {r["y"]: r["t"] for r in s.groupBy("y").agg(F.avg(F.col("is_test").cast("double")).alias("t")).collect()}
    assert all(abs(v - 0.2) < 0.03 for v in shares.values())
    assert s.count() == 20000


def test_davies_bouldin_two_blobs(spark):
    rows = [(i, [0.0 + (i % 3) * 0.1, 0.0], 0) for i in range(30)] + [(100 + i, [10.0 + (i % 3) * 0.1, 0.0], 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>, c int")
    r = M.davies_bouldin(df, "v", "c").first()
    assert r["n_clusters"] == 2 and r["davies_bouldin"] < 0.05
    assert not math.isnan(r["davies_bouldin"])
