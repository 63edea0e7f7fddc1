"""Isolation forest (M24) on Spark.

MLlib has no isolation forest, so the published algorithm (Liu, Ting & Zhou,
2008) is composed from Spark steps:

1. each tree draws its own sub-sample of ``max_samples`` rows: every row is
   offered to the trees whose seeded hash falls under a sampling rate, and a
   per-tree ``row_number() <= max_samples`` (map-side group limit) keeps the
   smallest hashes, so no task ever sees more than a sub-sample per tree;
2. trees are grown in ``groupBy('tree').applyInPandas`` (numpy), one task per
   tree, and emitted as node rows;
3. the node table (trees x nodes, bounded by n_trees * 2 * max_samples) is
   broadcast and rows are scored in Arrow batches by ``mapInPandas``;
4. the contamination threshold is the exact score percentile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search, c(n)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(pdf: pd.DataFrame, features: list[str], max_depth: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(seed * 100003 + tree)
    x = pdf[features].to_numpy(dtype="float64")
    rows = []
    stack = [(0, np.arange(len(x)), 0)]
    next_id = 1
    while stack:
        node, idx, depth = stack.pop()
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.where(hi > lo)[0]
        if len(usable) == 0:
            rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        left, right = next_id, next_id + 1
        next_id += 2
        rows.append((tree, node, f, thr, left, right, len(idx), depth))
        stack.append((left, idx[sub[:, f] < thr], depth + 1))
        stack.append((right, idx[sub[:, f] >= thr], depth + 1))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def _path_lengths(x: np.ndarray, forest: dict) -> np.ndarray:
    """Mean adjusted path length of every row over all trees (vectorised):
    rows descend level by level; a leaf adds its depth + c(leaf size)."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feat, thr, left, right, adj in forest.values():
        cur = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feat[cur]
            internal = f >= 0
            if not internal.any():
                break
            go_left = x[rows, np.where(internal, f, 0)] < thr[cur]
            cur = np.where(internal, np.where(go_left, left[cur], right[cur]), cur)
        total += adj[cur]
    return total / len(forest)


def isolation_forest(df: DataFrame, key_cols: list[str], features: list[str], *, n_trees: int = 100,
                     max_samples: int = 256, contamination: float = 0.05, seed: int = 42,
                     oversample: float = 3.0) -> DataFrame:
    """Anomaly score (``-2^(-E[h]/c(psi))``, lower = more anomalous, as
    ``score_samples`` reports it) and flag for the lowest ``contamination``
    share of rows."""
    spark = df.sparkSession
    from regula.operators.models import materialise
    from regula.operators.relational import global_quantiles
    from regula.session import cut_lineage
    data = materialise(df.select(*key_cols, *[F.col(c).cast("double").alias(c) for c in features]))
    n = data.count()
    psi = int(min(max_samples, n))
    rate = min(1.0, oversample * psi / max(n, 1))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    keys = [F.col(k) for k in key_cols]

    def u(t):
        return (F.abs(F.xxhash64(F.lit(seed), t, *keys)) % 1_000_000_007) / F.lit(1_000_000_007.0)

    offered = data.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                                                         lambda t: u(t) < rate)))
    offered = offered.withColumn("_u", u(F.col("tree")))
    w = Window.partitionBy("tree").orderBy("_u", *key_cols)
    sample = offered.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).drop("_r", "_u")
    nodes = (sample.groupBy("tree")
                   .applyInPandas(lambda p: _grow(p, features, max_depth, seed), NODE_SCHEMA)
                   .toPandas())
    forest = {}
    for t, g in nodes.groupby("tree"):
        g = g.sort_values("node")
        size = len(g)
        arr = lambda c, dt: np.asarray(g[c].to_numpy(), dtype=dt)
        assert (g["node"].to_numpy() == np.arange(size)).all()
        adj = arr("depth", np.float64) + np.array([c_factor(v) for v in g["size"].to_numpy()])
        forest[int(t)] = (arr("feature", np.int64), arr("threshold", np.float64), arr("left", np.int64),
                          arr("right", np.int64), adj)
    bc = spark.sparkContext.broadcast(forest)
    cn = c_factor(psi)
    out_schema = ", ".join([f"`{k}` {data.schema[k].dataType.simpleString()}" for k in key_cols]
                           + [f"`{c}` double" for c in features] + ["AnomalyScore double"])

    def score(batches):
        f = bc.value
        for pdf in batches:
            x = pdf[features].to_numpy(dtype="float64")
            eh = _path_lengths(x, f) if len(x) else np.zeros(0)
            pdf = pdf.copy()
            pdf["AnomalyScore"] = -np.power(2.0, -eh / cn) if cn > 0 else -np.ones(len(x))
            yield pdf

    scored = cut_lineage(data.mapInPandas(score, out_schema))  # scored once, read twice
    thr = global_quantiles(scored, "AnomalyScore", [contamination]).select(F.get("_q", F.lit(0)).alias("_off"))
    return (scored.crossJoin(F.broadcast(thr))
                  .withColumn("IsAnomaly", F.col("AnomalyScore") < F.col("_off")).drop("_off"))
