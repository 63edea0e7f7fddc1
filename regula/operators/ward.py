"""Bottom-up (Ward) clustering over mergeable clustering features.

Ward's method merges, at each step, the two clusters whose union adds least to
the squared distances within clusters.  That needs no rows, only each cluster's
count, sum and squared sum, and those add up when clusters merge.  So every task
reduces its rows to at most ``summaries`` clustering features (kept in a CF tree
of two levels: leaves of nearby features, and the leaves' own features to find
the nearest leaf by), tasks' features are merged in rounds of bounded groups, and
the dendrogram is built over what is left, at most ``GATHERED`` features.  A table
whose distinct rows fit into the summaries is clustered exactly as by the plain
method.

A row's cluster is that of its nearest final feature.  Rows without a value in
some feature have no cluster (null)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.session import cut_lineage

#: features a task keeps, tasks merged by one task, and features on the driver
SUMMARIES, FAN, GATHERED = 512, 8, 2048
#: entries of one leaf of the CF tree
LEAF = 32


def _cost(n, centre, m, centres):
    """What merging one cluster with each of others adds to the squares within."""
    return n * m / (n + m) * ((centre - centres) ** 2).sum(axis=1)


def ward_merges(counts: np.ndarray, sums: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, a, b) of all merges of Ward's method by rising cost; a and b are
    members of the merged clusters.  Nearest-neighbour chains: a pair that are
    each other's nearest merge at some time whatever else does, so no search
    over all pairs is needed."""
    n, s = counts.astype(float).copy(), sums.astype(float).copy()
    centres = s / n[:, None]
    alive, chain, out = np.ones(len(n), bool), [], []
    for _ in range(len(n) - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            tip = chain[-1]
            cost = _cost(n[tip], centres[tip], n, centres)
            cost[~alive] = np.inf
            cost[tip] = np.inf
            near = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
                near = chain[-2]
                break
            chain.append(near)
        chain = chain[:-2]
        out.append((float(cost[near]), tip, near))
        n[near] += n[tip]
        s[near] += s[tip]
        centres[near] = s[near] / n[near]
        alive[tip] = False
    return sorted(out)


def ward_cut(counts: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """Cluster (0, 1, ...) of each feature when ``k`` clusters are left."""
    parent = np.arange(len(counts))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, a, b in ward_merges(counts, sums)[:max(len(counts) - k, 0)]:
        parent[root(a)] = root(b)
    return np.unique([root(i) for i in range(len(counts))], return_inverse=True)[1]


def _reduced(cf: np.ndarray, k: int) -> np.ndarray:
    """Clustering features (count, sums, squared sum) merged to at most ``k``."""
    if len(cf) <= k:
        return cf
    label = ward_cut(cf[:, 0], cf[:, 1:-1], k)
    out = np.zeros((label.max() + 1, cf.shape[1]))
    np.add.at(out, label, cf)
    return out


class CFTree:
    """At most ``limit`` clustering features of the points seen.

    A point goes to its nearest leaf and there to its nearest feature, if that
    feature's radius stays within the threshold, else it is a feature of its
    own.  A full leaf is split around its farthest pair.  When there are more than
    ``limit`` features the threshold rises and leaves are merged within."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit, self.threshold, self.size = width, limit, 0.0, 0
        self.leaves: list[np.ndarray] = []

    def add(self, cf: np.ndarray) -> None:
        if not self.leaves:
            self.leaves.append(cf[None, :].copy())
            self.size = 1
            return
        centre = cf[1:-1] / cf[0]
        tops = np.array([leaf[:, :-1].sum(axis=0) for leaf in self.leaves]) if len(self.leaves) > 1 else None
        at = 0 if tops is None else int(((tops[:, 1:] / tops[:, :1] - centre) ** 2).sum(axis=1).argmin())
        leaf = self.leaves[at]
        near = int(((leaf[:, 1:-1] / leaf[:, :1] - centre) ** 2).sum(axis=1).argmin())
        both = leaf[near] + cf
        spread = both[-1] / both[0] - ((both[1:-1] / both[0]) ** 2).sum()
        same = (leaf[near, 1:-1] / leaf[near, 0] == centre).all()
        if same or (self.threshold and spread <= self.threshold):
            leaf[near] = both
            return
        self.leaves[at] = np.concatenate([leaf, cf[None, :]])
        self.size += 1
        if len(self.leaves[at]) > LEAF:
            self._split(at)
        if self.size > self.limit:
            self._shrink()

    def _split(self, at: int) -> None:
        leaf = self.leaves[at]
        centres = leaf[:, 1:-1] / leaf[:, :1]
        far = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        a, b = np.unravel_index(far.argmax(), far.shape)
        first = far[a] <= far[b]
        self.leaves[at:at + 1] = [leaf[first], leaf[~first]] if 0 < first.sum() < len(leaf) else [leaf]

    def _shrink(self) -> None:
        whole = self.features()
        merged = _reduced(whole, self.limit // 2)
        spread = merged[:, -1] / merged[:, 0] - ((merged[:, 1:-1] / merged[:, :1]) ** 2).sum(axis=1)
        self.threshold = max(self.threshold, float(np.median(spread[merged[:, 0] > 1])))
        self.leaves, self.size = [merged], len(merged)
        while max(map(len, self.leaves)) > LEAF:
            at = max(range(len(self.leaves)), key=lambda i: len(self.leaves[i]))
            before = len(self.leaves)
            self._split(at)
            if len(self.leaves) == before:
                break

    def features(self) -> np.ndarray:
        return np.concatenate(self.leaves) if self.leaves else np.zeros((0, self.width + 2))


_CF = "task long, cf array<double>"


def _rows(task: int, cf: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task] * len(cf), pa.int64()), pa.array(cf.tolist(), pa.list_(pa.float64()))], names=["task", "cf"])


def clustering_features(points: DataFrame, width: int, summaries: int = SUMMARIES) -> np.ndarray:
    """At most ``GATHERED`` clustering features of all ``points`` (x: array of
    ``width`` doubles)."""
    def summed(batches):
        tree, task = CFTree(width, summaries), 0
        for batch in batches:
            task = batch.column("task")[0].as_py() if batch.num_rows else task
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, width)
            values, counts = np.unique(x, axis=0, return_counts=True)
            for v, c in zip(values, counts):
                tree.add(np.array([c, *(c * v), c * float(v @ v)]))
        yield _rows(task, tree.features())

    found = cut_lineage(points.select(F.spark_partition_id().cast("long").alias("task"), "x").mapInArrow(summed, _CF))

    def merged(table: pa.Table) -> pa.Table:
        cf = np.array(table["cf"].to_pylist(), float)
        out, at = np.zeros((0, width + 2)), 0
        while at < len(cf):  # a bounded number at once
            out = _reduced(_unique(np.concatenate([out, cf[at:at + summaries]])), summaries)
            at += summaries
        return pa.Table.from_batches([_rows(table["task"][0].as_py(), out)])

    while found.count() > GATHERED:
        tasks = found.agg(F.countDistinct("task")).first()[0]
        groups = max(1, math.ceil(tasks / FAN))
        ranked = F.pmod(F.xxhash64("task"), F.lit(groups))
        found = cut_lineage(found.select(ranked.alias("task"), "cf").groupBy("task").applyInArrow(merged, _CF))
        if groups == 1:
            break
    rows = found.orderBy("cf").collect()  # GATHERED features at most
    return _unique(np.array([r["cf"] for r in rows], float).reshape(len(rows), width + 2))


def _unique(cf: np.ndarray) -> np.ndarray:
    """Features at the same centre as one."""
    if not len(cf):
        return cf
    _, label = np.unique(cf[:, 1:-1] / cf[:, :1], axis=0, return_inverse=True)
    out = np.zeros((label.max() + 1, cf.shape[1]))
    np.add.at(out, label.ravel(), cf)
    return out


def ward_clusters(df: DataFrame, features: list[str], k: int = 5, *, out: str = "cluster", scaled: str | None = None,
                  summaries: int = SUMMARIES) -> DataFrame:
    """``df`` with the cluster of each row, 0 being the largest (ties by
    centre).  Features are standardised by all rows (population deviation, as
    constant ones are left at nought); ``scaled`` names a column for them."""
    df = cut_lineage(df)  # read by the statistics, the summaries and the labels
    x = [F.col(f"`{c}`").cast("double") for c in features]
    stats = df.where(F.size(F.filter(F.array(*x), lambda v: v.isNull())) == 0).agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x)]).first()
    whole = F.size(F.filter(F.array(*x), lambda v: v.isNull())) == 0
    parts = [(v - F.lit(stats[f"m{i}"] or 0.0)) / F.lit(stats[f"s{i}"] or 1.0) for i, v in enumerate(x)]
    vector = F.when(whole, F.array(*parts))
    cf = clustering_features(df.select(vector.alias("x")).where("x is not null"), len(features), summaries)
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if not len(cf):
        none = df.withColumn(out, F.lit(None).cast("int"))
        return none.withColumn(scaled, vector) if scaled else none
    label = ward_cut(cf[:, 0], cf[:, 1:-1], k)
    groups = np.zeros((label.max() + 1, cf.shape[1]))
    np.add.at(groups, label, cf)
    order = sorted(range(len(groups)), key=lambda i: (-groups[i, 0], tuple(groups[i, 1:-1] / groups[i, 0])))
    number = np.empty(len(groups), np.int64)
    number[order] = np.arange(len(groups))
    label, centres = number[label], cf[:, 1:-1] / cf[:, :1]

    def nearest(batches):
        for batch in batches:
            found = np.empty(batch.num_rows, object)
            vectors = batch.column("_x")
            at = np.flatnonzero(np.asarray(vectors.is_valid()))
            x = np.array(vectors.drop_null().to_pylist(), float).reshape(len(at), len(features))
            for i in range(0, len(x), 1024):
                far = ((x[i:i + 1024, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
                found[at[i:i + 1024]] = label[far.argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.int32())], names=[*batch.schema.names, "_cluster"])

    fields = ", ".join(f"`{c}` {t}" for c, t in kind.items())
    labelled = df.withColumn("_x", vector).mapInArrow(nearest, f"{fields}, _x array<double>, _cluster int")
    return labelled.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_cluster").alias(out), *([F.col("_x").alias(scaled)] if scaled else []))
