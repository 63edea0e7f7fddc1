"""Ward clustering: merges against the plain method, summaries, labels."""

import numpy as np
import pytest

from regula.operators.ward import CFTree, ward_clusters, ward_cut


def plain_ward(x, k):
    """Merge the cheapest pair until k clusters are left, from all pairs."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a):
                n, m = len(groups[a]), len(groups[b])
                cost = n * m / (n + m) * ((x[groups[a]].mean(axis=0) - x[groups[b]].mean(axis=0)) ** 2).sum()
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        _, a, b = best
        groups[b] += groups.pop(a)
    return sorted(sorted(g) for g in groups)


def grouped(label):
    return sorted(sorted(int(i) for i in np.flatnonzero(label == c)) for c in set(label.tolist()))


@pytest.mark.parametrize("n, k", [(40, 5), (60, 2), (25, 25), (3, 5)])
def test_chains_give_the_plain_clusters(n, k):
    x = np.random.default_rng(n).normal(size=(n, 3))
    assert grouped(ward_cut(np.ones(n), x, k)) == plain_ward(x, k)


def test_tree_keeps_counts_and_sums():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2)) + rng.integers(0, 4, (3000, 1)) * 20
    tree = CFTree(2, 100)
    for v in x:
        tree.add(np.array([1.0, *v, float(v @ v)]))
    cf = tree.features()
    assert len(cf) <= 100 and cf[:, 0].sum() == 3000
    assert cf[:, 1:3].sum(axis=0) == pytest.approx(x.sum(axis=0)) and cf[:, 3].sum() == pytest.approx((x ** 2).sum())


def test_small_tables_are_clustered_as_by_the_plain_method(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(20, 2)) + c for c in ([0, 0], [5, 1], [1, 6], [7, 7])])
    x = np.concatenate([x, x[:3]])  # repeated rows
    df = spark.createDataFrame([(i, float(a), float(b), 3.0) for i, (a, b) in enumerate(x)] + [(-1, None, 1.0, 3.0)], "id long, a double, b double, c double")
    got = {r["id"]: r["cluster"] for r in ward_clusters(df, ["a", "b", "c"], 4).collect()}
    assert got.pop(-1) is None
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert grouped(np.array([got[i] for i in range(len(x))])) == plain_ward(z, 4)
    sizes = [sum(v == c for v in got.values()) for c in range(4)]
    assert sizes == sorted(sizes, reverse=True)
    assert {r["cluster"] for r in ward_clusters(df.where("id < 0"), ["a"], 3).collect()} == {None}


def test_summaries_of_many_tasks_find_the_same_groups(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [40, 0], [0, 40], [40, 40], [90, 90]])
    true = rng.integers(0, 5, 3000)
    x = centres[true] + rng.normal(size=(3000, 2))
    df = spark.createDataFrame([(int(t), float(a), float(b)) for t, (a, b) in zip(true, x)], "t int, a double, b double").repartition(12)
    got = ward_clusters(df, ["a", "b"], 5, summaries=40)
    pairs = {(r["t"], r["cluster"]) for r in got.select("t", "cluster").distinct().collect()}
    assert len(pairs) == 5
