"""Grid search by nested evaluation against forests cut and grown one by one."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from regula.operators import forest_grid as G
from regula.operators.ml_tables import auc
from regula.operators.models import assembled, materialise
from regula.session import release, saved


@pytest.fixture(scope="module")
def table(spark):
    n = spark.range(0, 400, 1, 2).select(
        "id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)) / 50.0).alias(f"x{i}") for i in range(3)])
    noise = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10)) < 2
    return n.withColumn("label", F.when(noise, F.col("id") % 2).otherwise((F.col("x0") + F.col("x1") > 1).cast("long")))


def _forest(df, depth, n=6, **more):
    return RandomForestClassifier(labelCol="label", numTrees=n, maxDepth=depth, seed=3, **more).fit(df)


def _nodes(spark, model):
    t = saved(spark, model, "data")
    found = G.forest_nodes(t).toPandas()
    release(t)
    return [G.tree_arrays(g) for _, g in found.groupby("tree")]


def _matrix(df):
    return np.array([list(r["features"]) for r in df.select("features").collect()])


def _plain(tree, row, depth, least):
    feature, threshold, left, right, n_rows, share = tree
    at, d = 0, 0
    while left[at] >= 0 and d < depth and n_rows[at] >= least:
        at, d = (left[at] if row[feature[at]] <= threshold[at] else right[at]), d + 1
    return share[at]


def test_uncut_forest_scores_as_spark(spark, table):
    df = materialise(assembled(table, ["x0", "x1", "x2"]), 1)
    model = _forest(df, 12)
    expected = [r["p"] for r in model.transform(df).select(vector_to_array("probability")[1].alias("p")).collect()]
    got = np.mean([G.cut_shares(t, _matrix(df), [(30, 2)])[:, 0] for t in _nodes(spark, model)], axis=0)
    assert np.allclose(got, expected)


def test_cut_trees_vote_as_trees_grown_to_that_depth(spark, table):
    df = materialise(assembled(table, ["x0", "x1", "x2"]), 1)
    deep, shallow = (_nodes(spark, _forest(df, d, featureSubsetStrategy="all")) for d in (12, 4))
    x = _matrix(df)
    for a, b in zip(deep, shallow):
        cut, grown = G.cut_shares(a, x, [(4, 2)])[:, 0], G.cut_shares(b, x, [(30, 2)])[:, 0]
        assert ((cut > 0.5) == (grown > 0.5)).all()


def test_cuts_equal_the_plain_walk(spark, table):
    df = materialise(assembled(table, ["x0", "x1", "x2"]), 1)
    x, cuts = _matrix(df)[:60], [(0, 2), (3, 2), (30, 25), (5, 10)]
    x[0] = np.nan
    for tree in _nodes(spark, _forest(df, 10, 2)):
        assert np.allclose(G.cut_shares(tree, x, cuts), [[_plain(tree, row, *c) for c in cuts] for row in x])


def test_grouped_auc_equals_auc(spark):
    rows = [(g, (i * 7 + g) % 11 / 10, int((i * 5 + g) % 3 == 0)) for g in range(3) for i in range(40)] + [(9, 0.5, 1)]
    df = spark.createDataFrame(rows, "g int, p double, y int")
    got = {r["g"]: r["auc"] for r in G.grouped_auc(df, ["g"], "p", "y").collect()}
    assert got.pop(9) is None
    for g, value in got.items():
        assert abs(value - auc(df.where(F.col("g") == g), "p", "y").first()["auc"]) < 1e-12


def test_grid_search_ranks_every_point(spark, table):
    train, test = table.where("id % 4 > 0"), table.where("id % 4 = 0")
    found = G.forest_grid_search(train, test, ["x0", "x1", "x2"], "label", ("id",), folds=3, trees=(2, 4), depths=(1, 6),
                                 splits=(2, 40), leaves=(1, 2)).collect()
    assert len(found) == 16 and sorted(r["rank"] for r in found) == list(range(1, 17))
    by_rank = sorted(found, key=lambda r: r["rank"])
    assert [r["cv_auc"] for r in by_rank] == sorted((r["cv_auc"] for r in found), reverse=True)
    assert by_rank[0]["test_auc"] > 0.7 and all(r["test_auc"] is None for r in by_rank[1:])
    assert by_rank[0]["max_depth"] == 6  # one level cannot tell x0 + x1 > 1


def test_one_class_is_refused(spark, table):
    with pytest.raises(ValueError):
        one = table.where("label = 1")
        G.forest_grid_search(one, one, ["x0", "x1", "x2"], "label", ("id",))
