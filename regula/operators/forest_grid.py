"""Random-forest grid search by nested evaluation.

One forest per fold and least leaf size is grown, on all rows of the other
folds, to the greatest depth and number of trees of the grid.  The smaller grid
points are read from it: fewer trees are its first trees, a lesser depth or a
greater least number of rows to split is the same tree with its paths ended
earlier, where each node's own class counts give the vote.  So 24 grid points
over 5 folds take 10 fits instead of 120, and the least number of rows to split
is an axis of the grid like the others.

What differs from growing each point by itself: the random feature subsets and
bags are those of the great forest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regula.operators.forest import Plan, bin_limits, cut_shares, grown, leaf_shares, packed  # noqa: F401
from regula.operators.ml_tables import auc
from regula.operators.models import FOREST_DEPTH, fit_partitions, stratified_folds
from regula.session import cut_lineage

POINT = ["n_trees", "max_depth", "min_split", "min_leaf"]


def forest_nodes(saved_model: DataFrame) -> DataFrame:
    """A fitted two-class forest as one row a node, from the table of its saved form:
    the split (rows with ``feature`` <= ``threshold`` go to ``left``; no split:
    feature, left and right are -1), the rows of the bag that reached the node
    and the share of label 1 among them.  Continuous features only."""
    node, split = F.col("nodeData"), F.col("nodeData.split")
    stats = node["impurityStats"]
    return saved_model.select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), split["featureIndex"].alias("feature"),
        F.coalesce(F.get(split["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("threshold"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["rawCount"].alias("n_rows"),
        F.coalesce(F.try_divide(F.get(stats, 1), stats[0] + F.get(stats, 1)), F.lit(0.0)).alias("share"))


def tree_arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """feature, threshold, left, right, n_rows, share of one tree by node id;
    ids of a tree are 0, 1, 2, ..."""
    nodes = nodes.sort_values("id")
    return tuple(nodes[c].to_numpy() for c in ("feature", "threshold", "left", "right", "n_rows", "share"))


def cut_tree(tree: tuple[np.ndarray, ...], deepest: int, least: int) -> tuple[np.ndarray, ...]:
    """The tree with its paths ended at a depth and at nodes of fewer rows than ``least``."""
    feature, threshold, left, right, n_rows, share = tree
    depth, level, d = np.zeros(len(left), np.int64), np.zeros(1, np.int64), 0
    while len(level):
        depth[level] = d
        inner = level[left[level] >= 0]
        level, d = np.concatenate([left[inner], right[inner]]), d + 1
    ends = (left < 0) | (depth >= deepest) | (n_rows < least)
    return feature, threshold, np.where(ends, -1, left), np.where(ends, -1, right), n_rows, share


def grouped_auc(scored: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve per group, ties by half; null where a group
    lacks a class.  A group is ordered by its distinct scores."""
    y = F.col(label) == 1
    w = Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    steps = (scored.groupBy(*group, score).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"))
                   .withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0))))
    return steps.groupBy(*group).agg(F.try_divide(
        F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)), F.sum("_p") * F.sum("_n")).alias("auc"))


def grid_scores(voted: DataFrame, fits: list[tuple[int, int]], trees, cuts: list[tuple[int, int]]) -> DataFrame:
    """Cross-validated AUC of every grid point, from fit, y and p of each row that
    the forest of a fit (``fits``: fold and least leaf size) has not seen; p holds the
    votes of the first ``trees`` and each of ``cuts`` in turn."""
    points = F.explode(F.array(*[
        F.struct(F.lit(n).alias("n_trees"), F.lit(d).alias("max_depth"), F.lit(least).alias("min_split"),
                 F.round(F.get("p", F.lit(i * len(cuts) + j)), 12).alias("p")) for i, n in enumerate(trees) for j, (d, least) in enumerate(cuts)]))
    fold, leaf = (F.get(F.array(*[F.lit(f[i]) for f in fits]), F.col("fit")) for i in (0, 1))
    rows = voted.select(fold.alias("fold"), leaf.alias("min_leaf"), "y", points.alias("g")).select("fold", "min_leaf", "y", "g.*")
    per_fold = grouped_auc(rows, [*POINT, "fold"], "p", "y")
    return per_fold.groupBy(*POINT).agg(F.avg("auc").alias("cv_auc"), F.stddev_pop("auc").alias("cv_std"))


def forest_grid_search(train: DataFrame, test: DataFrame, features: list[str], label: str = "IsApproved",
                       key_cols=("ApplNo", "SubmissionNo"), folds: int = 5, seed: int = 42, trees=(100, 200),
                       depths=(10, 20, FOREST_DEPTH), splits=(2, 5), leaves=(1, 2)) -> DataFrame:
    """One row per grid point: cv_auc and cv_std over stratified folds, rank (ties
    to the smaller forest), and test_auc of the best point, refitted on all of
    ``train`` and scored on every row of ``test`` (null for the other points).

    Raises ValueError where ``train`` does not hold both classes."""
    if train.select(label).distinct().count() < 2:
        raise ValueError("a grid search needs labelled rows of both classes")
    # the rows of ``test`` are one part more
    rows = stratified_folds(train.select(*dict.fromkeys([*key_cols, label, *features])), list(key_cols), label, folds, seed)
    rows = cut_lineage(rows.select(label, *features, "fold").unionByName(test.select(label, *features, F.lit(folds).alias("fold"))))
    blocks = packed(rows, features, label, "fold", bin_limits(train, features), fit_partitions(train))
    fits = [(f, leaf) for f in range(folds) for leaf in leaves]
    plans = [Plan(i, t, held=f, spare=folds, min_leaf=leaf) for i, (f, leaf) in enumerate(fits) for t in range(max(trees))]
    cuts = [(d, least) for d in depths for least in splits]
    _, voted = grown(blocks, plans, seed, max(depths), cuts, list(trees))
    scores = cut_lineage(grid_scores(voted, fits, trees, cuts))
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("cv_auc"), *POINT)))
    best = ranked.where("rank = 1").first()  # of a grid's few rows
    refit = [Plan(len(fits), t, held=folds, min_leaf=best["min_leaf"]) for t in range(best["n_trees"])]
    _, pred = grown(blocks, refit, seed, max(depths), [(best["max_depth"], best["min_split"])])
    pred = pred.select(F.col("y").alias(label), F.col("p")[0].alias("p1"))
    return ranked.crossJoin(F.broadcast(auc(pred, "p1", label).select("auc"))).select(
        *POINT, "cv_auc", "cv_std", "rank", F.when(F.col("rank") == 1, F.col("auc")).alias("test_auc"))
