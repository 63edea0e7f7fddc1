"""Two-class random forests on all rows of a table.

Rows are binned and packed into blocks of bytes.  For each tree every block
draws how often a row is in the tree's bag, and sends the bag to one task, which
grows the tree level by level with histograms and scores the rows held out from
it.  A tree whose bag is too large for one task (``TASK_BAG`` rows) has its first
levels split by histograms that all blocks add up; each cell below them is then a
task of its own.  So no tree is ever held in one place: what comes back is
each tree's share of the importances and, per block, the votes for held-out rows.

Settings are those of Spark ML's classifier: bags drawn with replacement, the
square root of the number of features tried per node, Gini impurity, features
cut into at most ``BINS`` bins, a node without gain is a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.session import cut_lineage, release, written

#: bins of a feature; rank error of their limits where a feature has more values
BINS, RANK_ERROR = 32, 1e-3
#: rows of one block, rows of a bag that one task grows
BLOCK_ROWS, TASK_BAG = 1 << 16, 1 << 20
#: levels that are grown by all blocks together, at most
SHARED_LEVELS = 10
#: histogram cells held at once, bytes of one batch, and of the bags dealt out at once
CELLS, BATCH_BYTES, DEALT_BYTES = 1 << 20, 1 << 23, 1 << 32
#: least gain of a split, in rows
LEAST_GAIN = 1e-9

Tree = tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Plan:
    """A tree to grow: on the rows of all parts but ``held`` and ``spare``; it
    scores the rows of part ``held`` (none: it scores nothing)."""
    fit: int
    tree: int
    held: int | None = None
    spare: int | None = None
    min_leaf: int = 1


@dataclass
class Forest:
    """What is kept of a grown forest."""
    numTrees: int
    featureImportances: DenseVector


@dataclass
class _Top:
    """The shared levels of a tree: a node that is not split is a cell."""
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    open: list[int] = field(default_factory=list)
    gains: dict[int, float] = field(default_factory=dict)

    def arrays(self) -> Tree:
        return tuple(np.array(x) for x in (self.feature, self.threshold, self.left, self.right))


# ------------------------------------------------------------------ one tree

def cut_shares(tree: Tree, rows: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """Share of label 1 where each row's path ends, one column per cut: a cut
    (depth, least) ends paths at that depth and at nodes of fewer rows."""
    feature, threshold, left, right, n_rows, share = tree
    at, out = np.zeros(len(rows), np.int64), np.full((len(rows), len(cuts)), np.nan)
    every, depth = np.arange(len(rows)), 0
    while np.isnan(out).any():
        leaf = left[at] < 0
        for j, (deepest, least) in enumerate(cuts):
            ends = np.isnan(out[:, j]) & (leaf | (depth >= deepest) | (n_rows[at] < least))
            out[ends, j] = share[at[ends]]
        goes_left = rows[every, np.maximum(feature[at], 0)] <= threshold[at]
        at = np.where(leaf, at, np.where(goes_left, left[at], right[at]))
        depth += 1
    return out


def leaves(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """Number of each row's leaf.  Only rows that are not there yet take the
    next step."""
    feature, threshold, left, right = tree[:4]
    at = np.zeros(len(rows), np.int64)
    on = np.arange(len(rows) if left[0] >= 0 else 0)
    while len(on):
        node = at[on]
        node = np.where(rows[on, feature[node]] <= threshold[node], left[node], right[node])
        at[on] = node
        on = on[left[node] >= 0]
    return at


def leaf_shares(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """Share of label 1 in each row's leaf."""
    return tree[5][leaves(tree, rows)]


def _impurity(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Gini impurity of a node times its rows."""
    return 2.0 * ones * (n - ones) / np.maximum(n, 1)


def best_splits(n: np.ndarray, ones: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Gain in rows and last bin of the left side of each node's best split of
    a feature, from its histograms (node x bin); no split: a gain below nought."""
    n, ones = n.cumsum(1), ones.cumsum(1)
    all_n, all_ones = n[:, -1:], ones[:, -1:]
    gain = _impurity(all_n, all_ones) - _impurity(n, ones) - _impurity(all_n - n, all_ones - ones)
    gain[(n < min_leaf) | (all_n - n < min_leaf)] = -1.0
    at = gain.argmax(1)
    return gain[np.arange(len(gain)), at], at


def some_features(rng: np.random.Generator, nodes: int, features: int) -> np.ndarray:
    """The features tried for each node."""
    return np.argsort(rng.random((nodes, features), np.float32), axis=1)[:, :math.ceil(math.sqrt(features))]


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, depth: int, min_leaf: int = 1) -> tuple[Tree, np.ndarray]:
    """A tree on binned rows that are in the bag ``w`` times, and its gains by feature.

    feature, threshold (bins up to it go left), left, right, n_rows, share by
    node; a leaf has feature, left and right -1.  Rows are kept in the order of
    their nodes and leave with their leaf."""
    features = codes.shape[1]
    w = w.astype(float)
    ones, starts = w * y, np.array([0, len(codes)])
    n, p = np.array([w.sum()], np.int64), np.array([ones.sum()], np.int64)
    levels, gains, made = [], np.zeros(features), 1
    for level in range(depth + 1):
        nodes = len(n)
        best, at, feature = np.full(nodes, -1.0), np.zeros(nodes, np.int64), np.full(nodes, -1)
        mixed = np.flatnonzero((p > 0) & (p < n) & (n >= 2 * min_leaf)) if level < depth else np.empty(0, np.int64)
        tried = some_features(rng, len(mixed), features)
        left_n, left_p = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        if len(mixed) < nodes:  # rows of pure nodes leave
            size = np.diff(starts)
            keep = np.zeros(nodes, bool)
            keep[mixed] = True
            stay, starts = np.flatnonzero(np.repeat(keep, size)), np.concatenate([[0], size[mixed].cumsum()])
            codes, w, ones = codes[stay], w[stay], ones[stay]
        step = max(CELLS // BINS, 1)
        for a in range(0, len(mixed), step):
            some, to = mixed[a:a + step], min(a + step, len(mixed))
            mine, every = slice(starts[a], starts[to]), np.arange(to - a)
            node = np.repeat(every, np.diff(starts[a:to + 1]))
            flat, weight, one = codes[mine].ravel(), w[mine], ones[mine]
            row, first = np.arange(len(node)) * features, node * BINS
            for f in tried[a:to].T:
                cell = first + flat[row + f[node]]
                hist_n = np.bincount(cell, weight, (to - a) * BINS).reshape(-1, BINS)
                hist_p = np.bincount(cell, one, (to - a) * BINS).reshape(-1, BINS)
                gain, last = best_splits(hist_n, hist_p, min_leaf)
                better = gain > np.maximum(best[some], LEAST_GAIN)
                who, b = some[better], every[better]
                best[who], at[who], feature[who] = gain[better], last[better], f[better]
                upto = np.arange(BINS) <= last[better][:, None]
                left_n[who], left_p[who] = (hist_n[b] * upto).sum(1), (hist_p[b] * upto).sum(1)
        split = feature >= 0
        left = np.full(nodes, -1)
        left[split] = made + 2 * np.arange(split.sum())
        made += 2 * int(split.sum())
        levels.append((feature, at, left, np.where(split, left + 1, -1), n, p / np.maximum(n, 1)))
        gains += np.bincount(feature[split], best[split], features)
        if not split.any():
            break
        # rows of the next level, children side by side
        node = np.repeat(mixed, np.diff(starts))
        rows = np.flatnonzero(split[node])
        node = node[rows]
        child = 2 * (split.cumsum() - 1)[node] + (codes.ravel()[rows * features + feature[node]] > at[node])
        rows = rows[np.argsort(child, kind="stable")]
        codes, w, ones = codes[rows], w[rows], ones[rows]
        starts = np.concatenate([[0], np.bincount(child, minlength=2 * int(split.sum())).cumsum()])
        n = np.stack([left_n[split], n[split] - left_n[split]], 1).ravel()
        p = np.stack([left_p[split], p[split] - left_p[split]], 1).ravel()
    return tuple(np.concatenate(x) for x in zip(*levels)), gains


# ------------------------------------------------------------ rows as blocks

@dataclass(frozen=True)
class Packed:
    """Rows as blocks (chunk, n, part, y, codes): row by row a byte for its part,
    its label and the bin of each feature; the rows of each part."""
    blocks: DataFrame
    counts: dict[int, int]
    features: int


def bin_limits(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Upper limits of each feature's bins but the last, from all rows: halfway
    between its values where there are at most ``BINS``, quantiles otherwise."""
    values = rows.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * len(features)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if len(seen[i]) <= BINS:
                    x = column.to_numpy(zero_copy_only=False)
                    seen[i] = np.union1d(seen[i], x[~np.isnan(x)])
        # one value too many is enough to know
        found = [(i, v) for i, s in enumerate(seen) for v in s[:BINS + 1]]
        yield pa.RecordBatch.from_pydict({"feature": pa.array([i for i, _ in found], pa.int32()), "v": pa.array([v for _, v in found], pa.float64())})

    few = values.mapInArrow(distinct, "feature int, v double").groupBy("feature").agg(F.sort_array(F.collect_set("v")).alias("v"))
    limits = {r["feature"]: np.array(r["v"]) for r in few.collect()}
    many = [i for i, v in limits.items() if len(v) > BINS]
    limits = {i: (v[1:] + v[:-1]) / 2 for i, v in limits.items()}
    if many:
        shares = [i / BINS for i in range(1, BINS)]
        for i, q in zip(many, values.approxQuantile([f"f{i}" for i in many], shares, RANK_ERROR)):
            limits[i] = np.unique(q)
    return [limits.get(i, np.empty(0)) for i in range(len(features))]


def packed(rows: DataFrame, features: list[str], label: str, part: str, limits: list[np.ndarray], partitions: int) -> Packed:
    """``rows`` in blocks.  They are dealt by their hash and put in order, so that
    blocks do not depend on the cluster."""
    flat = rows.select(F.col(part).cast("int").alias("part"), F.col(label).cast("int").alias("y"),
                       *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    flat = flat.repartition(partitions, F.xxhash64(*flat.columns)).sortWithinPartitions(*flat.columns)

    def block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        codes = np.stack([np.searchsorted(limits[i], t[f"f{i}"].to_numpy()).astype(np.uint8) for i in range(len(features))], 1)
        one = {"chunk": (TaskContext.get().partitionId() << 32) + number, "n": len(t), "part": t["part"].to_numpy().astype(np.uint8).tobytes(),
               "y": (t["y"].to_numpy() == 1).astype(np.uint8).tobytes(), "codes": codes.tobytes()}
        return pa.RecordBatch.from_pylist([one], pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("part", pa.binary()), ("y", pa.binary()), ("codes", pa.binary())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= BLOCK_ROWS:
                yield block(held, number)
                held, number = [], number + 1
        if held:
            yield block(held, number)

    blocks = cut_lineage(flat.mapInArrow(pack, "chunk long, n int, part binary, y binary, codes binary"))
    counts = {r["part"]: r["count"] for r in rows.groupBy(F.col(part).cast("int").alias("part")).count().collect()}
    return Packed(blocks, counts, len(features))


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for r in batch.to_pylist():
        part, y = (np.frombuffer(r[c], np.uint8) for c in ("part", "y"))
        yield r["chunk"], part, y, np.frombuffer(r["codes"], np.uint8).reshape(r["n"], -1)


def _bag(plan: Plan, seed: int, chunk: int, part: np.ndarray) -> np.ndarray:
    """How often each row of a block is in a tree's bag."""
    w = np.random.default_rng([seed, 1, plan.fit, plan.tree, chunk]).poisson(1.0, len(part)).astype(np.uint8)
    w[(part == plan.held) | (part == plan.spare)] = 0
    return w


def _tried(plan: Plan, seed: int, node: int, features: int) -> np.ndarray:
    return some_features(np.random.default_rng([seed, 2, plan.fit, plan.tree, node]), 1, features)[0]


def _bag_rows(rows: Packed, plan: Plan) -> int:
    return sum(n for part, n in rows.counts.items() if part not in (plan.held, plan.spare))


# --------------------------------------------------------------- many trees

def _add_up(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(h, np.int64) for h in table["hist"].to_pylist())
    return pa.table({"plan": table["plan"][:1], "node": table["node"][:1], "hist": pa.array([total.tobytes()], pa.binary())})


def _shared_levels(rows: Packed, plans: list[Plan], seed: int, levels: int, task_bag: int) -> list[_Top]:
    """Of each tree the levels above the nodes whose bag fits a task, each level
    split by histograms of all blocks."""
    tops = [_Top(open=[0] if _bag_rows(rows, p) > task_bag else []) for p in plans]
    for level in range(levels):
        asked = [(i, p, t.arrays(), t.open) for i, (p, t) in enumerate(zip(plans, tops)) if t.open]
        if not asked:
            break

        def count(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, part, y, codes in _each(batch):
                    found = []
                    for i, plan, top, nodes in asked:
                        w, at = _bag(plan, seed, chunk, part), leaves(top, codes)
                        for node in nodes:
                            mine = np.flatnonzero((at == node) & (w > 0))
                            hist = [np.bincount(codes[mine, f], x[mine], BINS) for f in _tried(plan, seed, node, codes.shape[1]) for x in (w, w * y)]
                            found.append({"plan": i, "node": node, "hist": np.array(hist).astype(np.int64).tobytes()})
                    yield pa.RecordBatch.from_pylist(found, pa.schema([("plan", pa.int32()), ("node", pa.int32()), ("hist", pa.binary())]))

        for top in tops:
            top.open = []
        sums = rows.blocks.mapInArrow(count, "plan int, node int, hist binary").groupBy("plan", "node").applyInArrow(_add_up, "plan int, node int, hist binary")
        for r in sorted(sums.collect(), key=lambda r: (r["plan"], r["node"])):  # one row an open node
            plan, top, node = plans[r["plan"]], tops[r["plan"]], r["node"]
            hist = np.frombuffer(r["hist"], np.int64).reshape(-1, 2, BINS).astype(float)
            gain, last = best_splits(hist[:, 0], hist[:, 1], plan.min_leaf)
            j = gain.argmax()
            if gain[j] <= LEAST_GAIN:
                continue
            feature = int(_tried(plan, seed, node, rows.features)[j])
            top.feature[node], top.threshold[node], top.left[node], top.right[node] = feature, int(last[j]), len(top.left), len(top.left) + 1
            top.gains[feature] = top.gains.get(feature, 0.0) + float(gain[j])
            for side in (slice(0, last[j] + 1), slice(last[j] + 1, BINS)):
                n, ones = hist[j, 0, side].sum(), hist[j, 1, side].sum()
                if n > task_bag and 0 < ones < n:
                    top.open.append(len(top.left))
                for column, value in ((top.feature, -1), (top.threshold, 0), (top.left, -1), (top.right, -1), (top.depth, level + 1)):
                    column.append(value)
    return tops


_DEALT = pa.schema([("plan", pa.int32()), ("cell", pa.int32()), ("chunk", pa.int64()), ("at", pa.binary()), ("y", pa.binary()), ("codes", pa.binary())])


def _deal(plans: list[Plan], tops: list[_Top], seed: int):
    """Blocks to rows of plan, cell, chunk: the rows in the bag (a byte of
    times and label each) and those to score (with their places)."""
    paths = [t.arrays() for t in tops]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for chunk, part, y, codes in _each(batch):
                for i, (plan, path) in enumerate(zip(plans, paths)):
                    w = _bag(plan, seed, chunk, part)
                    cell = leaves(path, codes)
                    for at, scored in ((np.flatnonzero(w), False), (np.flatnonzero(part == plan.held) if plan.held is not None else [], True)):
                        for c in np.unique(cell[at]) if len(at) else []:
                            mine = at[cell[at] == c]
                            found.append({"plan": i, "cell": int(c), "chunk": chunk, "at": mine.astype(np.int32).tobytes() if scored else None,
                                          "y": (y[mine] if scored else w[mine] | y[mine] << 7).tobytes(), "codes": codes[mine].tobytes()})
                            held += len(found[-1]["codes"])
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(found, _DEALT)
                        found, held = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, _DEALT)

    return deal


_VOTES = pa.schema([("fit", pa.int32()), ("tree", pa.int32()), ("chunk", pa.int64()), ("at", pa.binary()), ("y", pa.binary()),
                    ("votes", pa.binary()), ("gains", pa.list_(pa.float64()))])
_VOTES_SQL = "fit int, tree int, chunk long, at binary, y binary, votes binary, gains array<double>"


def _grow(plans: list[Plan], tops: list[_Top], seed: int, features: int, depth: int, cuts: list[tuple[int, int]]):
    """The dealt rows of a cell to its gains and its votes."""
    def one(table: pa.Table) -> pa.Table:
        i, cell = table["plan"][0].as_py(), table["cell"][0].as_py()
        plan, above = plans[i], tops[i].depth[cell]
        records = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        bag = [r for r in records if r["at"] is None]
        codes = np.frombuffer(b"".join(r["codes"] for r in bag), np.uint8).reshape(-1, features)
        times = np.frombuffer(b"".join(r["y"] for r in bag), np.uint8)
        tree, gains = grow(codes, times >> 7, times & 127, np.random.default_rng([seed, 3, plan.fit, plan.tree, cell]), depth - above, plan.min_leaf)
        out = [{"fit": plan.fit, "tree": plan.tree, "gains": gains.tolist()}]
        for r in records:
            if r["at"] is not None:
                rows = np.frombuffer(r["codes"], np.uint8).reshape(-1, features)
                whole = cuts == [(depth, 2)]
                votes = leaf_shares(tree, rows) if whole else cut_shares(tree, rows, [(d - above, least) for d, least in cuts])
                out.append({"fit": plan.fit, "tree": plan.tree, "chunk": r["chunk"], "at": r["at"], "y": r["y"], "votes": votes.tobytes()})
        return pa.Table.from_pylist(out, _VOTES)

    return one


_SUMS_SQL = "fit int, chunk long, at binary, y binary, sums binary"


def _sum(sizes: list[int], cuts: int):
    """A block's votes to their sums over the first trees of each size."""
    def one(table: pa.Table) -> pa.Table:
        records = sorted(table.to_pylist(), key=lambda r: r["tree"])
        first = [r for r in records if r["tree"] == records[0]["tree"]]
        at, y = np.concatenate([np.frombuffer(r["at"], np.int32) for r in first]), b"".join(r["y"] for r in first)
        order = np.argsort(at)
        at, y = at[order], np.frombuffer(y, np.uint8)[order]
        sums = np.zeros((len(at), len(sizes), cuts))
        for r in records:
            to, votes = np.searchsorted(at, np.frombuffer(r["at"], np.int32)), np.frombuffer(r["votes"]).reshape(-1, cuts)
            for j, size in enumerate(sizes):
                if r["tree"] < size:
                    sums[to, j] += votes
        return pa.table({"fit": table["fit"][:1], "chunk": table["chunk"][:1], "at": pa.array([at.tobytes()], pa.binary()),
                         "y": pa.array([y.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})

    return one


def _means(sizes: list[int], cuts: int):
    """A block's sums of all batches to a row for each scored row."""
    def one(table: pa.Table) -> pa.Table:
        records = sorted(table.to_pylist(), key=lambda r: r["batch"])
        y = np.frombuffer(records[0]["y"], np.uint8)
        total = sum(np.frombuffer(r["sums"]).reshape(len(y), len(sizes), cuts) for r in records) / np.array(sizes)[:, None]
        p = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(sizes) * cuts, pa.int32()), pa.array(total.ravel()))
        return pa.table({"fit": pa.array(np.full(len(y), records[0]["fit"]), pa.int32()), "y": pa.array(y.astype(np.int32)), "p": p})

    return one


def grown(rows: Packed, plans: list[Plan], seed: int, depth: int, cuts: list[tuple[int, int]] | None = None,
          sizes: list[int] | None = None) -> tuple[dict[int, Forest], DataFrame | None]:
    """The forests of ``plans`` by fit, and fit, y, p for each row that a forest
    scores (None: no plan holds rows out): the mean votes of its first trees, for
    each of ``sizes`` and each of ``cuts`` in turn (see ``cut_shares``; by default
    all trees, uncut).  As many trees at once as ``DEALT_BYTES`` of dealt rows allow."""
    if not all(_bag_rows(rows, p) for p in plans):
        raise ValueError("a forest needs rows to grow on")
    cuts = cuts or [(depth, 2)]
    sizes = sizes or [max(p.tree for p in plans) + 1]
    task_bag = max(TASK_BAG, *[least for _, least in cuts])
    levels = min(SHARED_LEVELS, depth, *[d for d, _ in cuts])
    share = sum(rows.counts.values()) * (rows.features + 1)
    step = max(DEALT_BYTES // max(share, 1), 1)
    gains, sums = {}, []
    for a in range(0, len(plans), step):
        some = plans[a:a + step]
        tops = _shared_levels(rows, some, seed, levels, task_bag)
        cells = sum(t.left.count(-1) for t in tops)
        dealt = rows.blocks.mapInArrow(_deal(some, tops, seed), "plan int, cell int, chunk long, at binary, y binary, codes binary")
        # several trees a task where there are many, so that tasks end alike
        dealt = dealt.repartition(cells if cells <= 128 else max(128, cells // 8), "plan", "cell")
        votes = written(dealt.groupBy("plan", "cell").applyInArrow(_grow(some, tops, seed, rows.features, depth, cuts), _VOTES_SQL))
        for plan, top in zip(some, tops):
            gains[plan.fit, plan.tree] = np.array([top.gains.get(f, 0.0) for f in range(rows.features)])
        for r in votes.where("gains is not null").select("fit", "tree", "gains").collect():  # one row a cell
            gains[r["fit"], r["tree"]] += r["gains"]
        if all(p.held is None for p in some):
            release(votes)
            continue
        added = votes.where("at is not null").groupBy("fit", "chunk").applyInArrow(_sum(sizes, len(cuts)), _SUMS_SQL)
        sums.append(cut_lineage(added.withColumn("batch", F.lit(a))))
        release(votes)
    scored = reduce(DataFrame.unionByName, sums).groupBy("fit", "chunk").applyInArrow(_means(sizes, len(cuts)), "fit int, y int, p array<double>") if sums else None
    forests = {}
    for fit in {p.fit for p in plans}:
        each = [g / g.sum() for (f, _), g in gains.items() if f == fit and g.sum() > 0]
        total = sum(each, np.zeros(rows.features))
        forests[fit] = Forest(sum(p.fit == fit for p in plans), DenseVector(total / max(total.sum(), LEAST_GAIN)))
    return forests, scored
