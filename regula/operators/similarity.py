"""Item similarity recommendations (M23) without an all-pairs matrix.

Items are described by sparse count profiles (item, feature, value).  After
column standardisation (mean m_f, population std s_f over all items) the
cosine of two items expands into sums over their *non-zero* entries:

    x.y  = sum_f x_f y_f / s_f^2 - A_x - A_y + K,   A_x = sum_f m_f x_f / s_f^2,
    |x|^2 = sum_f x_f^2 / s_f^2 - 2 A_x + K,         K   = sum_f m_f^2 / s_f^2

so no dense vector is built.  Items with equal profiles are one *class*; only
classes are compared, and a class carries the few least items that can be
anybody's neighbours.

Exact search (``similar_items``): classes are dealt into bounded shards by their
heaviest feature, and each shard is an inverted index from features to the
impacts of its classes.  A query is answered by its own shard first; the k-th
score found there and the shards' greatest impacts then tell which other shards
could still hold a better class, and the query visits only those.  Inside a
shard the features are taken heaviest first, and classes that the remaining
features cannot lift to the k-th score are given up.

Approximate search (``similar_items_lsh``): classes share a bucket where the
signs of their projections on random +-1 directions agree; a query is compared
with the classes of its buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regula.session import cut_lineage, dealt

#: classes of one shard and queries of one block, on average
SHARD, BLOCK = 4096, 1024
#: room for rounding when a bound is held against a score
SLACK = 1e-9
#: norms below this count as nought: such a profile is like nothing (similarity 0)
LEAST_NORM = 1e-12
#: classes up to which the result lists are broadcast; beyond, joins are salted
FEW_CLASSES, SALTS = 1 << 14, 32
#: entries of an item, about
ENTRIES = 4
#: decimals of a score: mathematically equal scores tie exactly, and the item decides
DIGITS = 10


def profile_entries(products: DataFrame, apps: DataFrame, *, key: str = "ApplNo", item=("ApplNo", "DrugName"),
                    form: str = "Form", type_col: str = "ApplType", ref: str = "ReferenceDrug") -> DataFrame:
    """Sparse drug profiles: per (ApplNo, DrugName), counts of each form and
    application type and the summed reference flag.  Each product row emits
    its (feature, value) pairs, so one aggregation builds every feature."""
    items = list(item)
    j = dealt(products.select(*dict.fromkeys([key, *items, form, ref])), key).join(apps.select(key, type_col), key, "inner")
    pairs = F.array(
        F.struct(F.concat(F.lit("Form_"), F.col(form)).alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.concat(F.lit("Type_"), F.col(type_col)).alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.lit(ref).alias("feature"), F.coalesce(F.col(ref).cast("double"), F.lit(0.0)).alias("value")))
    e = j.select(*items, F.explode(pairs).alias("_e")).select(*items, "_e.feature", "_e.value")
    return (e.filter(F.col("feature").isNotNull()).groupBy(*items, "feature").agg(F.sum("value").alias("value"))
             .filter(F.col("value") != 0))


def _listed(items: DataFrame, entries: DataFrame, item_cols: list[str]) -> DataFrame:
    """item (struct), cid, profile: every item with its class.  Classes are told
    apart by a 128-bit digest of the sorted profile."""
    item = F.struct(*[F.col(f"`{c}`") for c in item_cols]).alias("item")
    entry = F.struct(F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value"))
    all_items = items.select(item).distinct()
    # an item's own row has no entry, which a list leaves out: no join of items and profiles
    rows = (all_items.select("item", F.lit(True).alias("listed"), F.lit(None).cast("struct<feature:string,value:double>").alias("e"))
            .unionByName(entries.where("feature is not null and value <> 0").select(item, F.lit(False).alias("listed"), entry.alias("e"))))
    profile = F.sort_array(F.collect_list("e")).alias("profile")
    out = dealt(rows, "item", rows=items.count() * ENTRIES).groupBy("item").agg(profile, F.bool_or("listed").alias("listed")).where("listed")
    return cut_lineage(out.select("item", "profile", F.md5(F.to_json("profile")).alias("cid")))


def _members(listed: DataFrame, n: int) -> DataFrame:
    """cid, members: the ``n`` least items of each class, in order."""
    w = Window.partitionBy("cid").orderBy("item")
    few = listed.select("cid", "item").withColumn("at", F.row_number().over(w)).where(F.col("at") <= n)
    return few.groupBy("cid").agg(F.sort_array(F.collect_list("item")).alias("members"))


def _classes(listed: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """cid, first (least item), a, norm (|x|), feature, value, y (arrays; y =
    value / variance) and heavy (feature of the greatest part of |x|) of each
    class; mean m and w = 1 / variance of each feature; the constant K.
    Features without variance are left out."""
    sizes = cut_lineage(listed.groupBy("cid").agg(F.count("*").alias("n"), F.min("item").alias("first"), F.first("profile").alias("profile")))
    each = sizes.select("cid", "n", F.explode("profile").alias("e")).select("cid", "n", "e.*")
    total = F.lit(sizes.agg(F.sum("n")).first()[0] or 1)
    sums = each.groupBy("feature").agg(F.sum(F.col("n") * F.col("value")).alias("s1"), F.sum(F.col("n") * F.col("value") ** 2).alias("s2"))
    mean = F.col("s1") / total
    stats = (sums.select("feature", mean.alias("m"), (F.col("s2") / total - mean ** 2).alias("var"))
             .where("var > 1e-12").select("feature", "m", (1 / F.col("var")).alias("w")))
    stats = cut_lineage(stats)
    k = stats.agg(F.sum(F.col("m") ** 2 * F.col("w"))).first()[0] or 0.0
    weighed = each.join(stats, "feature")
    part = F.struct(F.abs(F.col("value") ** 2 * F.col("w")).alias("part"), "feature")
    vectors = weighed.groupBy("cid").agg(
        F.sum(F.col("m") * F.col("value") * F.col("w")).alias("a"), F.sum(F.col("value") ** 2 * F.col("w")).alias("q"),
        F.max(part)["feature"].alias("heavy"),
        F.sort_array(F.collect_list(F.struct("feature", "value", (F.col("value") * F.col("w")).alias("y")))).alias("e"))
    norm = F.sqrt(F.greatest(F.coalesce("q", F.lit(0.0)) - 2 * F.coalesce("a", F.lit(0.0)) + F.lit(k), F.lit(0.0)))
    none = F.array().cast("array<struct<feature:string,value:double,y:double>>")
    out = sizes.join(vectors, "cid", "left").withColumn("e", F.coalesce("e", none))
    return cut_lineage(out.select("cid", "first", F.coalesce("a", F.lit(0.0)).alias("a"), norm.alias("norm"), "heavy",
                                  F.col("e.feature").alias("feature"), F.col("e.value").alias("value"), F.col("e.y").alias("y"))), stats, float(k)


class _Index:
    """Inverted index of one shard of classes, which keep their order."""

    def __init__(self, shard: pa.Table, k: float):
        self.cids, self.constant = shard["cid"].to_pylist(), k
        norm = shard["norm"].to_numpy()
        self.inverse = np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > LEAST_NORM)
        self.base = -shard["a"].to_numpy() * self.inverse
        owner = np.repeat(np.arange(len(shard)), pc.list_value_length(shard["feature"]).to_numpy())
        names = pc.list_flatten(shard["feature"]).combine_chunks().dictionary_encode()
        codes = names.indices.to_numpy()
        impacts = pc.list_flatten(shard["y"]).to_numpy() * self.inverse[owner]
        order = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
        self.postings = {f: (owner[order[i:j]], impacts[order[i:j]]) for f, i, j in zip(names.dictionary.to_pylist(), cuts, cuts[1:])}
        self.computed = 0

    def search(self, a: float, norm: float, features, values, n: int, least: float) -> list[tuple[str, float]]:
        """The ``n`` classes most like a query, ties by order; classes below the
        score ``least`` need not be found."""
        if norm <= LEAST_NORM:
            return [(c, 0.0) for c in self.cids[:n]]
        score = (self.base + (self.constant - a) * self.inverse) / norm
        terms = []
        for f, v in zip(features, values):
            if f in self.postings:
                ids, impacts = self.postings[f]
                gains = impacts * (v / norm)
                terms.append((max(gains.max(), 0.0), min(gains.min(), 0.0), ids, gains))
        terms.sort(key=lambda t: t[1] - t[0])
        up, down = sum(t[0] for t in terms), sum(t[1] for t in terms)
        alive = np.ones(len(score), bool)
        for high, low, ids, gains in [*terms, (0.0, 0.0, None, None)]:
            if alive.sum() > n:
                least = max(least, np.partition(score[alive], -n)[-n] + down)
            alive &= score + up >= least - SLACK
            if ids is None or not alive.any():
                break
            hit = alive[ids]
            score[ids[hit]] += gains[hit]
            self.computed += int(hit.sum())
            up, down = up - high, down - low
        rows = np.flatnonzero(alive)
        best = rows[np.lexsort((rows, -np.round(score[rows], DIGITS)))][:n]
        return [(self.cids[i], float(score[i])) for i in best]


def _visit(queries: DataFrame, shards: DataFrame, keys: list[str], k: float, n: int) -> DataFrame:
    """query, cid, score: the best classes of a group's shard for the group's
    queries; a group holds one shard and one block of queries."""
    item = shards.schema["first"].dataType.fields
    order = [(f"f{i}", "ascending") for i in range(len(item))]
    out = pa.schema([("query", pa.string()), ("cid", pa.string()), ("score", pa.float64())])

    def search(asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(asked) or not len(shard):
            return out.empty_table()
        index = _Index(shard.take(pc.sort_indices(shard, sort_keys=order, null_placement="at_start")), k)
        found = [{"query": q["cid"], "cid": c, "score": s} for q in asked.to_pylist()
                 for c, s in index.search(q["a"], q["norm"], q["feature"], q["value"], n, q["least"])]
        return pa.Table.from_pylist(found, out)

    # new names, for both sides may come from the same rows
    flat = shards.select(*[F.col(c).alias(c) for c in (*keys, "cid", "a", "norm", "feature", "y")],
                         *[F.col("first")[f.name].alias(o) for f, (o, _) in zip(item, order)])
    asked = queries.select(*[F.col(c).alias(c) for c in (*keys, "cid", "a", "norm", "feature", "value", "least")])
    return asked.groupBy(*keys).cogroup(flat.groupBy(*keys)).applyInArrow(search, "query string, cid string, score double")


def _best(found: DataFrame, first: DataFrame, n: int) -> DataFrame:
    """The ``n`` best classes of each query, equal scores by the classes' least item."""
    score = F.round("score", DIGITS)
    w = Window.partitionBy("query").orderBy(score.desc(), "first")
    return found.join(first, "cid").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("score", score)


def _bounds(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each shard: the ranges of base and inverse, and per feature the range
    of impacts (nought included)."""
    inverse = F.when(F.col("norm") > LEAST_NORM, 1 / F.col("norm")).otherwise(F.lit(0.0))
    base = -F.col("a") * inverse
    whole = classes.groupBy("heavy", "piece").agg(F.max(base).alias("base"), F.min(inverse).alias("inv_lo"), F.max(inverse).alias("inv_hi"))
    each = classes.select("heavy", "piece", inverse.alias("inv"), F.explode(F.arrays_zip("feature", "y")).alias("e"))
    impact = F.col("e.y") * F.col("inv")
    high, low = F.greatest(F.max(impact), F.lit(0.0)).alias("high"), F.least(F.min(impact), F.lit(0.0)).alias("low")
    return whole, each.groupBy("heavy", "piece", F.col("e.feature").alias("feature")).agg(high, low)


def _routes(queries: DataFrame, classes: DataFrame, k: float) -> DataFrame:
    """query, heavy, piece: the shards, but the query's own, whose bound
    reaches the query's least useful score.

    Stated queries are taken against shards, of which there is one in about
    ``SHARD`` classes; classes do not meet here."""
    whole, each = _bounds(classes)
    wanted = queries.select(F.col("cid").alias("query"), "a", "norm", "least", F.col("heavy").alias("own"), F.col("piece").alias("own_piece"))
    terms = queries.select(F.col("cid").alias("query"), F.explode(F.arrays_zip("feature", "value")).alias("e"))
    value = F.col("e.value")
    gain = F.when(value > 0, value * F.col("high")).otherwise(value * F.col("low"))
    dots = (terms.join(each, F.col("e.feature") == F.col("feature")).groupBy("query", "heavy", "piece").agg(F.sum(gain).alias("dot")))
    open_ = F.lit(k) - F.col("a")
    top = F.col("base") + F.greatest(open_ * F.col("inv_lo"), open_ * F.col("inv_hi"))
    pairs = wanted.crossJoin(whole).where(~(F.col("own").eqNullSafe(F.col("heavy")) & (F.col("own_piece") == F.col("piece"))))
    pairs = pairs.withColumnsRenamed({"heavy": "h", "piece": "p", "query": "q"})
    joined = pairs.join(dots, (F.col("q") == F.col("query")) & F.col("h").eqNullSafe(F.col("heavy")) & (F.col("p") == F.col("piece")), "left")
    bound = F.when(F.col("norm") <= LEAST_NORM, F.lit(0.0)).otherwise((top + F.coalesce("dot", F.lit(0.0))) / F.col("norm"))
    return joined.where(bound >= F.col("least") - SLACK).select(F.col("q").alias("query"), F.col("h").alias("heavy"), F.col("p").alias("piece"))


def _asked(listed: DataFrame, queries: DataFrame | None, item_cols: list[str]) -> DataFrame:
    if queries is None:
        return listed.select("item", "cid")
    stated = queries.select(F.struct(*[F.col(f"`{c}`") for c in item_cols]).alias("of")).distinct()
    return cut_lineage(listed.select("item", "cid").join(stated, F.col("item").eqNullSafe(F.col("of")), "left_semi"))


def _expanded(best: DataFrame, listed: DataFrame, asked: DataFrame, item_cols: list[str], k: int) -> DataFrame:
    """From neighbouring classes to each query item's ``k`` neighbours.

    A query class has one list of its k + 1 best items (an item is at most its
    own neighbour once), so a common profile's queries share it."""
    rows = best.select("query", "cid", "score").join(_members(listed, k + 1), "cid").select("query", "score", F.explode("members").alias("item"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "item")
    few = rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k + 1)
    lists = cut_lineage(few.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "score", "item"))).alias("list")))
    own = asked.select(F.col("item").alias("of"), "cid")
    if lists.count() <= FEW_CLASSES:
        joined = own.join(F.broadcast(lists), F.col("cid") == F.col("query"))
    else:
        salted = lists.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", F.pmod(F.xxhash64("of"), F.lit(SALTS)).cast("int")).join(
            salted, (F.col("cid") == F.col("query")) & (F.col("salt") == F.col("salt_of")))
    others = F.slice(F.filter("list", lambda x: ~x["item"].eqNullSafe(F.col("of"))), 1, k)
    out = joined.select("of", F.posexplode(others).alias("at", "n"))
    return out.select(*[F.col("of")[c].alias(f"q_{c}") for c in item_cols], *[F.col("n.item")[c].alias(c) for c in item_cols],
                      F.col("n.score").alias("SimilarityScore"), (F.col("at") + 1).cast("int").alias("rank"))


def similar_items(entries: DataFrame, items: DataFrame, item_cols: list[str], queries: DataFrame | None = None, *, k: int = 5,
                  shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Top-k most similar other items for each item of ``queries``, or for
    every item where none are stated, taken against all items (cosine of the standardised profiles;
    profiles at the mean have similarity 0).  Exact; equal scores by item.

    ``q_<item columns>``, the neighbour's item columns, SimilarityScore, rank."""
    listed = _listed(items, entries, item_cols)
    asked = _asked(listed, queries, item_cols)
    classes, _, const = _classes(listed)
    # shards: classes of one heaviest feature, cut by hash into pieces of bounded size
    pieces = classes.groupBy("heavy").agg(F.ceil(F.count("*") / F.lit(shard)).alias("pieces")).withColumnRenamed("heavy", "h")
    classes = classes.join(pieces, F.col("heavy").eqNullSafe(F.col("h"))).drop("h")
    classes = cut_lineage(classes.withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("pieces"))).drop("pieces"))
    first = classes.select("cid", "first")
    own = classes.join(asked.select("cid").distinct(), "cid", "left_semi").withColumn("least", F.lit(float("-inf")))
    # least scores of the own shard first, then the other shards that may beat them
    home = cut_lineage(_visit(own, classes, ["heavy", "piece"], const, k + 1))
    least = home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    known = own.drop("least").join(least, F.col("cid") == F.col("query"), "left")
    known = known.withColumn("least", F.when(F.col("n") > k, F.col("low")).otherwise(F.lit(float("-inf")))).drop("query", "n", "low")
    known = cut_lineage(known)
    routes = _routes(known, classes, const).join(known.drop("heavy", "piece"), F.col("query") == F.col("cid"))
    sizes = routes.groupBy("heavy", "piece").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    sizes = cut_lineage(sizes.withColumnsRenamed({"heavy": "h", "piece": "p"}))
    same: Column = F.col("heavy").eqNullSafe(F.col("h")) & (F.col("piece") == F.col("p"))
    routed = routes.join(sizes, same).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).drop("h", "p", "blocks")
    copies = classes.join(sizes, same).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("h", "p", "blocks")
    away = _visit(routed, copies, ["heavy", "piece", "block"], const, k + 1)
    best = _best(home.unionByName(away), first, k + 1)
    return _expanded(best, listed, asked, item_cols, k)


def _signs(classes: DataFrame, stats: DataFrame, tables: int, bits: int) -> DataFrame:
    """cid, table, sign: on which side of ``bits`` random hyperplanes through
    the mean each class lies, once per table.  A feature's +-1 in a direction
    is a bit of its hash."""
    numbered = F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table")

    def sums(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        way = [F.sum(F.col("z") * (1 - 2 * F.shiftright(F.xxhash64("feature", "table"), i).bitwiseAND(F.lit(1)))).alias(f"{name}{i}") for i in range(bits)]
        return rows.groupBy(*keys).agg(*way)

    each = classes.select("cid", F.explode(F.arrays_zip("feature", "value")).alias("e")).select("cid", "e.*").join(stats, "feature")
    ahead = sums(each.select("cid", numbered, "feature", (F.col("value") * F.sqrt("w")).alias("z")), ["cid", "table"], "p")
    means = sums(stats.select(numbered, "feature", (F.col("m") * F.sqrt("w")).alias("z")), ["table"], "c")  # one row a table
    found = classes.select("cid", numbered).join(ahead, ["cid", "table"], "left").join(F.broadcast(means), "table", "left")
    bit = [F.when(F.coalesce(F.col(f"p{i}"), F.lit(0.0)) > F.coalesce(F.col(f"c{i}"), F.lit(0.0)), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(bits)]
    return found.select("cid", "table", sum(bit[1:], bit[0]).alias("sign"))


def similar_items_lsh(entries: DataFrame, items: DataFrame, item_cols: list[str], queries: DataFrame, *, k: int = 5,
                      tables: int = 32, bits: int = 6) -> DataFrame:
    """As ``similar_items``, approximately: a query is compared with the classes
    that lie on its side of all hyperplanes of at least one of ``tables`` groups
    of ``bits`` random ones.  Classes at angle t to each other share a bucket
    with probability 1 - (1 - (1 - t / pi) ** bits) ** tables."""
    listed = _listed(items, entries, item_cols)
    asked = _asked(listed, queries, item_cols)
    classes, stats, const = _classes(listed)
    signs = cut_lineage(_signs(classes, stats, tables, bits))
    own = signs.join(asked.select("cid").distinct(), "cid", "left_semi").withColumnRenamed("cid", "query")
    pairs = cut_lineage(own.join(signs, ["table", "sign"]).select("query", "cid").distinct())
    asking = classes.select(F.col("cid").alias("query"), F.col("a").alias("qa"), F.col("norm").alias("qnorm"),
                            F.arrays_zip("feature", "value").alias("terms"))
    other = classes.select("cid", "first", "a", "norm", F.map_from_arrays("feature", "y").alias("ys"))
    met = pairs.join(asking, "query").join(other, "cid")
    dot = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["value"] * F.coalesce(F.try_element_at("ys", t["feature"]), F.lit(0.0)))
    fine = (F.col("norm") > LEAST_NORM) & (F.col("qnorm") > LEAST_NORM)
    score = F.when(fine, (dot - F.col("a") - F.col("qa") + F.lit(const)) / (F.col("norm") * F.col("qnorm"))).otherwise(F.lit(0.0))
    found = met.select("query", "cid", score.alias("score"))
    return _expanded(_best(found, classes.select("cid", "first"), k + 1), listed, asked, item_cols, k)
