"""From shared buckets to verified links and connected components, with
DataFrame operations only.

Ids are bigints.  Nothing is collected but a row of counts per round.  Tables
of a round go once the next one is written; ``named`` alone outlives the call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regula.session import release, written

Near = Callable[[DataFrame], DataFrame]
Verify = Callable[[DataFrame, DataFrame], DataFrame]
#: remainders of hashes that rule out rows before they are shuffled
FILTER = 1 << 20


def likely_rows(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``table`` without most rows whose ``key`` is none of ``ids`` (column id):
    at most ``FILTER`` remainders are broadcast, however many ids there are."""
    rest = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER))
    coarse = ids.select(rest("id").alias("_rest")).distinct()
    return table.join(F.broadcast(coarse), rest(key) == F.col("_rest"), "left_semi")


def paired(pairs: DataFrame, kept: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both ids from ``kept``, as sa and sb.
    Contents are dealt by id at any size: none is broadcast."""
    rows = likely_rows(kept.select("id", column), "id", pairs.select(F.explode(F.array("a", "b")).alias("id")))
    right = rows.select(F.col("id").alias("b"), F.col(column).alias("sb"))
    left = rows.select(F.col("id").alias("a"), F.col(column).alias("sa"))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")


def alike(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the ``pairs`` whose sets (arrays sa and sb) are links.  The size of
    the intersection is a row of its own: a filter over a column would be pushed
    below and make it, and the sets, anew wherever it names them."""
    both = F.explode(F.array(F.size(F.array_intersect("sa", "sb")))).alias("both")
    met = pairs.select("a", "b", (F.size("sa") + F.size("sb")).alias("sum"), both)
    return met.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def not_ruled_out(pairs: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) that sizes and parities of ``marked`` (as ``set_marks``)
    do not rule out."""
    words = [c for c in marked.columns if c.startswith("w")]
    c, m = marked.alias("c"), marked.alias("m")
    met = pairs.join(c, F.col("a") == F.col("c.id")).join(m, F.col("b") == F.col("m.id"))
    return met.where(_near(percent, words)).select("a", "b").distinct()


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b).

    The least neighbour of a node is an aggregate that combines map-side, and
    goes back to the node's edges by an equi-join, whose crowded keys the
    runtime can split; a hub's edges never have to sit in one task."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each id of the distinct edges (id > component) has one edge up
    and none down."""
    ends = edges.select(F.col("id").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .union(edges.select(F.col("component").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id of its component) for every id in ``edges``
    (columns a, b) but the least ones themselves.

    Alternating large-star and small-star steps until the edges are separate
    stars; as every edge leads to the lesser id, a star's centre is then its
    component's least id.  No round is spent on seeing that nothing changes."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    current = written(edges.where("a <> b").select(high.alias("id"), low.alias("component")).distinct())
    while not _are_stars(current):
        old = current
        current = written(_star_round(old.select(F.col("id").alias("a"), F.col("component").alias("b")))
                          .select(F.col("a").alias("id"), F.col("b").alias("component")))
        release(old)
    return current


#: rounds of stars around drawn centres before the exact round; a bucket has
#: ``SLICES ** (turn - 1)`` centres in a round at most
ROUNDS = 2
SLICES = 8
#: words of parities that are looked at first
FEW_WORDS = 8


def set_marks(elements: DataFrame, words: int) -> DataFrame:
    """id, n and w0, w1, ...: size of an id's set of distinct hashes (columns
    id, h) and the parities of its elements thrown on 64 * ``words`` bits."""
    thrown = elements.select("id", F.expr(f"cast(pmod(shiftright(h, 6), {words}) as int)").alias("word"),
                             F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    per = thrown.groupBy("id", "word").agg(F.count("*").alias("n"), F.bit_xor("bit").alias("odd"))
    return per.groupBy("id").agg(F.sum("n").alias("n"), *[
        F.coalesce(F.max(F.when(F.col("word") == j, F.col("odd"))), F.lit(0)).cast("bigint").alias(f"w{j}") for j in range(words)])


def _near(percent: int, words: list[str]) -> Column:
    """False only where the sets of c and m are surely less alike: a bit of
    the parities differs for an element in one of both sets only, so sets
    differ in at least as many elements as parities in bits."""
    differ = lambda ws: sum((F.bit_count(F.col(f"c.{w}").bitwiseXOR(F.col(f"m.{w}"))) for w in ws), F.lit(0))
    low, high = F.least("c.n", "m.n"), F.greatest("c.n", "m.n")
    # a part of the bits settles most pairs
    few = [words] if len(words) <= FEW_WORDS else [words[:FEW_WORDS], words]
    near = 100 * low >= percent * high
    for ws in few:
        near = near & ((100 + percent) * differ(ws) <= (100 - percent) * (low + high))
    return near


def _mixed(members: DataFrame, named: DataFrame) -> DataFrame:
    """bucket, id, label, main: members of the buckets that span several
    components; ``main`` is the bucket's most frequent label."""
    labelled = members.join(named, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label"))
    shares = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    tops = shares.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    return written(labelled.join(tops.select("bucket", F.col("top.label").alias("main")), "bucket"))


def linked_components(buckets: DataFrame, near: Near, verify: Verify, marks: Verify, percent: int) -> DataFrame:
    """Components of the verified links (Jaccard similarity of at least
    ``percent`` per cent) among ids that share a bucket.

    ``buckets`` has bucket and id (one row per bucket and id) and is read
    twice; ``near`` gives id and content for a table of ids and is called once,
    for all ids that share a bucket; ``verify`` turns candidate pairs (a < b)
    into those that are links and ``marks`` gives id, n and parities (``set_marks``) for a
    table of ids, both from that content (first argument).  So texts are moved
    once, not in every round.

    Stars: every member of a bucket is compared with the bucket's least id,
    which joins up a group of copies in linear work, whatever its size.
    Buckets whose members then lie in several components get ``ROUNDS`` more
    stars around members drawn by a hash.  In what is still mixed, every member
    outside the bucket's main component meets all members of other components.
    Only pairs that sizes and parities do not rule out (exactly: no link is
    lost) become rows.  Members that no comparison touched lie in one component
    already, so no link between components that share a bucket is missed."""
    leaders = written(buckets.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader"))
    shared = likely_rows(buckets, "bucket", leaders.select(F.col("bucket").alias("id")))
    members = written(shared.join(leaders.hint("merge"), "bucket").select("bucket", "id", "leader"))
    release(leaders)
    kept = written(near(members.select("id").distinct()))
    seen = first = written(members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    named = components(verify(kept, seen))
    marked, met = None, []
    for turn in range(1, ROUNDS + 2):
        mixed = _mixed(members.drop("leader"), named)
        if mixed.isEmpty():
            release(mixed)
            break
        if marked is None:
            marked = written(marks(kept, mixed.select("id").distinct()))
            words = [c for c in marked.columns if c.startswith("w")]
        rest = mixed.join(marked, "id")
        if turn <= ROUNDS:
            part = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(SLICES ** (turn - 1)))
            drawn = mixed.groupBy("bucket", part.alias("part")).agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("id"))
            centres, once = rest.join(drawn.select("bucket", "id"), ["bucket", "id"]), F.lit(True)
        else:
            centres, once = rest.where("label <> main"), (F.col("m.label") == F.col("m.main")) | (F.col("c.id") < F.col("m.id"))
        around = centres.alias("c").join(rest.alias("m"), (F.col("c.bucket") == F.col("m.bucket")) & (F.col("c.label") != F.col("m.label"))
                                         & once & _near(percent, words))
        pairs = around.select(F.least("c.id", "m.id").alias("a"), F.greatest("c.id", "m.id").alias("b")).distinct()
        pairs = written(pairs.join(seen, ["a", "b"], "left_anti"))
        release(mixed)
        met.append(pairs)
        if pairs.isEmpty():
            continue
        seen = seen.union(pairs)
        old, named = named, components(named.select(F.col("id").alias("a"), F.col("component").alias("b")).union(verify(kept, pairs).select("a", "b")))
        release(old)
    release(members, kept, first, *met, *([marked] if marked is not None else []))
    return named
