"""Document fingerprints from closed syncmers, with DataFrame operations only.

A k-mer of code points is an anchor if the least hash of its inner s-mers is
that of the first or the last one.  The rule looks at nothing outside the k-mer,
so an edit changes anchors only where k-mers touch it.  A fingerprint is every
anchor of a text with the position where it stands first; nothing is dropped or
sampled but further places of the same k-mer.

Two fingerprints are matched by position: anchors of equal hash give a shift
(position there less position here), the commonest shift aligns the texts, and
the likeness is the share of both texts' anchors that lie within ``DRIFT`` of
that alignment.  Passages that stand elsewhere, or in another order, do not count.

Anchors are made inside the row, once per text.  Those of an edited text need no
second pass: as they are free of context, they are the anchors of the two
passages it is made of and those of the few k-mers across the seam.  One shuffle
deals texts and anchors into buckets of neighbouring ids; each bucket also gets a
copy of the next bucket's first document, so a window finds every document's
successor.

Defined results: a null text counts as empty, has no anchors, the fingerprint
``""`` and likeness 1 to another empty one, 0 to any other; a text shorter than
``K`` has itself as its only anchor; among rows that share an id the least one by
hash, then text, is what the document before them is edited with; a row without
id has no next document (an empty text takes its place); equal rows give equal
rows; an empty table gives an empty table; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 48
S = 9
#: inner s-mers of a k-mer; one k-mer in about INNER / 2 is an anchor
INNER = K - S + 1
#: where runs of 16 s-mers start that cover a k-mer's
REACHES = [*range(0, INNER - 16, 16), INNER - 16]
#: characters by which the places of matched anchors may differ from the alignment
DRIFT = 64
#: ids of one bucket, on average; ids of first documents up to which they are broadcast
BUCKET_IDS = 4096
FEW_BUCKETS = 1 << 20

_NONE = "array<bigint>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body
    reads it for the elements of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(code: Column, start: Column, length: Column) -> Column:
    """Hash of ``length`` code points from 0-based ``start`` on of a UTF-32 text."""
    return F.xxhash64(F.substring(code, start * 4 + 1, length * 4))


def _packed(h: Column, p: Column) -> Column:
    """31 bits of hash above 32 bits for the position."""
    return F.shiftleft(F.shiftrightunsigned(h, 33), 32).bitwiseOR(p.cast("bigint"))


def _high(x: Column) -> Column:
    return F.shiftright(x, 32)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 31) - 1))


def _first_places(found: Column) -> Column:
    """Anchors by hash, each hash with its first position."""
    return _bound(F.sort_array(found), lambda u: F.filter(u, lambda x, i: (i == 0) | (_high(x) != _high(F.get(u, i - 1)))))


def _windows(code: Column, n: Column) -> Column:
    """All anchors of a text of at least ``K`` code points."""
    def fourfold(mins: Column, reach: int) -> Column:
        """Minima over four times as many s-mers as ``mins`` has, which is ``reach``."""
        return F.transform(mins, lambda x, p: F.least(x, *[F.get(mins, p + j * reach) for j in (1, 2, 3)]))

    def spots(smers: Column) -> Column:
        def test(mins: Column) -> Column:
            def edge(s: Column, p: Column) -> Column:
                low = F.least(*[F.get(mins, p + j) for j in REACHES])
                return F.when((p <= F.size(smers) - INNER) & (F.least(s, F.get(smers, p + (INNER - 1))) <= low), p).otherwise(F.lit(-1))
            return F.filter(F.transform(smers, edge), lambda p: p >= 0)
        return _bound(_bound(fourfold(smers, 1), lambda m: fourfold(m, 4)), test)

    smers = F.transform(F.sequence(F.lit(0), n - S), lambda p: _hash(code, p, F.lit(S)))
    return F.transform(_bound(smers, spots), lambda p: _packed(_hash(code, p, F.lit(K)), p))


def anchors(text: Column) -> Column:
    """The anchors of a text, by hash: longs of hash and position."""
    n = F.char_length(text)
    found = _bound(F.encode(text, "UTF-32"), lambda code: F.when(n >= K, _first_places(_windows(code, n)))
                   .otherwise(F.array(_packed(_hash(code, F.lit(0), n), F.lit(0)))))
    return F.when(n > 0, found).otherwise(F.array().cast(_NONE))


def _edited_anchors(text: Column, own: Column, head: Column, other: Column) -> Column:
    """The anchors of the first half of ``text`` followed by ``head`` (the
    beginning of another text), from both texts' anchors and the seam."""
    n = F.char_length(text)
    none = F.array().cast(_NONE)

    def made(v: Column) -> Column:
        cut, taken, left, seam = v["cut"], v["taken"], F.least(v["cut"], F.lit(K - 1)), v["seam"]
        across = _bound(F.encode(seam, "UTF-32"), lambda code: _windows(code, F.char_length(seam)))
        parts = F.concat(F.filter(own, lambda x: _place(x) + K <= cut),
                         F.transform(F.when(F.char_length(seam) >= K, across).otherwise(none), lambda x: x + (cut - left)),
                         F.transform(F.filter(other, lambda x: _place(x) + K <= taken), lambda x: x + cut))
        return F.when(cut + taken >= K, _first_places(parts)).otherwise(anchors(F.concat(F.left(text, cut), head)))

    # lengths are counted once, not for every anchor
    cut = (n - F.floor(n / 2)).cast("int")
    begin = F.least(cut, F.lit(K - 1))
    seam = F.concat(F.substring(text, cut - begin + 1, begin), F.left(head, F.lit(K - 1)))
    return _bound(F.struct(cut.alias("cut"), F.char_length(head).alias("taken"), seam.alias("seam")), made)


def likeness(a: Column, b: Column) -> Column:
    """Share of both texts' anchors that match at the commonest shift."""
    mark = F.lit(1 << 31).cast("bigint")

    def shifts(u: Column) -> Column:
        def shift(x: Column, i: Column) -> Column:
            after = F.get(u, i + 1)
            return F.when(_high(after) == _high(x), _place(after) - _place(x))
        return F.sort_array(F.filter(F.transform(u, shift), lambda d: d.isNotNull()))

    def aligned(found: Column) -> Column:
        start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(0).cast("bigint").alias("at"))

        def step(s: Column, d: Column) -> Column:
            run = F.when(d == s["last"], s["run"] + 1).otherwise(F.lit(1))
            more = (run > s["most"]) | ((run == s["most"]) & (F.abs(d) < F.abs(s["at"])))
            return F.struct(d.alias("last"), run.alias("run"), F.greatest(run, s["most"]).alias("most"), F.when(more, d).otherwise(s["at"]).alias("at"))

        best = F.aggregate(found, start, step, lambda s: s["at"])
        return _bound(best, lambda at: F.size(F.filter(found, lambda d: F.abs(d - at) <= DRIFT)))

    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(mark))))
    share = 2.0 * _bound(_bound(both, shifts), aligned) / (F.size(a) + F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def printed(found: Column) -> Column:
    """A fingerprint as text: 16 hex digits an anchor, by hash."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _dealt(texts: DataFrame) -> DataFrame:
    """``texts`` with bucket and border: rows with an id by ranges of ids, and
    for each bucket a copy of the first document of the next one that has any
    (of the first bucket for the last one), after all others."""
    lo, hi, n = texts.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    named = texts.where("doc_id IS NOT NULL")
    if not n:
        return named.withColumn("bucket", F.lit(0).cast("bigint")).withColumn("border", F.lit(False))
    width = max(1, -(-(hi - lo + 1) // max(1, -(-n // BUCKET_IDS))))
    rows = named.withColumn("bucket", F.expr(f"cast((cast(doc_id as decimal(20,0)) - {lo}) div {width} as bigint)")).withColumn("border", F.lit(False))
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))
    w = Window.orderBy("bucket")  # one row a bucket
    before = F.coalesce(F.lag("bucket").over(w), F.max("bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("doc_id", before.alias("to"))
    small = F.broadcast if -(-(hi - lo + 1) // width) <= FEW_BUCKETS else (lambda df: df)
    borders = rows.join(small(firsts), "doc_id").withColumn("bucket", F.col("to")).withColumn("border", F.lit(True)).drop("to")
    return rows.unionByName(borders)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is the
    beginning of the next document: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    made = _dealt(texts).withColumn("own", anchors(F.col("text"))).repartition("bucket")
    # among rows of one id the least speaks for it; all of them have the same successor
    order = Window.partitionBy("bucket", "border", "doc_id").orderBy(F.xxhash64("text"), "text")
    spoken = made.withColumn("copy", F.row_number().over(order))
    spoken = spoken.withColumn("speaker", F.when(F.col("copy") == 1, F.struct("text", "own")))
    after = F.expr("lead(speaker) IGNORE NULLS OVER (PARTITION BY bucket ORDER BY border, doc_id, copy)")
    linked = spoken.withColumn("after", after).where("NOT border").select("doc_id", "text", "own", "after.text", "after.own")
    linked = linked.toDF("doc_id", "text", "own", "next", "next_own")
    alone = texts.where("doc_id IS NULL").select("doc_id", "text", anchors(F.col("text")).alias("own"), F.lit("").alias("next"),
                                                 F.array().cast(_NONE).alias("next_own"))
    rows = linked.unionByName(alone).withColumn("head", F.expr("left(next, cast(char_length(text) div 2 as int))"))
    edited = F.concat(F.expr("left(text, cast(char_length(text) - char_length(text) div 2 as int))"), F.col("head"))
    own, other = F.col("own"), F.col("next_own")
    judged = _bound(_edited_anchors(F.col("text"), own, F.col("head"), other),
                    lambda e: F.struct(printed(e).alias("edited_fingerprint"), likeness(own, e).alias("near_edited")))
    rows = rows.withColumn("judged", judged)
    return rows.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
                       printed(own).alias("fingerprint"), F.col("judged.edited_fingerprint"), F.col("judged.near_edited"),
                       likeness(own, other).alias("near_next"))
