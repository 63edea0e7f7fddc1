"""Exact duplicates with a split between frequent and other texts.

Texts are equal when identical after lower-casing A-Z only; they are told apart
by the SHA-256 digest of the lower-cased text.

1. One scan turns every row into (id, digest), written once.
2. A mergeable Misra-Gries summary (Spark's frequent-items sketch, at most
   ``TRACKED`` counters per task, merged) names the candidates.  A digest that
   holds more than about one row in ``TRACKED`` / 2 is surely among them.
3. Candidates are counted exactly, with map-side combine.  Winners are those
   that hold at least one row in ``SHARE``, so there are at most ``SHARE`` of
   them; they are broadcast and their rows are settled where they are read.
4. The remaining digests, each with less than one row in ``SHARE``, go through
   one ordinary shuffle by digest.

Awkward input: a null text is empty.  The row with the largest id stays; rows
without id come behind all others and stay only where no row of the text has an
id (``keep_id`` is null then).  Rows that share text and id are one document in
the report; ``keep_one`` returns one of them.  An empty table gives an empty
report.  Other columns are not read by the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regula.session import written

#: counters of the Misra-Gries summary
TRACKED = 16384
#: a winner holds at least one row in SHARE, so at most SHARE winners are broadcast
SHARE = 2048

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> Column:
    """Lower-case hex SHA-256 of a text lower-cased in A-Z only; null is empty."""
    return F.sha2(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER), 256)


def winners(rows: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """digest, keep_id, group_size and ties (rows that share the greatest id)
    of the digests of ``rows`` (id, digest) that hold at least one row in
    ``share``: at most ``share`` rows, whatever the table holds."""
    n = rows.count()
    listed = rows.agg(F.expr(f"approx_top_k(digest, {min(2 * share, tracked)}, {tracked})").alias("top"))
    named = listed.select(F.explode("top.item").alias("digest")).where("digest is not null")
    exact = (rows.join(F.broadcast(named), "digest").groupBy("digest")
             .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
             .where((F.col("group_size") > 1) & (F.col("group_size") * share >= F.lit(n))))
    exact = written(exact)
    tied = (rows.join(F.broadcast(exact), "digest").where(F.col("id").eqNullSafe(F.col("keep_id")))
            .groupBy("digest").agg(F.count("*").alias("ties")))
    return exact.join(tied, "digest")


def _settled(docs: DataFrame, id: str, text: str) -> DataFrame:
    rows = written(docs.select(F.col(f"`{id}`").alias("id"), digest(text).alias("digest")))
    top = written(winners(rows))
    known = rows.join(F.broadcast(top), "digest")
    w = Window.partitionBy("digest")
    rest = (rows.join(F.broadcast(top), "digest", "left_anti")
            .withColumn("keep_id", F.max("id").over(w)).withColumn("group_size", F.count("*").over(w)))
    ties = F.sum(F.col("id").eqNullSafe(F.col("keep_id")).cast("long")).over(w)
    return known.unionByName(rest.withColumn("ties", ties)).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def exact_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, keep_id (id of the row that stays), group_size
    (rows with the same text), kept and text_sha256."""
    return _settled(docs, id, text).select(F.col("id").alias(id), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns as they are.

    Only the marks of rows to leave out, or to choose one of, are joined to the
    documents; one shuffle carries texts."""
    marks = written(_settled(docs, id, text).where("not kept or ties > 1").select(F.struct("id", "digest").alias("of"), "kept").distinct())
    row = docs.select(F.struct("*").alias("row"), F.struct(F.col(f"`{id}`").alias("id"), digest(text).alias("digest")).alias("mark"))
    same = F.col("mark").eqNullSafe(F.col("of"))
    if marks.where("kept").isEmpty():
        return row.join(marks, same, "left_anti").select("row.*")
    found = row.join(marks, same, "left")
    one = found.where("kept").groupBy("mark").agg(F.first("row").alias("row"))
    return found.where("of is null").select("row.*").unionByName(one.select("row.*"))
