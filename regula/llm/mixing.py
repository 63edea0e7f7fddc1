"""Mixing sources to target weights.

Every document gets a hash-random key (md5 of a seed and its id, ties by text
hash and row content).  Within a source the documents are ordered by that key;
running sums of token counts say which documents fall under the source's
budget, and the document on the border is cut at the exact word.  A budget
above the source's size starts another epoch in the same order.

Running sums are distributed: keys are uniform by construction, so the leading
hex digits of a key are a balanced bucket that is a pure function of the row.
Sums per (source, bucket) are a small table (at most ``16 ** BUCKET_DIGITS``
rows a source); their running totals are added to the sums inside a bucket.
A hot source is spread over its buckets like any other.

Defined results: null text has size 0 and takes 0; null source is a source of
its own, ordered last; rows sharing an id are separate documents, ordered by
their text's hash (equal rows are interchangeable); an empty table gives an
empty table; extra columns are carried and cannot clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3
# Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from a frame with source and size.

    The total (``share_percent`` of all sizes) is shared by weight; a target
    stops at ``max_epochs`` times its source's size and the excess goes to
    the others by weight.  Ordered by size over weight, the capped sources
    are a prefix: the first prefix after which nobody is above its cap
    fixes the level of all others.  One row per source from here on."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.get(listed, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    leveled = per.select(
        "*", cap.alias("cap"), F.row_number().over(order).alias("rank"),
        (F.sum("source_size").over(everyone) * share_percent / 100).alias("total"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight"))
    leveled = leveled.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    first = F.min(F.when(fits, F.struct("rank", "level"))).over(everyone)
    return leveled.withColumn("fit", first).select(
        "source", "source_size",
        F.when(F.col("fit").isNull() | (F.col("rank") < F.col("fit.rank")), F.col("cap").cast("double"))
        .otherwise(F.col("fit.level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: str = "mix", carry: bool = False, **targets) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row (and the
    whole row as ``row`` if ``carry``)."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))).alias("key"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (source, bucket): where the bucket starts, and the budget
    starts = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("start"))
    want = source_targets(sums.select("source", F.col("bucket_size").alias("size")), **targets)
    s, w = starts.alias("s"), want.alias("w")
    plan = s.join(w, F.col("s.source").eqNullSafe(F.col("w.source"))).select(
        F.col("s.source").alias("p_source"), F.col("s.bucket").alias("p_bucket"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("start") - F.col("ahead")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
                         *(["row"] if carry else []))


def mix_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document appears once
    for each time it is taken; the one on a source's border is cut after its
    last word within the budget."""
    plan = mix_plan(docs, text_col=text_col, carry=True, **options).where("taken > 0")
    copies = plan.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.expr("cast((taken + size - 1) div size as int)"))))
    share = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    # the text up to and with its n-th word
    cut = F.expr(f"array_join(slice(regexp_extract_all(text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(share as int)), '')")
    out = copies.select("row", "size", share.alias("share"), F.col("row").getField(text_col).alias("text"))
    out = out.withColumn("text", F.when(F.col("share") < F.col("size"), cut).otherwise(F.col("text")))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
