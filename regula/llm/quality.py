"""Quality rules with adaptive thresholds.

Per-document measures are compared with thresholds learned from the corpus: a
mergeable quantile sketch per (language, source) and measure, blended with its
language's by weight, gives an upper quantile and the spread below it, and a
document is rejected where a measure lies beyond the group's fence.  A few base
rules that need no corpus go first.

The sketch counts values in log-linear buckets (a power of two cut in
``2**SUB_BITS`` equal steps), so a bucket's relative width is at most
``2**-SUB_BITS``; sketches merge by adding counts, which is what a ``groupBy``
does map-side.  Integer arithmetic only: reruns agree to the bit.

Defined results: a null text counts as empty (0 words, base_failed); null
language or source forms a group of its own; repeated rows are judged row by
row alike; an empty table gives an empty table; extra columns are ignored by
the measures and carried by ``quality_filter``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regula.llm.text import mix, slices, span_hashes, text_bytes, word_spans
from regula.session import written

# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SUB_BITS = 5
#: measures in parts per thousand; each is a ratio of two counts
MEASURES = ("symbol_rate", "shout_rate", "dup_line_rate", "repeat_rate", "word_length")
#: upper fence: the 0.9 quantile plus this many spreads.  The spread is the
#: distance from the median to that quantile or, where both are equal (a measure
#: that most documents have at zero), the 0.1 quantile of the values above zero ...
FENCE = 6
#: ... and at least this much (per thousand) per measure
LEAST_SPREAD = {"symbol_rate": 10, "shout_rate": 10, "dup_line_rate": 20, "repeat_rate": 20, "word_length": 50}
#: a group's sketch is blended with its language's as if the latter were this
#: many more documents of the group
PRIOR = 100

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


def _line_counts(text: str) -> tuple[int, int]:
    """Lines with a word; those of them equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def _repeated_words(rows: np.ndarray, words: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row, words covered by a 3-word window that the row holds twice or more."""
    n = len(words)
    if n < 3:
        return np.zeros(n_rows, np.int64)
    # a window takes its row into the hash, so one sort finds repeats in all rows
    window = mix(mix(mix(words[:-2] + np.uint64(1)) + words[1:-1]) + words[2:]) + mix(rows[:-2].astype(np.uint64))
    whole = rows[:-2] == rows[2:]
    at = np.flatnonzero(whole)
    order = at[np.argsort(window[at], kind="stable")]
    values = window[order]
    same = values[1:] == values[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(n, bool)
    hit = order[twice]
    for j in range(3):
        covered[hit + j] = True
    return np.bincount(rows[covered], minlength=n_rows)


def count_slice(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts in COUNTS for each text of an Arrow string array."""
    n_rows = len(column)
    data, offsets = text_bytes(column)
    starts, ends, rows = word_spans(data, offsets)
    row_of = np.repeat(np.arange(n_rows), np.diff(offsets))
    total = lambda mask: np.bincount(row_of[mask], minlength=n_rows)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    is_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    lines = [_line_counts(t or "") for t in column.to_pylist()]
    return {
        "n_words": np.bincount(rows, minlength=n_rows),
        "word_chars": total(is_word & ((data & 0xC0) != 0x80)),
        "n_symbols": total(np.isin(data, np.frombuffer(SYMBOLS, np.uint8))),
        "n_dup_lines": np.array([x[1] for x in lines], np.int64),
        "n_repeat_words": _repeated_words(rows, span_hashes(data, starts, ends), n_rows),
        "n_lines": np.array([x[0] for x in lines], np.int64),
        "n_shouts": total(data == 0x21),
    }


def measure_documents(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the carried columns, all by default) and the
    counts of COUNTS for every whole text."""
    carry = docs.columns if carry is None else carry
    frame = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([frame.schema["row"], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def count(batches):
        for part in slices(batches, "text"):
            found = count_slice(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=["row", *COUNTS])

    return frame.mapInArrow(count, schema)


def with_measures(counts: DataFrame) -> DataFrame:
    """Add the integer measures (per thousand) and the base verdict."""
    def rate(part: str, whole: str) -> Column:
        return F.expr(f"1000 * {part} div greatest({whole}, 1)").alias

    return counts.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "n_words")("symbol_rate"), rate("n_shouts", "n_words")("shout_rate"),
        rate("n_dup_lines", "n_lines")("dup_line_rate"), rate("n_repeat_words", "n_words")("repeat_rate"),
        rate("word_chars", "n_words")("word_length"))


def bucket_of(value: str) -> Column:
    """Smallest value of the sketch bucket that ``value`` (>= 0) falls in."""
    shift = f"(length(bin({value})) - {SUB_BITS + 1})"
    return F.expr(f"CASE WHEN {value} < {2 ** (SUB_BITS + 1)} THEN {value} "
                  f"ELSE shiftleft(shiftright({value}, {shift}), {shift}) END")


def group_sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n over the documents that pass the base rules."""
    stacked = measured.where(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[
            F.struct(F.lit(m).alias("measure"), bucket_of(m).alias("bucket")) for m in MEASURES])).alias("s"))
    return stacked.groupBy("lang", "source", "s.measure", "s.bucket").agg(F.count("*").alias("n"))


def _blended(sketches: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, w: every group's counts and ``PRIOR``
    documents dealt out like its language's, as exact integers (times the
    number of the language's documents)."""
    weight = lambda c: F.col(c).cast("decimal(19,0)")
    merged = sketches.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    totals = merged.groupBy("lang", "measure").agg(F.sum("n").alias("lang_n"))
    groups = sketches.select("lang", "source").distinct()
    s, g, m, t = sketches.alias("s"), groups.alias("g"), merged.alias("m"), totals.alias("t")
    same = F.col("s.lang").eqNullSafe(F.col("t.lang")) & (F.col("s.measure") == F.col("t.measure"))
    own = s.join(t, same).select("s.lang", "s.source", "s.measure", "s.bucket", (weight("s.n") * weight("t.lang_n")).alias("w"))
    shared = g.join(m, F.col("g.lang").eqNullSafe(F.col("m.lang"))) \
        .select("g.lang", "g.source", "m.measure", "m.bucket", (weight("m.n") * PRIOR).cast("decimal(38,0)").alias("w"))
    return own.union(shared).groupBy("lang", "source", "measure", "bucket").agg(F.sum("w").alias("w"))


def spreads(sketches: DataFrame) -> DataFrame:
    """lang, source, measure, high (the 0.9 quantile) and spread, as learned."""
    group = Window.partitionBy("lang", "source", "measure")
    ranked = _blended(sketches).select("*", F.sum("w").over(group.orderBy("bucket")).alias("upto"), F.sum("w").over(group).alias("whole"),
                                       F.sum(F.when(F.col("bucket") == 0, F.col("w")).otherwise(0)).over(group).alias("zero"))
    found = ranked.groupBy("lang", "source", "measure").agg(
        F.min(F.when(2 * F.col("upto") >= F.col("whole"), F.col("bucket"))).alias("mid"),
        F.min(F.when(10 * F.col("upto") >= 9 * F.col("whole"), F.col("bucket"))).alias("high"),
        F.min(F.when((F.col("bucket") > 0) & (10 * (F.col("upto") - F.col("zero")) >= F.col("whole") - F.col("zero")), F.col("bucket"))).alias("low"))
    return found.select("lang", "source", "measure", "high",
                        F.when(F.col("high") > F.col("mid"), F.col("high") - F.col("mid")).otherwise(F.coalesce("low", F.lit(0))).alias("spread"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source) with the upper fence of every measure."""
    least = F.create_map(*[F.lit(x) for kv in LEAST_SPREAD.items() for x in kv])
    fence = F.col("high") + FENCE * F.greatest(F.col("spread"), least[F.col("measure")])
    return spreads(sketches).groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, fence)).cast("bigint").alias(f"max_{m}") for m in MEASURES])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          carry: list[str] | None = None) -> DataFrame:
    """``row``, counts, measures, base_failed and kept for every document."""
    carry = docs.columns if carry is None else carry
    few = [c for c in carry if c != text_col]
    if text_col in carry:
        measured = with_measures(measure_documents(docs, text_col, carry))
        # the sketch pass carries no texts
        first = with_measures(measure_documents(docs, text_col, list(dict.fromkeys([*few, lang_col, source_col]))))
    else:  # narrow rows: counted once, read twice
        first = measured = with_measures(written(measure_documents(docs, text_col, list(dict.fromkeys([*few, lang_col, source_col])))))
    limits = thresholds(group_sketches(_grouped(first, lang_col, source_col)))
    # groups are far fewer than documents, but their number has no proven
    # bound: a plain null-safe equi-join, left to the runtime's size check
    d, t = _grouped(measured, lang_col, source_col).alias("d"), limits.alias("t")
    joined = d.join(t, F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    within = F.lit(True)
    for m in MEASURES:
        within = within & (F.col(f"d.{m}") <= F.coalesce(F.col(f"t.max_{m}"), F.lit(2**62)))
    return joined.select("d.row", *[F.col(f"d.{c}") for c in (*COUNTS, "base_failed", *MEASURES)],
                         (~F.col("d.base_failed") & within).alias("kept"))


def _grouped(measured: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    return measured.withColumns({"lang": F.col("row").getField(lang_col).cast("string"),
                                 "source": F.col("row").getField(source_col).cast("string")})


def quality_filter(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents that pass, with all their columns; texts are not shuffled
    unless the threshold table outgrows a broadcast."""
    return judge(docs, **columns).where("kept").select("row.*")
