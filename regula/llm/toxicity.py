"""Toxicity scores: gradient-boosted trees over dense text features, with
isotonic calibration.

Learning uses a bounded sample of labelled rows (``max_fit_rows``, chosen by a
hash of the id): its texts give a lexicon of words that are far more frequent
in documents of label 1; part of it fits the trees (Spark ML) and the rest the
isotonic calibration.  Every whole text is then turned into features once and
scored.  Features: lexicon densities (plain, by weight, at most per window of
50 words, so that a long clean text does not hide a short passage), lexicon
words near a second person, capitals, punctuation, and obfuscation (words that
only match once look-alike characters are undone, with or without the marks at
their end).

Defined results: a null text counts as empty and is scored by its all-zero
features; without labelled rows of both classes every score is the share of
label 1 among them (0 without any); a label that repeats counts once, one that
is neither 0 nor 1 not at all; rows that share an id are scored each by their
text, and a label stands for all of them; an empty table gives an empty table;
extra columns are ignored."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.llm.text import lower_ascii, slices, span_hashes, text_bytes, word_spans
from regula.session import cut_lineage

MAX_FIT_ROWS = 20_000
LEXICON_WORDS = 200
#: words on either side of a lexicon word that make it "near"
REACH = 5
#: words of a window, over which the densest place of a text is sought
WINDOW = 50

# Second-person words.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "euer", "tu", "te",
                 "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "tus", "ti", "vosotros")
# Look-alike characters.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

FEATURES = ("log_words", "hit_rate", "hit_weight", "hit_count", "near_you", "you_rate", "hidden_rate", "hidden_count",
            "capital_rate", "shouted_rate", "mark_rate", "exclaim_rate", "question_rate", "digit_word_rate", "max_weight", "window_hits",
            "window_weight")

_ASCII = np.arange(256)
_ALNUM = ((_ASCII >= 48) & (_ASCII <= 57)) | ((_ASCII >= 65) & (_ASCII <= 90)) | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
_MARK = (_ASCII > 32) & (_ASCII < 127) & ~_ALNUM
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_DROP = bytes(i for i in range(256) if _MARK[i])
_UNDO = np.arange(256, dtype=np.uint8)
for _a, _b in LOOK_ALIKE.items():
    _UNDO[ord(_a)] = ord(_b)


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN, _DROP).split()


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that ``features`` finds for these words."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw]) if raw else np.empty(0, np.int64)
    starts = ends - np.array([len(w) for w in raw], np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends)


def _stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words without their punctuation marks."""
    keep = ~_MARK[data]
    place = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(data[keep], place[starts], place[ends])


def _without_end_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the words without the punctuation marks at their end."""
    if not len(starts):
        return ends
    last = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))
    return np.maximum(last[ends - 1] + 1, starts)


def densest(rows: np.ndarray, weights: np.ndarray, n_rows: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the most weighted words, and the most weight, that ``window``
    consecutive words hold; ``rows`` is the text of each word, ascending."""
    at = np.flatnonzero(weights > 0)
    most, heaviest = np.zeros(n_rows), np.zeros(n_rows)
    if len(at):
        last = np.searchsorted(rows, rows[at], "right")  # a window stays within its text
        upto = np.searchsorted(at, np.minimum(at + window, last))
        total = np.concatenate([[0.0], np.cumsum(weights[at])])
        first = np.arange(len(at))
        np.maximum.at(most, rows[at], upto - first)
        np.maximum.at(heaviest, rows[at], total[upto] - total[first])
    return most, heaviest


def features(column: pa.Array, lexicon: np.ndarray, weights: np.ndarray, you: np.ndarray) -> np.ndarray:
    """Rows of FEATURES; ``lexicon`` is sorted, with weights alongside."""
    n_rows = len(column)
    data, offsets = text_bytes(column)
    starts, ends, rows = word_spans(data, offsets)
    small = lower_ascii(data)
    plain = _stripped(small, starts, ends)
    undone_text = _UNDO[small]
    bare = _stripped(undone_text, starts, ends)
    cut = _stripped(undone_text, starts, _without_end_marks(small, starts, ends))

    def weigh(hashes):
        if not len(lexicon) or not len(hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        return np.where(lexicon[at] == hashes, weights[at], 0.0)

    direct, undone = weigh(plain), np.maximum(weigh(bare), weigh(cut))
    hit, hidden = direct > 0, (undone > 0) & (direct == 0)
    second = np.isin(plain, you)
    row_of = np.repeat(np.arange(n_rows), np.diff(offsets))
    count = lambda who, mask: np.bincount(who[mask], minlength=n_rows).astype(float)
    words = np.maximum(np.bincount(rows, minlength=n_rows), 1)
    chars = np.maximum(np.diff(offsets), 1)
    # a lexicon word is near if a second person stands within reach in its text
    spots, near = np.flatnonzero(second), np.zeros(len(rows), bool)
    some = np.flatnonzero(hit | hidden)
    if len(spots) and len(some):
        for side in (np.searchsorted(spots, some) - 1, np.searchsorted(spots, some)):
            ok = (side >= 0) & (side < len(spots))
            other = spots[np.clip(side, 0, len(spots) - 1)]
            near[some] |= ok & (np.abs(other - some) <= REACH) & (rows[other] == rows[some])
    capital = (data >= 65) & (data <= 90)
    inside = np.concatenate([[0], np.cumsum(capital)])
    shouted = (ends - starts >= 3) & (inside[ends] - inside[starts] >= 0.6 * (ends - starts)) if len(starts) else np.empty(0, bool)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    with_digit = (digits[ends] - digits[starts] > 0) & (digits[ends] - digits[starts] < ends - starts) if len(starts) else np.empty(0, bool)
    weight = np.bincount(rows, weights=direct + undone * hidden, minlength=n_rows)
    heaviest = np.zeros(n_rows)
    np.maximum.at(heaviest, rows, np.maximum(direct, undone * hidden))
    most, densest_weight = densest(rows, direct + undone * hidden, n_rows, WINDOW)
    return np.column_stack([
        np.log1p(np.bincount(rows, minlength=n_rows)), 100 * count(rows, hit) / words, 100 * weight / words, np.log1p(count(rows, hit)),
        count(rows, near), 100 * count(rows, second) / words, 100 * count(rows, hidden) / words, np.log1p(count(rows, hidden)),
        count(row_of, capital) / chars, count(rows, shouted) / words, count(row_of, _MARK[data]) / chars,
        count(row_of, data == 33) / chars, count(row_of, data == 63) / chars, count(rows, with_digit) / words, heaviest, most,
        densest_weight])


def labelled_sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, label of at most about ``max_rows`` labelled rows to learn from."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(cast(doc_id AS string)) % 5 <> 0") \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = usable.count()
    share = int(1_000_000 * min(1.0, max_rows / max(n, 1)))
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)


def learn_lexicon(texts: DataFrame, size: int = LEXICON_WORDS) -> list[tuple[str, float]]:
    """The words most telling of label 1 (log-likelihood ratio), with the log
    of how many times likelier they are there; from text and label."""
    def count(batches):
        for part in slices(batches, "text"):
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                seen[label].update({w for w in _words(text or "") if 3 <= len(w) <= 40})
            every = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode(errors="replace") for w in every], pa.string()), pa.array([seen[0][w] for w in every], pa.int64()),
                 pa.array([seen[1][w] for w in every], pa.int64())], names=["word", "n0", "n1"])

    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    t0, t1 = totals.get(0, 0), totals.get(1, 0)
    if not t0 or not t1:
        return []
    words = texts.select("text", "label").mapInArrow(count, "word string, n0 bigint, n1 bigint") \
        .groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n1 >= 3")
    rate = F.log((F.col("n1") + 0.5) / (t1 + 1.0)) - F.log((F.col("n0") + 0.5) / (t0 + 1.0))
    found = words.select("word", rate.alias("weight"), (F.col("n1") * rate).alias("gain")).where(F.col("weight") > math.log(3))
    top = found.orderBy(F.desc("gain"), "word").limit(size).collect()
    return [(r["word"], r["weight"]) for r in top]


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_fit_rows: int = MAX_FIT_ROWS, trees: int = 30, depth: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # at most max_fit_rows rows of two numbers
    sample = cut_lineage(labelled_sample(labels, max_fit_rows))
    # three quarters of the sample fit lexicon and trees, one quarter the calibration
    to_fit = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) < 3
    lexicon = learn_lexicon(texts.join(F.broadcast(sample.where(to_fit)), "doc_id"))
    hashes = word_hashes([w for w, _ in lexicon])
    order = np.argsort(hashes)
    hashes, weights = hashes[order], np.array([w for _, w in lexicon])[order]
    you = word_hashes(list(SECOND_PERSON))
    schema = "doc_id bigint, " + ", ".join(f"{f} double" for f in FEATURES)

    def measure(batches):
        for part in slices(batches, "text"):
            table = features(part.column("text"), hashes, weights, you)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(table[:, j]) for j in range(len(FEATURES)))],
                                             names=["doc_id", *FEATURES])

    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(cut_lineage(texts.mapInArrow(measure, schema)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    learn = cut_lineage(table.join(F.broadcast(sample), "doc_id").select("doc_id", "features", "label", to_fit.alias("fit")))
    counts = learn.agg(F.count("*"), F.sum("label"), F.sum(F.col("label") * F.col("fit").cast("int")),
                       F.sum((1 - F.col("label")) * F.col("fit").cast("int"))).first()
    if not counts[2] or not counts[3]:
        share = float(counts[1] or 0) / max(counts[0], 1)
        return table.select("doc_id", held_out, F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    # the order of rows within a partition decides how boosting draws them
    fit = learn.where("fit").repartition(4, "doc_id").sortWithinPartitions("doc_id")
    trees_model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2,
                                minInstancesPerNode=5, seed=7).fit(fit)
    margin = vector_to_array("probability")[1].alias("raw")
    rest = trees_model.transform(learn.where("NOT fit")).select(margin, F.col("label").cast("double").alias("label"))
    scored = trees_model.transform(table).select("doc_id", margin)
    if not rest.isEmpty():
        scored = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(rest).transform(scored)
    else:
        scored = scored.withColumn("score", F.col("raw"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return scored.select("doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
