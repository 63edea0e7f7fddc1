"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

n-grams of one to three code points (letters lower-cased, everything else a
blank) are hashed into ``DIM`` columns.  Document frequencies are counted over
all documents one may learn from; weights are learned on a bounded sample of
them (about ``rows_per_lang`` for each language, chosen by a hash of the id) by
follow-the-regularised-leader with L1 and L2 penalties, one update per
document; a further part of the sample sets the temperature that calibrates
the probabilities.

Defined results: a null text or one without a letter is ``und`` with score 0;
without any row to learn from everything is ``und``; rows that share an id are
predicted each by its text; equal texts get equal predictions; an empty table
gives an empty table; extra columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.llm.text import slices

DIM = 1 << 15
ROWS_PER_LANG = 2_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
TEMPERATURES = np.geomspace(0.05, 5.0, 61)

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns that the text's n-grams hash to, and how often each occurs."""
    points = np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower())} ".encode("utf-32-le"), np.uint32)
    one = points * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (points[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (points[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - DIM.bit_length() + 1)
    counts = np.bincount(np.concatenate([one, two, three]) >> shift, minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int) -> np.ndarray:
    """Weights (DIM, classes) after EPOCHS passes of FTRL-proximal."""
    z, n = np.zeros((DIM, n_classes)), np.zeros((DIM, n_classes))

    def weights(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, label in examples:
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(DIM))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss."""
    if not len(labels):
        return 1.0
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in TEMPERATURES]
    return float(TEMPERATURES[int(np.argmin(loss))])


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL AND lang IS NOT NULL AND coalesce(crc32(cast(doc_id AS string)) % 3, 0) <> 1")


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each column's n-grams, and their number, over all
    of ``texts``: every task sends one row per column."""
    def count(batches):
        df, n = np.zeros(DIM + 1, np.int64), 0
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                df[ngram_counts(text)[0]] += 1
                df[DIM] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["col", "n"])

    # at most DIM + 1 rows
    rows = texts.select("text").mapInArrow(count, "col int, n bigint").groupBy("col").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, np.int64)
    for r in rows:
        df[r["col"]] = r["n"]
    return df[:DIM], int(df[DIM])


def learn(docs: DataFrame, rows_per_lang: int) -> dict | None:
    """Languages, idf, weights and temperature; None without rows to learn from."""
    rows = _learnable(docs)
    # one row a language, as many as the model has classes
    counts = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    langs = [lang for lang, _ in counts]
    if not langs:
        return None
    parts = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, 1_000_000 * rows_per_lang / n)])
    rated = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < parts[F.col("lang")])
    df, n_docs = document_frequencies(rows)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    place = {lang: i for i, lang in enumerate(langs)}

    def fit(batches):
        examples, rest = [], []
        taken = []
        for part in slices(batches, "text"):
            taken += [(i, lang, *ngram_counts(text)) for i, lang, text in
                      zip(part.column("turn").to_pylist(), part.column("lang").to_pylist(), part.column("text").to_pylist())]
        taken.sort(key=lambda e: e[0])  # the sample in hash order, whatever order its rows came in
        for i, lang, at, n in taken:
            (rest if i % 5 == 0 else examples).append((at, weigh(at, n, idf), place[lang]))
        w = ftrl(examples, len(langs))
        logits = np.array([x @ w[at] for at, x, _ in rest]).reshape(len(rest), len(langs))
        t = temperature(logits, np.array([y for *_, y in rest], np.int64))
        used = np.flatnonzero(np.abs(w).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used], pa.int32()), pa.array([[t], *w[used].tolist()], pa.list_(pa.float64()))], names=["col", "w"])

    # the bounded sample is one task's work; its result has at most DIM + 1 rows
    sample = rated.select(F.pmod(F.xxhash64("text", "doc_id"), F.lit(2**31)).alias("turn"), "lang", "text").repartition(1)
    found = sample.mapInArrow(fit, "col int, w array<double>").collect()
    weights = np.zeros((DIM, len(langs)))
    for r in found:
        if r["col"] >= 0:
            weights[r["col"]] = r["w"]
    return {"langs": langs, "idf": idf, "weights": weights, "temperature": next(r["w"][0] for r in found if r["col"] < 0)}


def _predictions(texts: list[str | None], model: dict | None) -> Iterator[tuple[str, float]]:
    for text in texts:
        if model is None or not text or not any(map(str.isalpha, text)):
            yield "und", 0.0
            continue
        at, n = ngram_counts(text)
        p = softmax(weigh(at, n, model["idf"]) @ model["weights"][at] / model["temperature"])
        best = int(np.argmax(p))
        yield model["langs"][best], float(p[best])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text."""
    frame = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                        F.col(f"`{lang_col}`").alias("lang"))
    model = learn(frame, rows_per_lang)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")

    def predict(batches):
        for part in slices(batches, "text"):
            found = list(_predictions(part.column("text").to_pylist(), model))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return frame.select("doc_id", held_out, "text").mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")
