"""Near-duplicate documents by fast similarity sketching.

A document's set is its distinct word shingles.  The sketch throws all
elements into ``BINS`` bins in rounds: in each of the first ``BINS`` rounds a
fresh hash gives every element a bin and a value, in the next ``BINS`` rounds
all elements go to the one bin of the round's number.  A bin keeps the least
value of the earliest round that reached it, and the rounds end when no bin is
empty, which the second half guarantees.  Each coordinate of two sketches
agrees with a probability equal to the sets' Jaccard similarity, with
concentration as if coordinates were independent.

Bands of coordinates give buckets; members of a bucket are compared on their
full sets (``links.linked_components``).  Documents of equal sets are one class
first, so copies cost one row each whatever their number.  With 24 bands of 5,
a pair at the threshold 0.85 shares no bucket with probability 8e-7.

Defined results: a null or word-less text has the empty set, n_shingles 0 and
stands alone; rows that share a doc_id count as one document (their classes
are linked); a row without doc_id belongs to its class but names none, and
stands alone if the class has no id; an empty table gives an empty table;
extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.llm.links import alike, components, likely_rows, linked_components, not_ruled_out, paired
from regula.llm.text import lower_ascii, mix, shingle_hashes, slices, span_hashes, text_bytes, word_spans
from regula.session import release, written

BANDS = 24
ROWS = 5
#: words of 64 parities that rule out pairs of crowded buckets
WORDS = 16
_EMPTY = np.uint64(2**64 - 1)


def fast_sketch(values: np.ndarray, rows: np.ndarray, n_rows: int, bins: int) -> np.ndarray:
    """Sketches (n_rows, bins) of the sets given as (row, element hash); rows
    without elements stay at the largest value."""
    sketch = np.full((n_rows, bins), _EMPTY, np.uint64)
    flat = sketch.reshape(-1)
    for i in range(2 * bins):
        if not len(values):
            break
        h = mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        where = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, rows * bins + where, (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32))
        live = np.unique(rows)
        open_rows = live[(sketch[live] == _EMPTY).any(axis=1)]
        if len(open_rows) < len(live):
            stay = np.zeros(n_rows, bool)
            stay[open_rows] = True
            values, rows = values[stay[rows]], rows[stay[rows]]
    return sketch


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow string array."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, rows = word_spans(data, offsets)
    hashes, owners = shingle_hashes(span_hashes(data, starts, ends), rows, len(column), size)
    hashes = hashes[np.argsort(owners, kind="stable")]
    stops = np.cumsum(np.bincount(owners, minlength=len(column)))
    for stop, n in zip(stops, np.diff(stops, prepend=0)):
        yield np.unique(hashes[stop - n:stop])


def sketch_documents(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set; null if empty), buckets
    (one hash per band) from doc_id and text."""
    schema = "doc_id bigint, n_shingles bigint, digest binary, buckets array<bigint>"

    def sketch(batches):
        for part in slices(batches, "text"):
            sets = list(shingle_sets(part.column("text"), shingle))
            sizes = np.array([len(s) for s in sets])
            owners = np.repeat(np.arange(len(sets)), sizes)
            cells = fast_sketch(np.concatenate(sets), owners, len(sets), bands * rows).reshape(len(sets), bands, rows)
            keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) << np.uint64(32), (len(sets), bands)).copy()
            for j in range(rows):
                keys = mix(keys + cells[:, :, j])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32)),
                                          pa.array(keys.view(np.int64).ravel()))],
                names=["doc_id", "n_shingles", "digest", "buckets"])

    return docs.mapInArrow(sketch, schema)


def set_table(docs: DataFrame, shingle: int) -> DataFrame:
    """id, the whole set as an array of hashes, its size and its parities (as
    ``links.set_marks``)."""
    names = ["id", "n", *[f"w{j}" for j in range(WORDS)]]

    def sets(batches):
        for part in slices(batches, "text"):
            sets = list(shingle_sets(part.column("text"), shingle))
            sizes = np.array([len(s) for s in sets], np.int64)
            h = np.concatenate(sets)
            odd = np.zeros((len(sets), WORDS), np.uint64)
            np.bitwise_xor.at(odd, (np.repeat(np.arange(len(sets)), sizes), ((h >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64)),
                              np.uint64(1) << (h & np.uint64(63)))
            ends = np.cumsum([0, *sizes]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), *[pa.array(odd[:, j].copy().view(np.int64)) for j in range(WORDS)],
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=[*names, "shingles"])

    return docs.mapInArrow(sets, ", ".join(f"{c} bigint" for c in names) + ", shingles array<bigint>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links of
    Jaccard similarity >= percent / 100), kept (it is that document)."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sketches = written(sketch_documents(texts, shingle, bands, rows))
    classes = sketches.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    member = written(
        sketches.where("digest IS NOT NULL").join(classes, "digest").select("doc_id", "n_shingles", "first_id")
        .union(sketches.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("first_id"))))
    one = classes.select("digest", F.col("first_id").alias("id"))
    buckets = sketches.join(one.hint("merge"), "digest").where("doc_id = id").dropDuplicates(["id", "digest"]) \
        .select("id", F.explode("buckets").alias("bucket"))

    left: list[DataFrame] = []

    def near(ids: DataFrame) -> DataFrame:
        return set_table(likely_rows(texts, "doc_id", ids).join(ids.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi"), shingle)

    def marks(kept: DataFrame, ids: DataFrame) -> DataFrame:
        return kept.drop("shingles").join(ids, "id", "left_semi").distinct()

    def verify(kept: DataFrame, pairs: DataFrame) -> DataFrame:
        left.append(written(not_ruled_out(pairs, kept.drop("shingles"), percent)))
        return alike(paired(left[-1], kept, "shingles"), percent).distinct()

    found = linked_components(buckets, near, verify, marks, percent)
    release(sketches, *left)
    # rows of one id in several classes tie these classes together
    shared = member.groupBy("doc_id").agg(F.min("first_id").alias("lo"), F.max("first_id").alias("hi")).where("lo < hi")
    ties = member.join(shared, "doc_id").where("first_id > lo").select(F.col("first_id").alias("a"), F.col("lo").alias("b"))
    if not ties.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(ties))
    named = member.join(found.withColumnRenamed("id", "first_id"), "first_id", "left")
    component = F.coalesce("component", "first_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, with all their columns: one of each group
    (rows sharing an id stay or go together), rows without id included."""
    stay = near_duplicates(docs, id_col=id_col, **options).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(stay, F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col("_kept_id")), "left_semi")
