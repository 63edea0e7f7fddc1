"""Product codes of vectors: every part of a vector becomes the index of its
nearest codebook entry, found through a GNAT over the entries.

Components are integers (``SCALE`` steps a unit, floors go down), so distances,
codebook updates and ties are exact.  A GNAT (geometric near-neighbour access
tree) over the entries of a part position has split points far apart from each
other; every other entry belongs to its nearest split point, and for each pair
of a split point and a child the range of distances from the split point to the
child's entries is stored.  A query whose best distance so far is r leaves out
child j when its distance d to some split point i shows that every entry of j
is farther than r: d - r > high(i, j) or d + r < low(i, j).  Both tests are
strict and leave room for rounding, so an entry at the same distance is never
left out; what is reached is compared by integer squared distance, then index.

Fitting reads all rows in each round: a task adds up its rows per (part, entry,
position), and the sums of all tasks are merged by a grouped aggregation.  The
driver holds the codebooks alone (entries x dimension integers).

Awkward input: rows whose vector is null, empty or has null or non-finite
components are left out, and so are those of another length than the table's
dimension (see ``vectors.usable``).  With fewer than ``entries`` rows there are
as many entries as rows; rows of equal id are ordered by their vectors, rows
without id come last.  An empty table gives no rows.  A component of 2**20 or
more in size raises, since its squares would not fit."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.llm import vectors
from regula.session import written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: steps in size below which a distance and a task's sums fit into 64 bits
LIMIT = 1 << 28
#: split points of a tree node; nodes of at most this many entries are leaves
DEGREE = 8
#: part vectors searched at once
BLOCK = 1 << 14
#: labels up to which their sums are broadcast; beyond, rows are salted
FEW_LABELS = 1 << 14
SALTS = 64
#: relative room for rounding when distances are compared as doubles
ROOM = 2.0 ** -44


class Gnat:
    """Nearest entry of ``points`` (integers, one row an entry)."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None, degree: int = DEGREE):
        self.points, self.children = points, []
        self.index = np.arange(len(points)) if index is None else index
        if len(points) <= degree:
            return
        d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        splits = [0]
        while len(splits) < degree:
            splits.append(int(d[splits].min(axis=0).argmax()))
        if len(set(splits)) < degree:  # fewer distinct entries than split points
            return
        owner = d[splits].argmin(axis=0)
        owner[splits] = np.arange(degree)
        self.points, self.index = points[splits], self.index[splits]
        whole = np.arange(len(d)) if index is None else index
        for j in range(degree):
            rest = np.setdiff1d(np.flatnonzero(owner == j), splits)
            if len(rest):
                far = np.sqrt(d[np.ix_(splits, rest)])
                self.children.append((Gnat(points[rest], whole[rest], degree), far.min(axis=1), far.max(axis=1)))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each query's nearest entry, the least
        index of equally near ones, and the number of distances computed."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        found = np.full(len(queries), np.iinfo(np.int64).max)
        return found, best, self._search(queries, np.arange(len(queries)), found, best)

    def _search(self, queries, rows, found, best) -> int:
        near = np.empty((len(self.points), len(rows)))
        for i, (point, index) in enumerate(zip(self.points, self.index)):
            d = ((queries[rows] - point) ** 2).sum(axis=1)
            better = (d < best[rows]) | ((d == best[rows]) & (index < found[rows]))
            hit = rows[better]
            best[hit], found[hit] = d[better], index
            near[i] = np.sqrt(d)
        work = near.size
        for child, low, high in self.children:
            r = np.sqrt(best[rows])
            room = ROOM * (near + r + high[:, None])
            out = ((near - r - high[:, None] > room) | (low[:, None] - near - r > room)).any(axis=0)
            if not out.all():
                work += child._search(queries, rows[~out], found, best)
        return work


@dataclass(frozen=True)
class Codebooks:
    """books: parts x entries x width integers."""

    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared distances of whole vectors ``x``."""
        parts, _, width = self.books.shape
        codes, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
        for j, tree in enumerate(map(Gnat, self.books)):
            for at in range(0, len(x), BLOCK):
                part = np.ascontiguousarray(x[at:at + BLOCK, j * width:(j + 1) * width])
                codes[at:at + BLOCK, j], far[at:at + BLOCK, j], _ = tree.search(part)
        return codes, far


def _batches(dim: int, work: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch, vectors.steps(vectors.matrix(batch.column("vector"), dim), SCALE, LIMIT))
    return run


def _moved(rows: DataFrame, dim: int, books: Codebooks) -> Codebooks:
    """The codebooks after one round over all rows."""
    parts, entries, width = books.books.shape

    def sums(batches):
        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors.steps(vectors.matrix(batch.column("vector"), dim), SCALE, LIMIT)
            codes, _ = books.search(x)
            for j in range(parts):
                np.add.at(total[j], codes[:, j], x[:, j * width:(j + 1) * width])
                count[j] += np.bincount(codes[:, j], minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]),
                                          pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    per_task = rows.select("vector").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    # decimals, for the sums of all tasks may not fit into 64 bits
    merged = (per_task.select("part", "entry", "n", F.posexplode("sums").alias("position", "value"))
              .groupBy("part", "entry", "position").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")))
    out = books.books.copy()
    for r in merged.collect():  # at most entries x dimension rows
        out[r["part"], r["entry"], r["position"]] = int(r["total"]) // r["n"]
    return Codebooks(out)


def fit(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the vectors of ``rows`` (id, vector): the parts of the
    first ``entries`` rows by id, moved to the means of their parts in each
    round; an entry that nothing is nearest to stays."""
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    x = vectors.steps(np.array([r["vector"] for r in first], float), SCALE, LIMIT)
    books = Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _moved(rows, dim, books)
    return books


def encode(rows: DataFrame, dim: int, books: Codebooks) -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distance from
    the vector to its decoded form) of each row of ``rows`` (id, label, vector)."""
    def work(batch, x):
        codes, far = books.search(x)
        text = [bytes(c).hex() for c in codes.astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(far.sum(axis=1))],
                                         names=["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_batches(dim, work), f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` (with a column code) and the decoded components as ``decoded``,
    in steps of 1 / ``SCALE``."""
    def work(batches):
        for batch in batches:
            at = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()], np.int64).reshape(batch.num_rows, len(books.books))
            parts = [books.books[j][at[:, j]] for j in range(len(books.books))]
            whole = np.concatenate(parts, axis=1) if parts else at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole.tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.mapInArrow(work, f"{fields}, decoded array<long>")


def with_label_error(coded: DataFrame, few: int = FEW_LABELS) -> DataFrame:
    """``coded`` (label, error, ...) with the sum of errors over equal labels,
    nulls together.  The sums combine map-side; up to ``few`` of them are
    broadcast, more are joined on (label, salt), so that a common label's rows
    are dealt over many tasks."""
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= few:
        return coded.join(F.broadcast(sums), same).drop("of")
    salted = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("salt") == F.col("salt_of"))).drop("of", "salt", "salt_of")


def compress(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Fit codebooks to all usable vectors and encode them: id, code, error,
    label_error and codebooks_sha256 of each."""
    rows, dim = vectors.usable(df, {"id": id, "label": label}, vector, PARTS)
    books = fit(rows, dim) if dim else Codebooks(np.zeros((PARTS, 0, 0), np.int64))
    coded = with_label_error(written(encode(rows, dim, books)))
    return coded.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
