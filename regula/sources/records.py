"""Records of delimited files that are split between tasks although quoted
fields may hold line breaks, decoded per file.

Whether a line break ends a record depends on whether a quoted field is open,
that is on all bytes before it.  Two scans of the lines, as bytes, settle that
without reading a file in one task:

1. Each split is reduced to the states (no field open, a quoted field open) it
   would end in from either start, and whether its bytes are valid UTF-8.  The
   start states of the splits follow by composing these maps along each file;
   a file is decoded by the fallback if any of its splits is not valid.
2. Each task cuts its split into records from the known start.  A record that
   crosses the end of a split leaves fragments, which are put together after
   the scan.

A quote opens a field only at the field's start; within a quoted field a doubled
quote stands for one.  A quoted field that is never closed runs to the end of its
file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = b'"'
#: splits that start in an open field, or files to decode by the fallback, up
#: to which they are broadcast
FEW = 1 << 16


def advance(line: bytes, open_: bool, sep: bytes) -> tuple[bool, int]:
    """Whether a quoted field is open after ``line``, and the separators in it
    that part fields."""
    pos, parted = 0, 0
    while True:
        if open_ or line.startswith(QUOTE, pos):
            pos += 0 if open_ else 1
            while True:
                end = line.find(QUOTE, pos)
                if end < 0:
                    return True, parted
                if line[end + 1:end + 2] != QUOTE:
                    break
                pos = end + 2
            open_, pos = False, end + 1
        pos = line.find(sep, pos)
        if pos < 0:
            return False, parted
        parted, pos = parted + 1, pos + len(sep)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, start (of the split) and line (bytes), in the order of the file."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The lines of each split in a batch."""
    files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
    at = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or files[i] != files[at] or starts[i] != starts[at]:
            yield files[at], starts[at], batch.column("line").slice(at, i - at)
            at = i


def _quoted(lines: pa.Array) -> pa.Array:
    return pc.match_substring(lines, QUOTE)


def _valid(line: bytes) -> bool:
    try:
        line.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def split_maps(lines: DataFrame, sep: str) -> DataFrame:
    """file, start, from_shut, from_open (whether a field is open at the end of
    the split, for either start) and valid (UTF-8): one row per split."""
    by = sep.encode()

    def reduce_(batches):
        found: dict[tuple, list] = {}
        for batch in batches:
            for file, start, part in _runs(batch):
                state = found.setdefault((file, start), [False, True, True])
                for line in part.filter(_quoted(part)).to_pylist():
                    state[0], state[1] = advance(line, state[0], by)[0], advance(line, state[1], by)[0]
                state[2] = state[2] and all(map(_valid, part.to_pylist()))
        rows = [(f, s, *v) for (f, s), v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))],
                                         names=["file", "start", "from_shut", "from_open", "valid"])

    return lines.mapInArrow(reduce_, "file string, start long, from_shut boolean, from_open boolean, valid boolean")


def start_states(maps: DataFrame) -> DataFrame:
    """``maps`` with ``open``: whether a quoted field is open where the split
    starts.  A map that ends alike from both starts settles the state; maps that
    swap it are counted from there on."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    settled = F.col("from_shut") == F.col("from_open")
    swaps = F.sum((F.col("from_shut") & ~F.col("from_open")).cast("int"))
    at = maps.withColumn("swaps", swaps.over(upto))
    last = F.last(F.when(settled, F.struct("from_shut", "swaps")), ignorenulls=True).over(before)
    ahead = F.coalesce(F.last("swaps").over(before), F.lit(0))
    since = ahead - F.coalesce(last["swaps"], F.lit(0))
    return at.withColumn("open", F.coalesce(last["from_shut"], F.lit(False)) != (since % 2 == 1)).drop("swaps")


_PIECES = "file string, start long, place int, parted int, record binary"
#: places of a piece: a whole record, the rest of one that an earlier split
#: began, the beginning of one that runs on, or both
WHOLE, REST, BEGUN, WITHIN = 0, 1, 2, 3


def _pieces(lines: DataFrame, sep: str) -> DataFrame:
    """file, start, place, parted (separators) and record of each piece;
    ``lines`` has ``open`` as well.  The first record of a file, its header, is
    left out."""
    by = sep.encode()

    def cut(batches):
        key, held, parted, rest, header = None, [], 0, False, False

        def piece(place, count, record):
            return (key[0], key[1], place, count, record)

        def flush():
            if key is not None and held:
                yield piece(WITHIN if rest else BEGUN, parted, b"\n".join(held))

        for batch in batches:
            opens = batch.column("open")
            at, out = 0, []
            for file, start, part in _runs(batch):
                if (file, start) != key:
                    out += flush()
                    key, held, parted, header = (file, start), [], 0, start == 0
                    rest = bool(opens[at].as_py())
                    state = rest
                at += len(part)
                quotes = _quoted(part)
                if not state and not header and not pc.any(quotes).as_py():
                    counts = pc.count_substring(part, by).to_pylist()
                    out += [piece(WHOLE, n, line) for n, line in zip(counts, part.to_pylist())]
                    continue
                for line in part.to_pylist():
                    state, n = advance(line, state, by)
                    held.append(line)
                    parted += n
                    if not state:
                        if not header:
                            out.append(piece(REST if rest else WHOLE, parted, b"\n".join(held)))
                        held, parted, rest, header = [], 0, False, False
            yield _batch(out)
        yield _batch(list(flush()))

    def _batch(rows):
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "start", "place", "parted", "record"])

    return lines.mapInArrow(cut, _PIECES)


def _joined(pieces: DataFrame) -> DataFrame:
    """file, parted, record of the records that cross splits: each begins in a
    split and goes on through the splits after it until one ends it."""
    w = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.sum((F.col("place") == BEGUN).cast("int")).over(w)
    parts = pieces.where(F.col("place") != WHOLE).withColumn("number", begun)
    whole = parts.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("parts"), F.sum("parted").alias("parted"))
    text = F.array_join(F.transform("parts", lambda p: F.hex(p["record"])), "0A")
    return whole.select("file", F.col("parted").cast("int").alias("parted"), F.unhex(text).alias("record"))


def read_records(spark: SparkSession, paths: list[str], *, sep: str = "\t", encoding: str = "UTF-8", fallback: str | None = None) -> DataFrame:
    """record (text without the line break at its end) and fields (number of
    fields) of every record but the header of each file; empty lines are left
    out.  With ``fallback`` files that are not valid ``UTF-8`` are decoded by it."""
    lines = _lines(spark, paths)
    maps = split_maps(lines, sep)
    marks = start_states(maps).where("open").select("file", "start", F.lit(True).alias("open"))
    small = (lambda df: F.broadcast(df)) if marks.count() <= FEW else (lambda df: df)
    ordered = lines.withColumn("at", F.monotonically_increasing_id()).join(small(marks), ["file", "start"], "left")
    if marks.count() > FEW:
        ordered = ordered.repartition("file", "start").sortWithinPartitions("file", "start", "at")
    pieces = _pieces(ordered.select("file", "start", "line", F.coalesce("open", F.lit(False)).alias("open")), sep)
    records = pieces.where(F.col("place") == WHOLE).select("file", "parted", "record").unionByName(_joined(pieces))
    if fallback:
        bad = maps.where("not valid").select("file").distinct().withColumn("bad", F.lit(True))
        records = records.join(F.broadcast(bad) if bad.count() <= FEW else bad, "file", "left")
        text = F.when(F.col("bad"), F.decode("record", fallback)).otherwise(F.decode("record", "UTF-8"))
    else:
        text = F.decode("record", encoding)
    out = records.select(F.regexp_replace(text, "\r$", "").alias("record"), (F.col("parted") + 1).alias("fields"))
    return out.where(F.trim("record") != "")
