"""Fuzzy line deduplication over a whole corpus, with DataFrame operations only.

A line is what stands between line feeds, without surrounding white space;
lines without any other character are left alone.  A line's set is its distinct
shingles of ``Q`` characters (a shorter line is one shingle).  Lines are linked
at a Jaccard similarity of at least ``PERCENT`` per cent.

Signature: one hash throws each shingle into one of ``BANDS * ROWS`` cells and a
cell keeps its least value; three cells make a bucket.  Values so large that
they are the least of their cell once in 3 000 times only (``ENOUGH`` smaller ones
are expected in a line without repeats) are left out before the aggregation, and
lines left with an empty cell are signed again with all values.  A pair at 0.8 shares
one of the eight buckets with probability 0.997, at 0.9 with 0.99997.  One row
per character position exists only inside generated code, ahead of the
map-side aggregation per line; what is shuffled is one row per distinct line
and task.  Candidates are confirmed on their full sets, and a distributed
union-find (``links``) joins the links up.  Of each component the first line,
by document id and position, stays.

A line is known by its 64-bit hash.  Texts are moved once, for candidate lines
only (``links.likely_rows`` leaves out the others by a broadcast table whose
size is bounded by construction).

Defined results: a null text has no lines and stays null; an empty text stays
empty; equal lines are one class however often they occur; rows that share an
id count as one document, so equal rows stay equal; rows without id come after
all ids and count as one document; an empty table gives an empty table; extra
columns are carried by ``dedup_lines`` and cannot clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regula.llm.links import alike, likely_rows, linked_components, paired, set_marks
from regula.session import release, written

Q = 10
PERCENT = 80
BANDS = 8
ROWS = 3
ENOUGH = 192
#: rows that share out a line's bands while they are found
PARTS = 4
#: words of 64 parities that rule out pairs of crowded buckets
WORDS = 32
# White space around a line.
BLANKS = " \t\r\x0b\x0c"
_LAST = 2**63 - 1


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, pos, line (trimmed), k (its hash) of every line."""
    lines = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_LAST)).alias("did"),
                        F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("pos", "raw"))
    lines = lines.select("did", "pos", F.btrim("raw", F.lit(BLANKS)).alias("line"))
    return lines.select("did", "pos", "line", F.xxhash64("line").alias("k"))


def _cells(lines: DataFrame, cut: bool) -> DataFrame:
    """k, part, size and the part's cells c0, c1, ... of each line; with ``cut``,
    values above the line's bound leave their cell empty.  Every row of an
    aggregation writes all its columns, so a line's cells are in ``PARTS`` rows."""
    cells, own = BANDS * ROWS, BANDS * ROWS // PARTS
    coded = lines.where("line <> ''").select("k", F.expr("encode(line, 'UTF-16BE')").alias("code")) \
        .select("k", "code", F.expr("octet_length(code) div 2").alias("n"))
    # the positions below 0 give a row to each part, so that none is missing
    spots = coded.select("k", "n", "code", F.explode(F.expr(f"sequence({-PARTS}, greatest(cast(n as int) - {Q}, 0))")).alias("p"))
    # as rows of its own, a hash is not made anew for every filter and column that names it
    hashed = spots.select("k", "n", "p", F.explode(F.expr(f"array(xxhash64(substring(code, 2 * greatest(p, 0) + 1, {2 * Q})))")).alias("h"))
    real = F.expr("p >= 0")
    if cut:
        low = f"(h & 4294967295) * n < {ENOUGH << 32}"
        hashed = hashed.where(f"p < 0 OR {low}")
    thrown = hashed.select("k", "n", F.when(real, F.expr(f"cast(shiftrightunsigned(h, 33) % {cells} as int)"))
                           .otherwise(F.expr(f"(-1 - p) * {own}")).alias("cell"), F.when(real, F.expr("h & 4294967295")).alias("v"))
    return thrown.groupBy("k", F.expr(f"cell div {own}").cast("int").alias("part")).agg(
        F.max(F.greatest(F.col("n") - (Q - 1), F.lit(1))).alias("size"),
        *[F.min(F.when(F.col("cell") % own == j, F.col("v"))).alias(f"c{j}") for j in range(own)])


def _signs(lines: DataFrame, cut: bool) -> DataFrame:
    """k, part, size, whole and buckets (one per band, null without a filled
    cell) of each line's parts; ``whole`` is false where the cut can have left an
    empty cell.  Later steps read these few columns, not the cells."""
    bands = BANDS // PARTS
    keys = []
    for b in range(bands):
        own = [F.col(f"c{b * ROWS + r}") for r in range(ROWS)]
        filled = F.coalesce(*own).isNotNull()
        keys.append(F.when(filled, F.xxhash64(F.col("part") * bands + b, *[F.coalesce(c, F.lit(-1)) for c in own])))
    full = F.least(*[F.col(f"c{j}").isNotNull() for j in range(bands * ROWS)])
    # the cut spares lines of at most ENOUGH code units
    whole = full | (F.col("size") <= ENOUGH - Q) if cut else F.lit(True)
    return _cells(lines, cut).select("k", "part", "size", whole.alias("whole"), F.array(*keys).alias("buckets"))


def _signed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables of ``_signs``; the second has what replaces the rows of
    the first that are not ``whole``.

    A cell that the cut leaves filled holds its least value.  Lines that the
    cut can have left with an empty cell (those of a repeated phrase have few
    distinct shingles for their length) are signed again without it."""
    first = written(_signs(lines, True))
    holes = first.where("NOT whole").select("k", "part")
    again = _texts(lines, holes.select(F.col("k").alias("id")).distinct())
    return first, written(_signs(again.withColumnRenamed("id", "k"), False).join(holes, ["k", "part"], "left_semi"))


def signatures(lines: DataFrame) -> DataFrame:
    """k, part, size (shingle positions) and buckets of each distinct line's parts."""
    first, again = _signed(lines)
    return first.where("whole").union(again).drop("whole")


def line_buckets(signed: DataFrame) -> DataFrame:
    """bucket, id: one row per line and band with a filled cell."""
    return signed.select(F.col("k").alias("id"), F.explode("buckets").alias("bucket")).where("bucket IS NOT NULL")


def _shingles(line: str) -> str:
    code = f"encode({line}, 'UTF-16BE')"
    return (f"array_distinct(transform(array({code}), c -> transform(sequence(0, greatest(cast(octet_length(c) div 2 as int) - {Q}, 0)),"
            f" p -> xxhash64(substring(c, 2 * p + 1, {2 * Q}))))[0])")


def _texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """id (the hash), line of the distinct lines named by ``ids`` (column id)."""
    near = likely_rows(lines.where("line <> ''").select(F.col("k").alias("id"), "line"), "id", ids)
    return near.join(ids, "id", "left_semi").dropDuplicates(["id"])


def line_components(lines: DataFrame) -> DataFrame:
    """id, component of the distinct lines that are linked with another one."""
    first, again = _signed(lines)
    buckets = line_buckets(first.where("whole").union(again))

    def near(ids: DataFrame) -> DataFrame:
        return _texts(lines, ids)

    def marks(kept: DataFrame, ids: DataFrame) -> DataFrame:
        texts = likely_rows(kept, "id", ids).join(ids, "id", "left_semi")
        return set_marks(texts.select("id", F.explode(F.expr(_shingles("line"))).alias("h")), WORDS)

    def verify(kept: DataFrame, pairs: DataFrame) -> DataFrame:
        sets = F.inline(F.expr(f"array(named_struct('sa', {_shingles('sa')}, 'sb', {_shingles('sb')}))"))
        return alike(paired(pairs, kept, "line").select("a", "b", sets), PERCENT)

    joined = linked_components(buckets, near, verify, marks, PERCENT)
    release(first, again)
    return joined


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, n_lines and the sorted positions of the lines that stay."""
    lines = line_rows(docs, id_col, text_col)
    joined = line_components(lines)
    # a blank line is a class of its own
    key = F.when(F.col("line") == "", F.xxhash64(F.lit("blank"), "did", "pos")).otherwise(F.col("k"))
    spots = lines.select(key.alias("k"), "did", "pos").groupBy("k", "did").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))
    named = spots.join(joined, F.col("k") == F.col("id"), "left").groupBy(F.coalesce("component", "k").alias("class"), "did") \
        .agg(F.min("pos").alias("pos"), F.max("last").alias("last"))
    named = written(named)
    release(joined)
    first = named.groupBy("class").agg(F.min("did").alias("first_did"))
    spot = F.when(F.col("did") == F.col("first_did"), F.col("pos"))
    return named.join(first, "class").groupBy("did").agg((F.max("last") + 1).cast("bigint").alias("n_lines"),
                                                         F.array_sort(F.collect_set(spot)).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every text cut down to the lines that stay; documents
    left without any line are kept with an empty text."""
    kept = kept_lines(docs, id_col, text_col)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_LAST)).alias("_did"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = rows.join(kept, F.col("_did") == F.col("did"), "left")
    text = F.expr(f"transform(array(split(_row.`{text_col}`, '\\n')), l -> array_join(transform(kept, p -> get(l, p)), '\\n'))[0]")
    return joined.select(*[F.when(F.col(f"_row.{c}").isNotNull(), text).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c)
                           for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_kept and the positions of the kept lines, per id."""
    kept = kept_lines(docs, id_col, text_col)
    ids = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_LAST)).alias("_did"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"))
    return ids.join(kept, F.col("_did") == F.col("did"), "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("kept"), F.lit(0)).cast("bigint").alias("n_kept"),
        F.coalesce(F.array_join("kept", ","), F.lit("")).alias("kept_lines"))
