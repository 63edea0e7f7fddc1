"""Which keys tables share (B19, J6, U1-U3), reading each table once for all
pairs, and pages of a sorted view by the last key of the page before (F10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(names: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i, len(names))]


def _by_bitmap(keys: list[DataFrame], pairs: list[tuple[int, int]]) -> DataFrame:
    """i, j, n: distinct integer keys in both table i and table j.  A table's
    keys become bitmaps of 32 768 neighbouring values each, which combine before
    they are shuffled; a pair's bitmaps are and-ed."""
    maps = [df.groupBy(F.lit(t).alias("t"), F.bitmap_bucket_number("key").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits")) for t, df in enumerate(keys)]
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    mine = F.filter(listed, lambda p: (p["i"] == F.col("t")) | (p["j"] == F.col("t")))
    each = reduce(DataFrame.unionByName, maps).select("bucket", "bits", F.explode(mine).alias("p")).select("p.*", "bucket", "bits")
    both = each.groupBy("i", "j", "bucket").agg(F.count("*").alias("m"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where("i = j or m = 2").groupBy("i", "j").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def _by_mask(keys: list[DataFrame], pairs: list[tuple[int, int]]) -> DataFrame:
    """As ``_by_bitmap`` for keys of any type: one tagged union, a membership
    mask per key, and the counts of the masks."""
    tagged = reduce(DataFrame.unionByName, [df.select("key", F.lit(1 << t).cast("long").alias("mask")) for t, df in enumerate(keys)])
    masks = tagged.groupBy("key").agg(F.bit_or("mask").alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit((1 << i) | (1 << j)).cast("long").alias("want")) for i, j in pairs])
    held = F.filter(listed, lambda p: F.col("mask").bitwiseAND(p["want"]) == p["want"])
    return masks.select("n", F.explode(held).alias("p")).groupBy(F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("n").alias("n"))


def key_overlaps(tables: dict[str, tuple[DataFrame, str]], *, dense: bool = False) -> DataFrame:
    """left, right, left_keys, right_keys, in_both: distinct keys of each pair
    of tables (name -> table, key column) and those they share; null is no key.

    ``dense`` says that keys are integers that lie close together; bitmaps then
    take one bit a key.  Otherwise a key travels with a mask of its tables."""
    names = list(tables)
    keys = [df.select(F.col(f"`{k}`").cast("long").alias("key") if dense else F.col(f"`{k}`").alias("key")).where("key is not null")
            for df, k in tables.values()]
    found = (_by_bitmap if dense else _by_mask)(keys, _pairs(names))
    counts = found.agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "n"))).alias("at"))  # a number per pair of tables

    def n(i: int, j: int) -> Column:
        return F.coalesce(F.try_element_at("at", F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))), F.lit(0)).cast("long")

    rows = [F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), n(i, i).alias("left_keys"), n(j, j).alias("right_keys"),
                     n(i, j).alias("in_both")) for i, j in _pairs(names) if i < j]
    return counts.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def page_after(df: DataFrame, order: list[tuple[str, bool]], size: int, last: dict | None = None) -> DataFrame:
    """The ``size`` rows that follow ``last`` (values of the order columns on
    the last row of the page before; none for the first page).

    ``order`` has (column, descending) and must be unique per row; nulls come
    first where a column ascends and last where it descends.  Rows up to
    ``last`` are filtered away where they are read, so a later page sorts no more
    than the first: each task keeps ``size`` rows."""
    if last is not None:
        def beyond(c: str, down: bool) -> Column:
            x, v = F.col(f"`{c}`"), last[c]
            if v is None:
                return F.lit(False) if down else x.isNotNull()
            return (x < F.lit(v)) | x.isNull() if down else x > F.lit(v)

        cond, same = F.lit(False), F.lit(True)
        for c, down in order:
            cond = cond | (same & F.coalesce(beyond(c, down), F.lit(False)))
            same = same & F.col(f"`{c}`").eqNullSafe(F.lit(last[c]))
        df = df.filter(cond)
    return df.orderBy(*[F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_first() for c, down in order]).limit(size)


def last_key(page: DataFrame, order: list[tuple[str, bool]]) -> dict | None:
    """The order columns of a page's last row: what ``page_after`` goes on from."""
    rows = page.select(*[F.col(f"`{c}`") for c, _ in order]).collect()  # one page
    return rows[-1].asDict() if rows else None
