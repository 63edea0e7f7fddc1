"""Profiling and data-quality operators (B-series).

Each profile is ONE aggregation pass over the table (many expressions in a
single ``agg``), unpivoted to long form afterwards.  Value distributions
unpivot the chosen columns into (column, value) pairs and aggregate those
with map-side combining; per-column cardinality filters are applied on the
aggregated pairs, so no step keeps a whole column in one task.

Values and rows are counted by 128-bit fingerprints, so what is shuffled is of
constant size whatever a row holds.  Distinct counts come from (column,
fingerprint) pairs; mergeable sketches (``column_sketches``) screen columns that
need no exact count.  Rows whose fingerprint occurs twice are compared in whole.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regula.functions.columns import equal_width_bin, skew_bias_corrected
from regula.operators.keysets import key_overlaps

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _unpivot_rows(one_row: DataFrame, cols: list[str], metrics: list[str],
                  extra: tuple[str, ...] = ()) -> DataFrame:
    """One-row frame with ``<col>__<metric>`` fields -> one row per column;
    ``extra`` table-level fields are repeated on every row."""
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                        *[F.col(f"`{c}__{m}`").alias(m) for m in metrics],
                        *[F.col(e) for e in extra])
               for i, c in enumerate(cols)]
    return one_row.select(F.explode(F.array(*structs)).alias("_p")).select("_p.*")


def table_shape(df: DataFrame, table: str) -> DataFrame:
    """Rows and columns (B1)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(table).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))


def dtype_tally(df: DataFrame, table: str) -> DataFrame:
    """Columns per data type (B21), next to the table's rows."""
    kinds = Counter(f.dataType.simpleString() for f in df.schema.fields)
    listed = F.array(*[F.struct(F.lit(k).alias("dtype"), F.lit(n).alias("n_columns")) for k, n in sorted(kinds.items())])
    return table_shape(df, table).select("table", "rows", F.explode(listed).alias("_t")).select("table", "_t.dtype", "_t.n_columns", "rows")


def _hashes(*cols: Column) -> tuple[Column, Column]:
    """128 bits of the given values."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("2"), *cols)


def _hashable(f: T.StructField) -> Column:
    """A column in a form whose hash tells its values apart: hashing skips
    nulls inside arrays and cannot read maps, so nested values become text."""
    x = F.col(f"`{f.name}`")
    nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(F.struct(x), {"ignoreNullFields": "false"}) if nested else x


def row_fingerprint(df: DataFrame) -> list[Column]:
    """h1, h2: 128 bits of a whole row.  Hashing skips nulls, so whether each
    column is null goes in as well."""
    parts = [y for f in df.schema.fields for y in (F.col(f"`{f.name}`").isNull(), _hashable(f))]
    return [h.alias(n) for h, n in zip(_hashes(*parts), ("h1", "h2"))]


#: repeated fingerprints up to which they are broadcast to the rows
FEW_REPEATED = 1 << 18


def _duplicates(df: DataFrame, repeated: int) -> DataFrame:
    """duplicate_rows of a table with ``repeated`` fingerprints that occur
    twice or more: only rows that bear one are compared, in whole."""
    if not repeated:
        return df.sparkSession.range(1, numPartitions=1).select(F.lit(0).cast("long").alias("duplicate_rows"))
    marks = row_fingerprint(df)
    twice = df.select(*marks).groupBy("h1", "h2").agg(F.count("*").alias("m")).where("m > 1").select("h1", "h2")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *marks)
    found = row.join(F.broadcast(twice) if repeated <= FEW_REPEATED else twice, ["h1", "h2"], "left_semi")
    return found.groupBy("row").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("duplicate_rows"))


def _row_groups(tables: dict[str, DataFrame], per_row) -> DataFrame:
    """table, rows, duplicate_rows (rows beyond the first of each distinct row,
    nulls equal) and the sums of the per-row numbers that ``per_row`` gives for
    a table; one row per table.

    One scan of each table groups its fingerprints; the counts per table, one
    row each, pass through the driver."""
    stats, names = [], []
    for name, df in tables.items():
        numbers = per_row(df)
        names = list(numbers)
        g = df.select(*row_fingerprint(df), *[e.cast("long").alias(n) for n, e in numbers.items()])
        g = g.groupBy("h1", "h2").agg(F.count("*").alias("m"), *[F.sum(n).alias(n) for n in names])
        stats.append(g.agg(F.lit(name).alias("table"), F.coalesce(F.sum("m"), F.lit(0)).alias("rows"), F.count_if(F.col("m") > 1).alias("repeated"),
                           *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]))
    out = []
    for r in union_all(stats).collect():
        fixed = [F.lit(r["table"]).alias("table"), *[F.lit(r[n]).cast("long").alias(n) for n in ("rows", *names)]]
        out.append(_duplicates(tables[r["table"]], r["repeated"]).select(*fixed, "duplicate_rows"))
    return union_all(out)


def _count_in_row(conds) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conds], F.lit(0))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``duplicated().sum()``: rows minus distinct rows, nulls equal."""
    return _row_groups({"": df}, lambda _: {}).select("duplicate_rows")


def column_sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, position, rows, non_null and sketch of the distinct values
    (HyperLogLog) of each column, from one pass without a shuffle of values.
    Stored sketches of parts of a table are merged by ``merge_sketches``."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    exprs = [F.count(F.lit(1)).alias("rows")]
    for f in fields:
        x = F.col(f"`{f.name}`")
        exprs += [F.count(x).alias(f"{f.name}__non_null"),
                  F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(_hashable(f)))).alias(f"{f.name}__sketch")]
    return _unpivot_rows(df.agg(*exprs), [f.name for f in fields], ["non_null", "sketch"], ("rows",))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several parts of a table as those of the whole."""
    return sketches.groupBy("column_name", "position").agg(F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
                                                          F.hll_union_agg("sketch").alias("sketch"))


def _estimates(df: DataFrame, columns: list[str] | None = None) -> dict:
    """Per column (bounded by the schema): rows, non_null and about how many distinct values."""
    found = column_sketches(df, columns).select("column_name", "rows", "non_null", F.hll_sketch_estimate("sketch").alias("about"))
    return {r["column_name"]: r for r in found.collect()}


def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, position, rows, null_count, non_null and the exact
    n_distinct of each column.

    One scan gives a (column, fingerprint) pair per value; the pairs combine
    map-side and are shuffled by fingerprint, so neither a long value nor a
    common one, nor the number of columns counted, makes a row copy."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, position int, rows long, null_count long, non_null long, n_distinct long")
    pairs = []
    for i, f in enumerate(fields):
        h1, h2 = _hashes(_hashable(f))
        null = F.col(f"`{f.name}`").isNull()
        pairs.append(F.struct(F.lit(i).alias("position"), F.when(~null, h1).alias("h1"), F.when(~null, h2).alias("h2")))
    each = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").groupBy("position", "h1", "h2").agg(F.count("*").alias("m"))
    sums = each.groupBy("position").agg(F.sum("m").alias("rows"), F.sum(F.when(F.col("h1").isNotNull(), F.col("m"))).alias("non_null"),
                                        F.count("h1").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(f.name, i) for i, f in enumerate(fields)], "column_name string, position int")
    nought = {n: F.coalesce(n, F.lit(0)).cast("long") for n in ("rows", "non_null", "n_distinct")}
    out = names.join(F.broadcast(sums), "position", "left")  # one row a column
    return out.select("column_name", "position", nought["rows"].alias("rows"), (nought["rows"] - nought["non_null"]).alias("null_count"),
                      nought["non_null"].alias("non_null"), nought["n_distinct"].alias("n_distinct"))


def _dtypes(df: DataFrame) -> Column:
    return F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])[F.col("column_name")]


def column_profile(df: DataFrame, columns: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """Per column: type, null count, null %, non-null, distinct (B3).  Without
    ``distinct`` the (shuffling) distinct counts are left out as null."""
    cols = df.columns if columns is None else columns
    if distinct:
        long = column_counts(df, cols)
    else:
        exprs = [F.count(F.lit(1)).alias("rows")]
        for c in cols:
            x = F.col(f"`{c}`")
            exprs += [F.count_if(x.isNull()).alias(f"{c}__null_count"), F.count(x).alias(f"{c}__non_null")]
        long = _unpivot_rows(df.agg(*exprs), cols, ["null_count", "non_null"], ("rows",)).withColumn("n_distinct", F.lit(None).cast("long"))
    return long.select("column_name", "position", _dtypes(df).alias("dtype"), "null_count", (F.try_divide("null_count", "rows") * 100).alias("null_pct"),
                       "non_null", "n_distinct", "rows")


def null_analysis(df: DataFrame) -> DataFrame:
    """Columns that have nulls, by null count descending."""
    p = column_profile(df, distinct=False)
    return p.filter(F.col("null_count") > 0).select("column_name", "null_count", "null_pct")


def clean_column_profile(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Type, non-null, distinct and a deterministic first-row sample (B5):
    the value on the smallest ``order_by`` row (non-null values first on
    ties), rendered as text."""
    exprs = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        key = F.struct(*[F.col(k) for k in order_by], x.isNull().alias("_isnull"), x.cast("string").alias("_v"))
        exprs.append(F.min_by(x.cast("string"), key).alias(f"{c}__sample"))
    samples = _unpivot_rows(df.agg(*exprs), df.columns, ["sample"]).drop("position")
    long = column_counts(df).join(F.broadcast(samples), "column_name")  # one row a column
    return long.select("column_name", _dtypes(df).alias("dtype"), "non_null", "n_distinct", "sample")


def all_null_columns(df: DataFrame) -> DataFrame:
    """Columns without a single non-null value."""
    return column_profile(df, distinct=False).filter(F.col("non_null") == 0).select("column_name")


def _pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(position, column, value) pairs of the chosen columns, values as text."""
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                        F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cols)]
    return df.select(F.explode(F.array(*structs)).alias("_p")).select("_p.*")


def value_distributions(df: DataFrame, cols: list[str], *, max_distinct: int = 20, top: int = 10,
                        first_columns: int | None = None) -> DataFrame:
    """Top values of the columns with fewer than ``max_distinct`` distinct
    values: count and % of all rows (B8; B9 with ``first_columns``)."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, count long, pct double")
    # sketches find the columns that can be small at all (their error is far
    # below the factor of two), so only those are read and shuffled by value
    about = _estimates(df, cols)
    small = [c for c in cols if about[c]["about"] < 2 * max_distinct]
    if not small:
        return df.sparkSession.createDataFrame([], "column_name string, value string, count long, pct double, rank int")
    pairs = _pairs(df, small)
    g = pairs.groupBy("position", "column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    card = g.groupBy("position").agg(F.count("value").alias("_distinct"), F.sum("count").alias("_rows"))
    keep = card.filter(F.col("_distinct") < max_distinct)
    if first_columns is not None:
        keep = keep.withColumn("_ord", F.row_number().over(Window.orderBy("position"))) \
                   .filter(F.col("_ord") <= first_columns).drop("_ord")
    v = g.filter(F.col("value").isNotNull()).join(F.broadcast(keep), "position", "inner")
    w = Window.partitionBy("position").orderBy(F.col("count").desc(), F.col("value"))
    return (v.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
             .select("column_name", "value", "count", (F.try_divide("count", F.col("_rows")) * 100).alias("pct"),
                     "rank"))


# Words in key column names.
KEY_WORDS = ("id", "status", "type", "code", "flag", "priority")


def key_column_distributions(df: DataFrame, *, max_distinct: int = 50, first_columns: int = 5,
                             top: int = 5) -> DataFrame:
    """Columns whose name contains an id/status/type/code/flag/priority word
    and that have fewer than 50 distinct values: the first 5, top 5 each (B9)."""
    cols = [c for c in df.columns if any(w in c.lower() for w in KEY_WORDS)]
    return value_distributions(df, cols, max_distinct=max_distinct, top=top, first_columns=first_columns)


def empty_string_count(df: DataFrame) -> DataFrame:
    """Empty strings over all string columns."""
    cols = string_columns(df)
    e = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`") == "") for c in cols], F.lit(0).cast("long"))
    return df.agg(e.alias("empty_strings"))


# Words in flag column names.
FLAG_WORDS = ("flag", "missing", "has")


def flag_columns(df: DataFrame) -> DataFrame:
    """Flag columns (name contains flag/missing/has) with the count of 1s;
    non-numeric flags count 0, as in the reference (B11)."""
    cols = [c for c in df.columns if any(w in c.lower() for w in FLAG_WORDS)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, flagged long")
    num = set(numeric_columns(df))
    one = df.agg(*[(F.count_if(F.col(f"`{c}`") == 1) if c in num else F.lit(0).cast("long")).alias(f"{c}__flagged")
                   for c in cols])
    return _unpivot_rows(one, cols, ["flagged"]).select("column_name", "flagged")


def null_cells(df: DataFrame) -> DataFrame:
    e = reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns], F.lit(0).cast("long"))
    return df.agg(e.alias("nulls"))


def quality_summary(df: DataFrame, table: str) -> DataFrame:
    """Rows, columns, null cells, empty strings, duplicates and number of
    flag columns (name contains flag/missing) of one table (B12)."""
    nflags = len([c for c in df.columns if "flag" in c.lower() or "missing" in c.lower()])
    one = _row_groups({table: df}, lambda t: {
        "nulls": _count_in_row([F.col(f"`{c}`").isNull() for c in t.columns]),
        "empty_strings": _count_in_row([F.col(f"`{c}`") == "" for c in string_columns(t)])})
    return one.select("table", "rows", F.lit(len(df.columns)).alias("columns"), "nulls", "empty_strings",
                      F.col("duplicate_rows").alias("duplicates"), F.lit(nflags).alias("flag_columns"))


def load_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, total null cells, duplicate rows of each table (B2)."""
    one = _row_groups(tables, lambda t: {"null_values": _count_in_row([F.col(f"`{c}`").isNull() for c in t.columns])})
    columns = F.create_map(*[x for n, t in tables.items() for x in (F.lit(n), F.lit(len(t.columns)))])[F.col("table")]
    return one.select("table", "rows", columns.alias("columns"), "null_values", "duplicate_rows")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def non_ascii_rows(df: DataFrame, max_columns: int = 3) -> DataFrame:
    """Rows with a character outside 0x00-0x7F in each of the first three
    string columns (B13)."""
    cols = string_columns(df)[:max_columns]
    one = df.agg(*[F.count_if(F.col(f"`{c}`").rlike("[^\\x00-\\x7F]")).alias(f"{c}__non_ascii_rows") for c in cols])
    return _unpivot_rows(one, cols, ["non_ascii_rows"]).select("column_name", "non_ascii_rows")


def parse_timestamp(col, formats=("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd")):
    """``to_datetime(errors='coerce')`` for the usual layouts."""
    x = F.col(col) if isinstance(col, str) else col
    return F.coalesce(*[F.try_to_timestamp(x.cast("string"), F.lit(f)) for f in formats])


def date_columns(df: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Date-column detection (B14): name contains "date", date/timestamp
    type, or more than ``min_share`` of a string column's non-null values
    parse as dates (the whole column, not a 100-row sample; each distinct value
    is parsed once and counts as often as it occurs)."""
    dated = [f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) or "date" in f.name.lower()]
    named = df.sparkSession.createDataFrame([(c, "name_or_type") for c in dated], "column_name string, reason string")
    texts = [c for c in string_columns(df) if c not in dated]
    if not texts:
        return named
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("_v")) for c in texts])).alias("_c")).select("_c.*")
    values = cells.filter(F.col("_v").isNotNull()).groupBy("column_name", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = values.groupBy("column_name").agg(F.sum("_n").alias("_nn"), F.sum(F.when(parse_timestamp("_v").isNotNull(), F.col("_n"))).alias("_parsed"))
    parsed = counts.filter(F.col("_parsed") > F.col("_nn") * min_share).select("column_name", F.lit("parsed_values").alias("reason"))
    return named.unionByName(parsed)


def date_range(df: DataFrame, col: str) -> DataFrame:
    """Min, max, valid and total rows of a date column."""
    d = df.schema[col].dataType
    x = F.col(col) if isinstance(d, (T.DateType, T.TimestampType, T.TimestampNTZType)) else parse_timestamp(col)
    return df.agg(F.min(x).alias("min_date"), F.max(x).alias("max_date"), F.count(x).alias("valid"),
                  F.count(F.lit(1)).alias("total"))


def shared_columns(spark, schemas: dict[str, list[str]]) -> DataFrame:
    """Shared column names for each table pair (B16), from schema metadata."""
    rows = [(i, t, c) for i, (t, cols) in enumerate(schemas.items()) for c in cols]
    m = spark.createDataFrame(rows, "idx int, tbl string, col string")
    a, b = m.alias("a"), m.alias("b")
    j = a.join(b, (F.col("a.col") == F.col("b.col")) & (F.col("a.idx") < F.col("b.idx")))
    return (j.groupBy(F.col("a.tbl").alias("Table1"), F.col("b.tbl").alias("Table2"))
             .agg(F.concat_ws(", ", F.sort_array(F.collect_set(F.col("a.col")))).alias("Common_Columns")))


def primary_key_candidates(df: DataFrame) -> DataFrame:
    """Columns that are unique and null-free."""
    about = _estimates(df)
    # a sketch is off by a few per cent: columns far from unique need no count
    near = [c for c, r in about.items() if r["non_null"] == r["rows"] and r["about"] >= 0.8 * r["rows"]]
    return column_counts(df, near).filter("n_distinct = rows").select("column_name")


def id_column_ratios(df: DataFrame) -> DataFrame:
    """Unique ratio and null ratio of columns named like ID / NO."""
    ids = [c for c in df.columns if "ID" in c.upper() or "NO" in c.upper()]
    if not ids:
        return df.sparkSession.createDataFrame([], "column_name string, unique_ratio double, null_ratio double")
    return column_profile(df.select(*[F.col(f"`{c}`") for c in ids])).select("column_name", F.try_divide("n_distinct", F.col("rows")).alias("unique_ratio"),
                    F.try_divide("null_count", F.col("rows")).alias("null_ratio"))


def referential_integrity(tables: dict[str, DataFrame], key: str, checks: list[tuple[str, str, str]], dense: bool = True) -> DataFrame:
    """Distinct keys of a table found / not found in another one (B19):
    ``checks`` has (base, other, name of the row).  Every table is read once for
    all checks (see ``keysets.key_overlaps``); null is no key."""
    pairs = key_overlaps({n: (df, key) for n, df in tables.items()}, dense=dense)
    flipped = pairs.select(F.col("right").alias("base"), F.col("left").alias("other"), F.col("left_keys").alias("keys"), "in_both")
    both = pairs.select(F.col("left").alias("base"), F.col("right").alias("other"), F.col("right_keys").alias("keys"), "in_both").unionByName(flipped)
    asked = both.sparkSession.createDataFrame(checks, "base string, other string, table string")
    return both.join(F.broadcast(asked), ["base", "other"]).select("table", F.col("in_both").alias("matching"), (F.col("keys") - F.col("in_both")).alias("orphaned"))


def column_classes(df: DataFrame, numeric_min_distinct: int = 20) -> DataFrame:
    """Column classing (B22): numeric (numeric type, at least 20 distinct,
    D12) with skewness and skewed flag; otherwise categorical with high
    (>100), low (<=10) or medium cardinality; "date" in the name flags date."""
    cols = df.columns
    num = set(numeric_columns(df))
    skews = [(skew_bias_corrected(F.col(f"`{c}`").cast("double")) if c in num else F.lit(None).cast("double")).alias(f"{c}__skew") for c in cols]
    skews = _unpivot_rows(df.agg(*skews), cols, ["skew"]).drop("position")
    long = column_counts(df).join(F.broadcast(skews), "column_name")  # one row a column
    is_num = F.col("column_name").isin(list(num)) & (F.col("n_distinct") >= numeric_min_distinct)
    cls = (F.when(is_num, "numeric").when(F.col("n_distinct") > 100, "high_cardinality")
            .when(F.col("n_distinct") <= 10, "low_cardinality").otherwise("categorical"))
    return long.select("column_name", F.col("n_distinct").cast("long").alias("n_distinct"), cls.alias("class"),
                       F.when(is_num, F.col("skew")).alias("skewness"),
                       F.coalesce(is_num & (F.abs(F.col("skew")) > 1), F.lit(False)).alias("is_skewed"),
                       F.lower(F.col("column_name")).contains("date").alias("is_date"))


def numeric_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """n, mean, std, min, max per numeric column (B23), one pass."""
    cols = cols or numeric_columns(df)
    exprs = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        exprs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                  F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    return _unpivot_rows(df.agg(*exprs), cols, ["n", "mean", "std", "min", "max"]).drop("position")


def trimmed_histogram(df: DataFrame, col: str, nbins: int = 30, lo_q: float = 0.005,
                      hi_q: float = 0.995) -> DataFrame:
    """Histogram of the values between the 0.5% and 99.5% quantiles (exact,
    linear interpolation), 30 equal-width bins over the kept range (B24)."""
    x = F.col(col).cast("double")
    v = df.select(x.alias("_v")).filter(F.col("_v").isNotNull())
    from regula.operators.relational import global_quantiles
    q = global_quantiles(v, "_v", [lo_q, hi_q]).select(F.try_element_at(F.col("_q"), F.lit(1)).alias("_qlo"), F.try_element_at(F.col("_q"), F.lit(2)).alias("_qhi"))
    kept = v.crossJoin(F.broadcast(q)).filter((F.col("_v") >= F.col("_qlo")) & (F.col("_v") <= F.col("_qhi")))
    rng = kept.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    b = (kept.select("_v").crossJoin(F.broadcast(rng))
             .withColumn("bin", equal_width_bin("_v", "_lo", "_hi", nbins))
             .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    spine = rng.select(F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"))
    return spine.join(b, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def top_categories(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """Top-k categories with count and % of all rows."""
    from regula.operators.relational import value_counts
    return value_counts(df, col, k=k)


def year_histogram(df: DataFrame, col: str, first_year: int = 1980, last_year: int = 2025) -> DataFrame:
    """Rows per year of a date column within a year range."""
    d = df.schema[col].dataType
    x = F.col(col) if isinstance(d, (T.DateType, T.TimestampType, T.TimestampNTZType)) else parse_timestamp(col)
    y = df.select(F.year(x).alias("year")).filter(F.col("year").between(first_year, last_year))
    return y.groupBy("year").agg(F.count(F.lit(1)).alias("count"))


def lookup_preview(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Whole table if it has fewer than 20 rows, else the first 20 by key."""
    return df.orderBy(key).limit(n)


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """``head(n)`` with an explicit order."""
    return df.orderBy(*order).limit(n)
