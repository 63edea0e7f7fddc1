"""Golden lookup tables: raw TSV -> null rules -> the reference's cleaned CSV."""

import csv
import os

import pytest

from conftest import FIXTURES
from regula.operators.clean import clean_table
from regula.sources.catalog import Catalog
from regula.sources.delimited import read_delimited

PAIRS = [
    ("ActionTypes_Lookup.txt", "action_types_lookup", "action_types_lookup_no_nulls.csv"),
    ("SubmissionClass_Lookup.txt", "submission_class_lookup", "submission_class_lookup_no_nulls.csv"),
    ("MarketingStatus_Lookup.txt", "marketing_status_lookup", "marketing_status_lookup_no_nulls.csv"),
    ("ApplicationsDocsType_Lookup.txt", "application_docs_type_lookup", "application_docs_type_lookup_no_nulls.csv"),
]


@pytest.mark.parametrize("raw,table,expected", PAIRS)
def test_golden_lookup(spark, raw, table, expected):
    df = clean_table(read_delimited(spark, os.path.join(FIXTURES, "raw", raw)), table)
    got = sorted(tuple("" if v is None else v for v in r) for r in df.collect())
    with open(os.path.join(FIXTURES, "expected", expected), newline="", encoding="utf-8") as f:
        rows = list(csv.reader(f))
    assert df.columns == rows[0]
    want = sorted(tuple(r) for r in rows[1:])
    assert got == want


def test_malformed_rows_and_latin1(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_bytes("a\tb\tc\n001\tx\ty\n002\tlong\trow\textra\n003\tshort\n004\tcaf\xe9\tz\n".encode("latin-1"))
    from regula.sources.delimited import read_delimited_with_fallback
    df = read_delimited_with_fallback(spark, str(p))
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("001", "x", "y"), ("003", "short", None), ("004", "café", "z")]


def _quoted_file(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, delimiter="\t", lineterminator="\n").writerows(rows)


def test_quoted_fields_over_several_lines_and_tasks(spark, tmp_path):
    """Tabs, quotes and line breaks in fields, one field longer than a split."""
    rows = [[f"{i:04d}", "plain" if i % 3 else f'two\nlines "q" {i}\n\n\tend', "x" * (i % 50)] for i in range(400)]
    rows[200][1] = "\n".join(f'part {j} "" \t' for j in range(600))
    rows[201][2] = '5" pipe'  # a quote inside an unquoted field is a quote
    path = tmp_path / "t.txt"
    _quoted_file(path, [["id", "note", "pad"], *rows[:201]])
    with open(path, "a", newline="", encoding="utf-8") as f:
        f.write("\t".join(rows[201]) + "\n" if rows[201][1] == "plain" else '0201\tplain\t5" pipe\n')
        csv.writer(f, delimiter="\t", lineterminator="\n").writerows(rows[202:])
    rows[201][1] = "plain"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = read_delimited(spark, str(path), null_tokens=False)
        got = sorted(tuple(r) for r in df.collect())
        scanned = spark.read.text(str(path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert scanned > 8
    assert got == sorted((a, b, c or None) for a, b, c in rows)


def test_quotes_that_settle_and_swap_states():
    from regula.sources.records import advance
    tab = b"\t"
    assert advance(b'a\t"b', False, tab) == (True, 1) and advance(b'b"\tc', True, tab) == (False, 1)
    assert advance(b'a"b\tc', False, tab) == (False, 1) and advance(b'x""y', True, tab) == (True, 0)
    assert advance(b'"a""b\tc"\td', False, tab) == (False, 1) and advance(b"", True, tab) == (True, 0)


def test_encoding_is_chosen_per_file(spark, tmp_path):
    from regula.sources.delimited import read_delimited_with_fallback
    (tmp_path / "a.txt").write_bytes("k\tv\n1\tcafé\n".encode())
    (tmp_path / "b.txt").write_bytes("k\tv\n2\tcafé\n3\tx\n".encode("latin-1"))
    got = sorted(tuple(r) for r in read_delimited_with_fallback(spark, str(tmp_path)).collect())
    assert got == [("1", "café"), ("2", "café"), ("3", "x")]


def test_folder_without_files(spark, tmp_path):
    from regula.sources.delimited import read_delimited_with_fallback
    (tmp_path / "none").mkdir()
    assert read_delimited_with_fallback(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.txt").write_bytes(b"")
    assert read_delimited_with_fallback(spark, str(tmp_path / "e")).count() == 0


def test_cleaned_table_and_its_report_come_from_one_write(spark, tmp_path):
    from pyspark.sql import functions as F
    from regula.sources.delimited import write_cleaned
    raw = spark.createDataFrame([(1, None, "x"), (2, "b", None), (None, "c", None)], "id long, a string, b string")
    report = write_cleaned(raw, lambda t: t.where("id is not null").fillna({"b": "UNK"}).withColumn("flag", F.col("a").isNull()), str(tmp_path / "out_no_nulls"))
    got = {r["column_name"]: tuple(r)[1:] for r in report.collect()}
    assert got == {"id": (1, 0, 3, 2), "a": (1, 1, 3, 2), "b": (2, 0, 3, 2), "flag": (None, 0, 3, 2)}
    back = Catalog(spark).load_cleaned(str(tmp_path)).get("out")
    assert sorted(tuple(r) for r in back.collect()) == [(1, None, "x", True), (2, "b", "UNK", False)]


def test_csv_sink_and_named_cleaned_tables(spark, tmp_path):
    from regula.sources.delimited import write_table
    df = spark.createDataFrame([("01", "a,b"), ("02", 'q"q')], "k string, v string")
    write_table(df, str(tmp_path / "one_no_nulls.csv"), "csv")
    write_table(df, str(tmp_path / "two_no_nulls.csv"), "csv")
    cat = Catalog(spark).load_cleaned(str(tmp_path), fmt="csv", names=["one", "absent"])
    assert list(cat.tables) == ["one"]
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xml")


def test_sample_tables_grow_with_rows(spark):
    from regula.sources.sample import sample_tables
    small, large = sample_tables(spark, 100), sample_tables(spark, 400)
    assert set(small) == set(large) and all(large[t].count() >= small[t].count() > 0 for t in small)


def test_catalog_missing_tables(spark, tmp_path):
    cat = Catalog(spark).load(os.path.join(FIXTURES, "raw"))
    assert cat.get("marketing_status_lookup") is not None
    assert cat.get("applications") is None
    miss = {r["table"] for r in cat.missing().collect()}
    assert "applications" in miss and "submission_class_lookup" not in miss
