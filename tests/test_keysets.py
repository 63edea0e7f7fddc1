"""Shared keys of several tables and pages by key."""

import random

import pytest

from regula.operators import keysets as K
from regula.operators import ml_tables as M


@pytest.mark.parametrize("dense", [True, False])
def test_overlaps_equal_set_operations(spark, dense):
    rnd = random.Random(1)
    keys = {"a": [rnd.randrange(-40000, 90000) for _ in range(3000)], "b": [rnd.randrange(0, 60000) for _ in range(3000)] + [7] * 2000,
            "c": list(range(50)) * 3, "none": []}
    tables = {n: (spark.createDataFrame([(k,) for k in v] + [(None,)], "k long"), "k") for n, v in keys.items()}
    got = {(r["left"], r["right"]): (r["left_keys"], r["right_keys"], r["in_both"]) for r in K.key_overlaps(tables, dense=dense).collect()}
    sets = {n: set(v) for n, v in keys.items()}
    names = list(keys)
    assert got == {(a, b): (len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for i, a in enumerate(names) for b in names[i + 1:]}


def test_overlaps_of_text_keys(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["x", "y", "", None], ["y", "z", ""]))
    assert tuple(K.key_overlaps({"a": (a, "k"), "b": (b, "k")}).first())[2:] == (3, 3, 2)


def test_pages_follow_each_other_through_nulls(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1, 2]), rnd.choice([None, "p", "q"])) for i in range(57)]
    df = spark.createDataFrame(rows, "id long, n int, s string").repartition(5)
    order = [("n", True), ("s", False), ("id", False)]
    want = sorted(rows, key=lambda r: (-(r[1] or 0), r[2] is not None, r[2] or "", r[0]))
    got, last = [], None
    while True:
        page = K.page_after(df, order, 10, last)
        if not (read := [tuple(r) for r in page.collect()]):
            break
        got += read
        last = K.last_key(page, order)
    assert got == want


def test_cluster_profile_lists_members_and_categories(spark):
    rows = [(c, f"m{i}", float(i % 5), "A" if i % 4 else None if c else "B") for c in (0, 1) for i in range(8)]
    df = spark.createDataFrame(rows, "c int, m string, v double, t string")
    got = {r["c"]: r for r in M.cluster_profile(df, "c", ["v"], {"t": 1}, ("m", "v")).collect()}
    assert got[0]["size"] == 8 and got[0]["pct"] == 50 and got[0]["mean_v"] == pytest.approx(13 / 8)
    assert [tuple(x) for x in got[0]["top_members"]] == [("m4", 4.0), ("m3", 3.0), ("m2", 2.0)]
    assert [(x["value"], x["n"]) for x in got[0]["top_t"]] == [("A", 6)] and got[1]["top_t"][0]["pct"] == 100
