"""Relational and statistical operators against brute force on small frames."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from regula.operators import relational as R
from regula.operators import stats as Z


def test_value_counts_drops_null_keeps_denominator(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    rows = {r["k"]: (r["count"], r["pct"]) for r in R.value_counts(df, "k").collect()}
    assert rows == {"a": (2, 50.0), "b": (1, 25.0)}


def test_last_non_null_undated_sorts_last(spark):
    df = spark.createDataFrame([
        (1, "2020-01-01", 1, "AP"), (1, None, 2, "TA"), (1, "2021-01-01", 3, "WD"),
        (2, "2020-01-01", 1, "AP"), (2, "2022-01-01", 2, None)], "k int, d string, n int, s string")
    df = df.withColumn("d", F.to_date("d"))
    out = {r["k"]: r["s"] for r in R.last_non_null_by(df, "k", "d", ["s"], tie=["n"]).collect()}
    assert out == {1: "TA", 2: "AP"}


def test_gini_properties(spark):
    eq = spark.createDataFrame([(5,)] * 10, "v long")
    assert Z.gini(eq, "v").first()["gini"] == pytest.approx(0.0, abs=1e-12)
    one = spark.createDataFrame([(0,)] * 9 + [(100,)], "v long")
    assert Z.gini(one, "v").first()["gini"] == pytest.approx(0.9)
    vals = [1, 2, 2, 3, 7, 7, 7, 20]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    s = sorted(vals)
    cum = list(itertools.accumulate(s))
    brute = (len(s) + 1 - 2 * sum(c / cum[-1] for c in cum)) / len(s)
    assert Z.gini(df, "v").first()["gini"] == pytest.approx(brute)


def test_top_share(spark):
    vals = list(range(1, 21))
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    r = Z.top_share(df, "v", 0.1).first()
    assert r["k"] == 2 and r["top_share_pct"] == pytest.approx((20 + 19) / sum(vals) * 100)


def _mw_brute(x, y):
    allv = sorted(x + y)
    def avg_rank(v):
        idx = [i + 1 for i, a in enumerate(allv) if a == v]
        return sum(idx) / len(idx)
    r1 = sum(avg_rank(v) for v in x)
    n1, n2 = len(x), len(y)
    u1 = r1 - n1 * (n1 + 1) / 2
    from collections import Counter
    t = Counter(allv).values()
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - sum(c ** 3 - c for c in t) / (n * (n - 1))))
    z = (n1 * n2 - u1 - n1 * n2 / 2 - 0.5) / sigma
    return u1, z


def test_mann_whitney_matches_brute_force(spark):
    x = [3, 5, 5, 8, 10, 12]
    y = [1, 2, 5, 5, 6, 7, 9]
    df = spark.createDataFrame([(v, "a") for v in x] + [(v, "b") for v in y], "v long, g string")
    r = Z.mann_whitney_u(df, "v", "g", "a", "b").first()
    u1, z = _mw_brute(x, y)
    assert r["u_statistic"] == pytest.approx(u1) and r["z"] == pytest.approx(z)


def test_chi_square_yates_2x2(spark):
    obs = spark.createDataFrame([("P", True, 10), ("P", False, 20), ("S", True, 30), ("S", False, 15)],
                                "row string, col boolean, observed long")
    r = Z.chi_square_independence(obs).first()
    o = [[10, 20], [30, 15]]
    n = 75
    rt, ct = [30, 45], [40, 35]
    chi = sum((max(abs(o[i][j] - rt[i] * ct[j] / n) - 0.5, 0)) ** 2 / (rt[i] * ct[j] / n)
              for i in range(2) for j in range(2))
    assert r["chi2"] == pytest.approx(chi) and r["dof"] == 1
    p = Z.with_chi_square_p(Z.chi_square_independence(obs)).first()["p_value"]
    assert 0 < p < 0.01


def test_histogram_counts_sum(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    h = R.histogram(df, "x", 7).collect()
    assert len(h) == 7 and sum(r["count"] for r in h) == 101


def test_prefix_sums_matches_running_sum(spark):
    vals = [(float(i), i % 7) for i in range(500)]
    df = spark.createDataFrame(vals, "k double, v long")
    got = {r["k"]: r["v_before"] for r in R.prefix_sums(df, "k", ["v"]).collect()}
    run = 0
    for k, v in vals:
        assert got[k] == run
        run += v
    desc = {r["k"]: r["v_before"] for r in R.prefix_sums(df, "k", ["v"], descending=True).collect()}
    run = 0
    for k, v in reversed(vals):
        assert desc[k] == run
        run += v


def test_global_quantiles_match_percentile(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    vals = list(rng.integers(0, 50, size=600).astype(float)) + list(rng.normal(size=300))
    df = spark.createDataFrame([(float(x),) for x in vals], "x double")
    probs = [0.0, 0.005, 0.33, 0.5, 0.67, 0.95, 1.0]
    got = R.global_quantiles(df, "x", probs).first()[0]
    want = df.agg(F.percentile("x", probs)).first()[0]
    assert got == pytest.approx(want, abs=1e-12)


def test_prefix_sums_on_many_keys_without_exchange_reuse(spark):
    """200 000 keys, a carried column that the caller reads, skewed values."""
    df = spark.range(200_000).select(F.pow(F.col("id").cast("double"), 3).alias("k"), (F.col("id") % 7).alias("v"), F.col("id").alias("carried"))
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        want = F.expr("21 * (carried div 7) + (carried % 7) * (carried % 7 - 1) div 2")
        bad = R.prefix_sums(df.orderBy(F.rand(3)), "k", ["v"]).filter(F.col("v_before") != want)
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


def test_prefix_sums_orders_strings_and_dates(spark):
    df = spark.createDataFrame([("b",), ("",), ("abcdefgh",), ("abcdefga",), ("é",), ("z" * 9,)], "k string").withColumn("one", F.lit(1))
    got = {r["k"]: r["one_before"] for r in R.prefix_sums(df, "k", ["one"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got)
    days = spark.range(40).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") * 9).alias("k"), F.lit(1).alias("one"))
    assert R.prefix_sums(days, "k", ["one"]).filter("one_before <> datediff(k, date'2020-01-01') div 9").count() == 0


def test_grouped_quantiles_match_percentile(spark):
    import numpy as np
    rng = np.random.default_rng(6)
    rows = [("a", float(x)) for x in rng.normal(size=400)] + [("b", 1e12), ("b", -3.0), ("b", 5.0), (None, 2.0), ("c", None)]
    rows += [("d", float(x)) for x in rng.integers(0, 4, 300)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r["g"]: r["_q"] for r in R.grouped_quantiles(df, ["g"], "x", probs).collect()}
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("x", probs).alias("p")).collect() if r["p"] is not None}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12)


@pytest.mark.parametrize("exact", [1 << 20, 50])
def test_quantiles_are_exact_however_poor_the_sketch(spark, monkeypatch, exact):
    """A sketch of 8 values proposes useless cuts, and crowded cells are cut
    again; hot values and hot groups hold a third of all rows."""
    monkeypatch.setattr(R, "KLL", 8)
    monkeypatch.setattr(R, "EXACT", exact)
    x = F.when(F.col("id") % 3 == 0, 7.5).otherwise(F.pow(F.rand(4) * 100 - 30, 3))
    df = spark.range(4000).select(x.alias("x"), F.when(F.col("id") % 5 < 3, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 9)).alias("g")).cache()
    probs = [0.0, 0.1, 0.5, 0.9, 0.999]
    assert R.global_quantiles(df, "x", probs).first()[0] == pytest.approx(df.agg(F.percentile("x", probs)).first()[0], rel=1e-12)
    got = {r["g"]: r["_q"] for r in R.grouped_quantiles(df, ["g"], "x", probs).collect()}
    for r in df.groupBy("g").agg(F.percentile("x", probs).alias("p")).collect():
        assert got[r["g"]] == pytest.approx(r["p"], rel=1e-12)


def test_auc_on_many_scores(spark):
    from regula.operators import ml_tables as M
    df = spark.range(60_000).select(F.rand(1).alias("s"), F.rand(2).alias("u")).withColumn("y", (F.col("u") < F.col("s")).cast("int"))
    df = df.select("s", "y").cache()
    rows = sorted((r["s"], r["y"]) for r in df.collect())
    pos = sum(y for _, y in rows)
    rank = sum(i + 1 for i, (_, y) in enumerate(rows) if y)
    want = (rank - pos * (pos + 1) / 2) / (pos * (len(rows) - pos))
    assert M.auc(df, "s", "y").first()["auc"] == pytest.approx(want, abs=1e-12)


def test_degenerate_inputs(spark):
    from regula.operators import ml_tables as M
    from regula.operators import stats as S
    line = spark.range(5).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    r = S.with_trend_test(S.pearson_trend(line, "x", "y")).first()
    assert r["p_value"] == 0.0 and r["trend"] == "increasing"
    zeros = spark.range(4).select(F.lit(0).alias("v"))
    assert S.gini(zeros, "v").first()["gini"] is None and S.top_share(zeros, "v").first()["top_share_pct"] is None
    one = spark.createDataFrame([(1.0, "a")], "v double, g string")
    assert S.mann_whitney_u(one, "v", "g", "a", "b").first()["z"] is None
    assert M.auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first()["auc"] is None
    assert R.global_quantiles(line.limit(0), "x", [0.5]).first()["_q"] is None
    assert S.gini(zeros.limit(0), "v").first()["gini"] is None


def test_chi_square_counts_empty_cells(spark):
    from regula.operators import stats as S
    for cells, want in (([("a", "x", 8), ("a", "y", 2), ("b", "x", 1), ("b", "y", 9)], 7.2727272727), ([("a", "x", 5), ("b", "y", 5)], 6.4),
                        ([("a", "x", 5), ("b", "y", 5), ("c", "y", 2)], 12.0)):
        got = S.chi_square_independence(spark.createDataFrame(cells, "row string, col string, observed long")).first()
        assert got["chi2"] == pytest.approx(want, rel=1e-9)


def test_stratified_cuts_keep_class_shares(spark):
    from regula.operators import ml_tables as M
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {r["y"]: (r["n"], r["t"]) for r in M.split_flag(df, ["id"], 0.2, stratify="y").groupBy("y").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert got == {0: (900, 180), 1: (100, 20)}
