"""Unit tests of the pandas-parity rules (N-series) and column helpers."""

import math

import pytest
from pyspark.sql import functions as F

from regula.functions import columns as C
from regula.functions.distributions import chi2_sf, norm_sf, t_two_sided_p


def test_null_tokens(spark):
    df = spark.createDataFrame([("N/A",), ("NA",), ("None (Tentative Approval)",), (" -  - ",), ("",), ("x",)], "v string")
    out = [r[0] for r in df.select(C.null_tokens_to_null("v")).collect()]
    assert out == [None, None, "None (Tentative Approval)", " -  - ", None, "x"]


def test_rate_counts_null_as_miss(spark):
    df = spark.createDataFrame([("AP",), (None,), ("TA",), ("AP",)], "s string")
    assert df.agg(C.rate_of("s", "AP")).first()[0] == 0.5


def test_first_number(spark):
    df = spark.createDataFrame([("10MG",), ("2.5%",), ("none",), (None,), ("Brand#17",)], "s string")
    assert [r[0] for r in df.select(C.first_number("s")).collect()] == [10.0, 2.5, None, None, 17.0]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (2.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(C.clip_upper("x", 1.0)).collect()] == [None, 1.0, 0.5]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,)], "x double")
    assert [r[0] for r in df.select(C.round_half_even("x", 1)).collect()] == [0.2, 0.4, 2.5]


def test_bias_corrected_skew(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "x double")
    assert df.agg(C.skew_bias_corrected("x")).first()[0] == pytest.approx(1.6523167403329895)


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,), (3.5,)], "x double")
    out = df.select(C.right_closed_bin("x", F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)))).collect()
    assert [r[0] for r in out] == [0, 0, 1, 1, 2, None]


def test_equal_width_bins_last_closed(spark):
    df = spark.createDataFrame([(0.0,), (4.99,), (5.0,), (10.0,)], "x double")
    out = df.select(C.equal_width_bin("x", F.lit(0.0), F.lit(10.0), 2)).collect()
    assert [r[0] for r in out] == [0, 0, 1, 1]


def test_truncate_label(spark):
    df = spark.createDataFrame([("a" * 25,), ("short",)], "s string")
    assert [r[0] for r in df.select(C.truncate_label("s", 20)).collect()] == ["a" * 20 + "...", "short"]


def test_distribution_tails():
    assert norm_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-9)
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(10.0, 4) == pytest.approx(0.040427681994512805, abs=1e-9)
    assert t_two_sided_p(2.0, 10) == pytest.approx(0.07338803477074045, abs=1e-9)
    assert math.isnan(t_two_sided_p(float("nan"), 3))
