"""Model fits see the rows that they should."""

from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from regula.operators import models


def _rows_fitted(monkeypatch, kind):
    seen, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, df: (seen.append(df.count()), fit(self, df))[1])
    return seen


def _table(spark):
    return spark.range(0, 6000, 1, 4).select(F.col("id").alias("ApplNo"), (F.col("id") % 7).alias("x"), (F.col("id") % 3).alias("z"),
                                             (F.col("id") % 2).alias("IsApproved"), (F.col("id") % 7 * 10).alias("DaysToApproval"))


def test_approval_time_forest_is_fitted_on_the_whole_training_part(spark, monkeypatch):
    seen = _rows_fitted(monkeypatch, RandomForestRegressor)
    metrics, _ = models.approval_time_regression(_table(spark), ["x", "z"])
    assert len(seen) == 1 and abs(seen[0] - 4800) < 300
    assert metrics.first()["r2"] > 0.8


def test_scaler_covers_all_training_rows(spark, monkeypatch):
    seen = _rows_fitted(monkeypatch, StandardScaler)
    d = _table(spark)
    models.train_classifiers(d.where("ApplNo < 5000"), d.where("ApplNo >= 5000"), ["x", "z"], key_cols=("ApplNo",),
                             models=["Logistic Regression"])
    assert seen == [5000]
