"""Model fitting on Spark ML.

Estimators are MLlib's distributed implementations; training frames are
cached once per fit loop and evaluation is done with DataFrame aggregates.
The only driver-side values are fitted models and one-row metric rows.
"""

from __future__ import annotations

import math
import random
from functools import reduce
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regula.operators.forest import Plan, bin_limits, grown, packed
from regula.operators.ml_tables import auc, classification_report, confusion_matrix, hash_cuts, roc_points
from regula.operators.relational import prefix_sums
from regula.session import cut_lineage, written

#: partitions of a training frame, and of a series of months
FIT_PARTITIONS = 16
SERIES_PARTITIONS = 1
#: Spark's limit; the source system grows its trees without one
FOREST_DEPTH = 30


def _parallel(fns, workers: int = 8):
    """Run independent fits concurrently: Spark schedules jobs from several
    driver threads side by side (as CrossValidator's ``parallelism`` does)."""
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(fns)))) as ex:
        return list(ex.map(lambda f: f(), fns))


#: rows of one partition of a training frame beyond ``FIT_PARTITIONS`` partitions,
#: and at least where a classifier has fewer partitions
FIT_ROWS, LEAST_FIT_ROWS = 100_000, 8_192
#: rows to a distinct point at which k-means takes weighted points
LEAST_EQUAL = 10


def fit_partitions(df: DataFrame) -> int:
    """Partitions of a classifier's training frame, by its number of rows."""
    n = df.count()
    return max(1, min(FIT_PARTITIONS, -(-n // LEAST_FIT_ROWS)), -(-n // FIT_ROWS))


def materialise(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cut a training frame's lineage once, its rows dealt by their hash over a
    number of partitions that follows from the number of rows alone: a fitted
    forest depends on how its rows are dealt, so the dealing must not depend on
    the cluster, and a task's share must not grow with the table."""
    if partitions is None:
        partitions = max(FIT_PARTITIONS, -(-df.count() // FIT_ROWS))
    return cut_lineage(df.repartition(partitions, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns if c != "features"])))


def assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(
        df.select(*[F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in df.columns]))


def scaled(df: DataFrame, inp: str = "features", out: str = "scaled"):
    """StandardScaler with centring (M5).  Spark divides by the sample std;
    that is a uniform factor, so cosine and cluster assignments match."""
    model = StandardScaler(inputCol=inp, outputCol=out, withMean=True, withStd=True).fit(df)
    return model.transform(df), model


# ------------------------------------------------------------- M8 / M9 / M10

def _rff(df: DataFrame, inp: str, out: str, dim: int, n_features: int, gamma: float, seed: int) -> DataFrame:
    """Random Fourier features z(x) = sqrt(2/D) cos(Wx + b) for the RBF
    kernel exp(-gamma |x-y|^2) (Rahimi & Recht), a batch of rows at once.
    Products are added feature by feature, so a row's value does not depend on
    its batch."""
    rnd = random.Random(seed)
    sd = math.sqrt(2.0 * gamma)
    w, b = np.empty((n_features, dim)), np.empty(dim)
    for i in range(dim):
        w[:, i] = [rnd.gauss(0.0, sd) for _ in range(n_features)]
        b[i] = rnd.uniform(0.0, 2.0 * math.pi)
    scale = math.sqrt(2.0 / dim)

    @F.pandas_udf("array<double>")
    def waves(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), float).reshape(len(x), n_features)
        dot = np.zeros((len(x), dim))
        for j in range(n_features):
            dot += rows[:, j, None] * w[j]
        return pd.Series(list(np.cos(dot + b) * scale))

    return df.withColumn(out, array_to_vector(waves(vector_to_array(F.col(inp)))))


def _metrics(pred: DataFrame, name: str, label: str, prob_col: str = "p1") -> DataFrame:
    y, p = F.col(label).cast("int"), F.col("prediction").cast("int")
    m = pred.agg(F.avg((y == p).cast("double")).alias("accuracy"),
                 F.count_if((y == 1) & (p == 1)).alias("_tp"), F.count_if((y == 0) & (p == 1)).alias("_fp"),
                 F.count_if((y == 1) & (p == 0)).alias("_fn"))
    m = (m.withColumn("precision", F.coalesce(F.try_divide("_tp", F.col("_tp") + F.col("_fp")), F.lit(0.0)))
          .withColumn("recall", F.coalesce(F.try_divide("_tp", F.col("_tp") + F.col("_fn")), F.lit(0.0))))
    m = m.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                   F.col("precision") + F.col("recall")), F.lit(0.0)))
    a = auc(pred, prob_col, label).select("auc")
    return m.crossJoin(a).select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1", "auc")


def train_classifiers(train: DataFrame, test: DataFrame, features: list[str], label: str = "IsApproved",
                      seed: int = 42, rf_depth: int = FOREST_DEPTH, rff_dim: int = 100, models=None,
                      key_cols=("ApplNo", "SubmissionNo"), score: bool = True):
    """Four classifiers (M8): logistic regression (scaled), random forest
    (100 trees), gradient boosting (100 rounds, depth 3) and an RBF-kernel
    SVM (scaled; random Fourier features + linear SVM + logistic
    calibration of the margin for probabilities).

    Returns (metrics DataFrame, {name: (model, predictions)}).  Every model is
    fitted on all training rows, dealt by their key and values, and all test
    rows are scored, once a model: the predictions are tables of label,
    prediction and p1.  Without ``score`` no row is scored and there are no
    metrics (None)."""
    parts = fit_partitions(train)
    tr = materialise(assembled(train.select(*dict.fromkeys([*key_cols, label, *features])), features), parts)
    te = assembled(test.select(label, *features), features).select(label, "features")
    te = written(te) if score else te
    sc = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(tr)
    tr_s, te_s = sc.transform(tr), sc.transform(te)
    p1 = vector_to_array(F.col("probability"))[1]
    wanted = models or ["Logistic Regression", "Random Forest", "Gradient Boosting", "SVM"]
    jobs = {}
    if "Logistic Regression" in wanted:
        def lr():
            m = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=1000).fit(tr_s)
            return m, m.transform(te_s).withColumn("p1", p1)
        jobs["Logistic Regression"] = lr
    if "Random Forest" in wanted:
        def rf():
            rows = train.select(label, *features, F.lit(0).alias("_part"))
            if score:
                rows = rows.unionByName(test.select(label, *features, F.lit(1).alias("_part")))
            blocks = packed(rows, features, label, "_part", bin_limits(train, features), parts)
            forests, pred = grown(blocks, [Plan(0, t, held=1 if score else None) for t in range(100)], seed, rf_depth)
            if score:
                p = F.col("p")[0]
                pred = pred.select(F.col("y").alias(label), (p > 0.5).cast("double").alias("prediction"), p.alias("p1"))
            return forests[0], pred
        jobs["Random Forest"] = rf
    if "Gradient Boosting" in wanted:
        def gbt():
            m = GBTClassifier(featuresCol="features", labelCol=label, maxIter=100, maxDepth=3, stepSize=0.1,
                              seed=seed).fit(tr)
            return m, m.transform(te).withColumn("p1", p1)
        jobs["Gradient Boosting"] = gbt
    if "SVM" in wanted:
        def svm_job():
            d = len(features)
            # gamma='scale': 1 / (n_features * variance of the scaled inputs)
            var = (tr_s.select(F.explode(vector_to_array("scaled")).alias("_v"))
                       .agg(F.var_pop("_v").alias("v")).first()["v"]) or 1.0
            gamma = 1.0 / (d * var)
            tr_r = _rff(tr_s, "scaled", "rff", rff_dim, d, gamma, seed).cache()
            te_r = _rff(te_s, "scaled", "rff", rff_dim, d, gamma, seed)
            svm = LinearSVC(featuresCol="rff", labelCol=label, maxIter=100,
                            regParam=1.0 / max(tr_r.count(), 1)).fit(tr_r)
            margin = vector_to_array(F.col("rawPrediction"))[1]
            cal_in = VectorAssembler(inputCols=["_margin"], outputCol="_mvec")
            tr_m = cal_in.transform(svm.transform(tr_r).withColumn("_margin", margin))
            cal = LogisticRegression(featuresCol="_mvec", labelCol=label).fit(tr_m.select("_mvec", label))
            te_m = cal_in.transform(svm.transform(te_r).withColumn("_margin", margin))
            pred = cal.transform(te_m.drop("rawPrediction", "probability", "prediction")).withColumn("p1", p1)
            return (svm, cal), pred
        jobs["SVM"] = svm_job
    names = list(jobs)
    out = dict(zip(names, _parallel([jobs[n] for n in names], 4)))
    if score:
        # read by each of the reports and curves
        out = {name: (m, cut_lineage(pred.select(label, "prediction", "p1"))) for name, (m, pred) in out.items()}
    metrics = None
    for name, (_, pred) in out.items() if score else ():
        m = _metrics(pred, name, label)
        metrics = m if metrics is None else metrics.unionByName(m)
    return metrics, out


def _per_model(out: dict, report) -> DataFrame:
    frames = [report(pred).select(F.lit(name).alias("model"), "*") for name, (_, pred) in out.items()]
    return reduce(DataFrame.unionByName, frames)


def reports_per_model(out: dict, label: str = "IsApproved") -> DataFrame:
    """Classification report of every fitted model."""
    return _per_model(out, lambda p: classification_report(p, label, "prediction"))


def matrices_per_model(out: dict, label: str = "IsApproved") -> DataFrame:
    """Confusion matrix of every fitted model."""
    return _per_model(out, lambda p: confusion_matrix(p, label, "prediction"))


def rocs_per_model(out: dict, label: str = "IsApproved") -> DataFrame:
    """ROC points of every fitted model (M6)."""
    return _per_model(out, lambda p: roc_points(p, "p1", label))


def best_model(metrics: DataFrame, by: str = "auc") -> DataFrame:
    """Arg-max over models (K6)."""
    return metrics.agg(F.max_by("model", F.col(by)).alias("best_model"), F.max(by).alias(by))


def feature_importance(model, features: list[str], spark, k: int = 10) -> DataFrame:
    """Importances of a tree ensemble, top k (M9)."""
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda r: (-r[1], r[0]))[:k]
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def stratified_folds(df: DataFrame, key_cols: list[str], label: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold id 0..k-1: every class of ``label`` is cut into k equal shares in
    the order of a seeded hash of the row key."""
    return hash_cuts(df, key_cols, label, [i / k for i in range(1, k)], seed + 1, name)


# ---------------------------------------------------------------- M13 / T4

def time_series_folds(ts: DataFrame, order: str = "month", n_splits: int = 5) -> DataFrame:
    """TimeSeriesSplit (T4): test size n // (splits + 1); fold f tests rows
    [n - (splits - f) * t, n - (splits - f - 1) * t) and trains on all rows
    before.  Adds ``row_idx``, the total ``n_rows`` and ``test_fold``, the fold
    that tests the row (null for rows that are only trained on)."""
    rows = ts.withColumn("_t", F.unix_date(F.col(order).cast("date"))) if dict(ts.dtypes)[order] != "date" else ts
    ranked = prefix_sums(rows.withColumn("_one", F.lit(1)), order, ["_one"]).withColumnRenamed("_one_before", "row_idx")
    n = ranked.crossJoin(F.broadcast(ts.agg(F.count(F.lit(1)).alias("n_rows")))).drop("_one", "_t")
    size = F.expr(f"n_rows div {n_splits + 1}")
    fold = F.expr(f"(row_idx - (n_rows - {n_splits} * (n_rows div {n_splits + 1}))) div greatest(n_rows div {n_splits + 1}, 1)")
    return n.withColumn("test_fold", F.when((size > 0) & (F.col("row_idx") >= F.col("n_rows") - n_splits * size), fold.cast("int")))


def fold_layout(folds: DataFrame) -> DataFrame:
    """Per fold: training rows and the rows it tests, from ``time_series_folds``."""
    return folds.filter(F.col("test_fold").isNotNull()).groupBy(F.col("test_fold").alias("fold")).agg(
        F.min("row_idx").cast("long").alias("train_rows"), F.min("row_idx").cast("long").alias("test_start"),
        (F.max("row_idx") + 1).cast("long").alias("test_end"))


def train_regressors(ts: DataFrame, features: list[str], target: str = "TotalSubmissions", order: str = "month",
                     n_splits: int = 5, seed: int = 42, rf_depth: int = FOREST_DEPTH, validate: bool = True):
    """Linear, ridge (alpha 1), random forest and gradient boosting
    regressors with expanding-window CV MAE and in-sample MAE / RMSE / R2 (M13):
    (comparison, model of least MAE, its name, the assembled rows)."""
    spark = ts.sparkSession
    data = materialise(assembled(time_series_folds(ts, order, n_splits), features), SERIES_PARTITIONS)
    n = data.count()
    makers = {
        "Linear Regression": lambda: LinearRegression(featuresCol="features", labelCol=target),
        # sklearn Ridge minimises |y-Xw|^2 + a|w|^2; Spark scales the penalty by 1/n on unstandardised data
        "Ridge Regression": lambda m: LinearRegression(featuresCol="features", labelCol=target, elasticNetParam=0.0,
                                                       regParam=1.0 / max(m, 1), standardization=False),
        "Random Forest": lambda: RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=100,
                                                       maxDepth=rf_depth, seed=seed),
        "Gradient Boosting": lambda: GBTRegressor(featuresCol="features", labelCol=target, maxIter=100, maxDepth=3,
                                                  stepSize=0.1, seed=seed),
    }
    ev = RegressionEvaluator(labelCol=target, predictionCol="prediction")
    fitted = {}

    def fit_eval(name, f):
        mk = makers[name]
        if f is None:
            est = mk(n) if name == "Ridge Regression" else mk()
            fitted[name] = est.fit(data)
            pred = fitted[name].transform(data)
            return (ev.evaluate(pred, {ev.metricName: "mae"}), ev.evaluate(pred, {ev.metricName: "rmse"}),
                    ev.evaluate(pred, {ev.metricName: "r2"}))
        va = data.filter(F.col("test_fold") == f)
        start = n - (n_splits - f) * (n // (n_splits + 1))
        tr = data.filter(F.col("row_idx") < start)
        est = mk(start) if name == "Ridge Regression" else mk()
        return ev.evaluate(est.fit(tr).transform(va), {ev.metricName: "mae"})

    folds = range(n_splits) if validate else []
    tasks = [(name, f) for name in makers for f in [*folds, None]]
    res = dict(zip(tasks, _parallel([lambda t=t: fit_eval(*t) for t in tasks], 8)))
    rows = []
    for name in makers:
        maes = [res[(name, f)] for f in folds]
        mae, rmse, r2 = res[(name, None)]
        rows.append((name, float(sum(maes) / len(maes)) if maes else None, mae, rmse, r2))
    result = spark.createDataFrame(rows, "model string, cv_mae double, mae double, rmse double, r2 double")
    best = min(rows, key=lambda r: (r[2], r[0]))[0]
    return result, fitted[best], best, data


def residuals(model, data: DataFrame, target: str) -> DataFrame:
    """y - prediction."""
    return model.transform(data).withColumn("residual", F.col(target) - F.col("prediction"))


def _hist_features(h):
    """Lag / rolling features from the last-12 history array (oldest first)."""
    def tail(n):
        return F.slice(h, 13 - n, n)

    def mean(a, n):
        return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / n

    def std(a, n):
        m = mean(a, n)
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)) / (n - 1))
    cols = {f"lag_{k}": h[12 - k] for k in (1, 3, 6, 12)}
    for n in (3, 6, 12):
        cols[f"rolling_mean_{n}"] = mean(tail(n), n)
        cols[f"rolling_std_{n}"] = std(tail(n), n)
    return cols


def recursive_forecast(model, ts_feats: DataFrame, features: list[str], target: str = "TotalSubmissions",
                       order: str = "month", horizon: int = 12, series: str | None = None,
                       update_lags: bool = True) -> DataFrame:
    """Recursive multi-step forecast (T6) for every series at once.

    Each series carries its last 12 values as an array; a step derives the
    lag and rolling features from that array, runs one ``model.transform``
    and shifts the prediction into the array (D10).  Every step is a narrow
    projection over one row per series, so there is no per-step shuffle.
    With ``update_lags=False`` only time_index and the calendar fields
    advance, as in the reference."""
    keys = [series] if series else []
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    ranked = ts_feats.withColumn("_k", F.row_number().over(w))
    hist = (ranked.filter(F.col("_k") <= 12).groupBy(*keys)
                  .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                         F.col(target).cast("double").alias("y")))),
                                   lambda s: s["y"]).alias("_h")))
    last = ranked.filter(F.col("_k") == 1).drop("_k")
    cur = last.join(hist, keys, "inner") if keys else last.crossJoin(hist)
    cur = cur.withColumn("_fc", F.array().cast("array<struct<step:int,month:date,forecast:double>>"))
    # the start state is one row per series: cut the lineage to the source
    # aggregation once, so the 12 chained steps stay a shallow plan
    cur = cut_lineage(cur)
    for step in range(1, horizon + 1):
        nm = F.add_months(F.col(order), 1)
        new = {order: nm, "time_index": F.col("time_index") + 1, "month_of_year": F.month(nm),
               "quarter": F.quarter(nm), "year": F.year(nm), "days_in_month": F.dayofmonth(F.last_day(nm))}
        if update_lags:
            new.update(_hist_features(F.col("_h")))
        cur = cur.select(*[new[c].alias(c) if c in new else F.col(c) for c in cur.columns if c not in ("features", "prediction")])
        pred = model.transform(assembled(cur, features))
        entry = F.struct(F.lit(step).alias("step"), F.col(order).cast("date").alias("month"),
                         F.col("prediction").alias("forecast"))
        cur = pred.select(*[c for c in cur.columns if c not in ("_h", "_fc")],
                          F.concat(F.slice(F.col("_h"), 2, 11), F.array(F.col("prediction"))).alias("_h"),
                          F.concat(F.col("_fc"), F.array(entry)).alias("_fc"))
    return cur.select(*keys, F.explode("_fc").alias("_f")).select(*keys, "_f.step", "_f.month", "_f.forecast")


# ------------------------------------------------------------------- M14

def approval_time_regression(table: DataFrame, features: list[str], target: str = "DaysToApproval",
                             key_cols=("ApplNo",), seed: int = 42, rf_depth: int = FOREST_DEPTH):
    """Random-forest regression of approval days (M14): 80/20 split, fitted on
    the whole training part, MAE, RMSE, R2 and the importances."""
    from regula.operators.ml_tables import split_flag
    d = materialise(split_flag(assembled(cut_lineage(table), features), list(key_cols), 0.2, seed))
    tr, te = d.filter(~F.col("is_test")), d.filter(F.col("is_test"))
    m = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=100, maxDepth=rf_depth,
                              seed=seed).fit(tr)
    pred = cut_lineage(m.transform(te).select(target, "prediction"))  # read once a metric
    ev = RegressionEvaluator(labelCol=target, predictionCol="prediction")
    spark = table.sparkSession
    met = spark.createDataFrame([(ev.evaluate(pred, {ev.metricName: "mae"}), ev.evaluate(pred, {ev.metricName: "rmse"}),
                                  ev.evaluate(pred, {ev.metricName: "r2"}))], "mae double, rmse double, r2 double")
    return met, feature_importance(m, features, spark, k=len(features))


# ------------------------------------------------------- M16 / M17 / M18 / M22

def kmeans_select(df: DataFrame, features: list[str], ks=range(2, 8), n_init: int = 10, seed: int = 42):
    """K-means for each k with ``n_init`` seeds (lowest cost kept), silhouette
    per k (squared Euclidean, linear time), best k by silhouette, refit (M16/M17).

    Beyond ``FIT_PARTITIONS`` full partitions, rows of equal features are fitted
    and judged as one point that weighs as many, unless few are equal: the same
    cost and silhouette, from other starting centres."""
    df = cut_lineage(df)
    data, scaler = scaled(assembled(df, features))
    points, weight = None, {}
    if (rows_ := df.count()) > FIT_PARTITIONS * FIT_ROWS:
        equal = cut_lineage(df.groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias("_weight")))
        if (n := equal.count()) * LEAST_EQUAL <= rows_:
            points = materialise(scaler.transform(assembled(equal, features)).select("scaled", "_weight", *features), max(FIT_PARTITIONS, -(-n // FIT_ROWS)))
            weight = {"weightCol": "_weight"}
    # materialise once: concurrent fits must not each recompute the lineage
    data = data.select("scaled", *[c for c in df.columns])
    data = materialise(data) if points is None else data
    points = data if points is None else points
    ev = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster", distanceMeasure="squaredEuclidean", **weight)
    rows, best = [], None
    for k in ks:
        fits = _parallel([lambda i=i: KMeans(featuresCol="scaled", predictionCol="cluster", k=k, seed=seed + i,
                                             maxIter=300, **weight).fit(points) for i in range(n_init)])
        m = min(fits, key=lambda f: f.summary.trainingCost)
        sil = ev.evaluate(m.transform(points))
        rows.append((k, float(m.summary.trainingCost), float(sil)))
        if best is None or sil > best[1]:
            best = (k, sil, m)
    spark = df.sparkSession
    res = spark.createDataFrame(rows, "k int, inertia double, silhouette double")
    labelled = best[2].transform(data).drop("scaled")
    return res, labelled


def clustering_report(labelled: DataFrame, cluster: str, vector: str, means: list[str]) -> DataFrame:
    """Per cluster: size, pct and feature means; on every row the silhouette
    (squared Euclidean, linear time) and Davies-Bouldin index of the clustering
    over the arrays ``vector``.  Rows without a cluster are left out; a single
    cluster has no silhouette (null)."""
    from regula.operators.ml_tables import cluster_means, cluster_sizes, davies_bouldin
    rows = cut_lineage(labelled.where(F.col(cluster).isNotNull()))
    sizes = cluster_sizes(rows, cluster)
    ev = ClusteringEvaluator(featuresCol="_v", predictionCol=cluster, distanceMeasure="squaredEuclidean")
    many = rows.select(cluster).distinct().limit(2).count() > 1
    silhouette = float(ev.evaluate(rows.select(cluster, array_to_vector(F.col(vector)).alias("_v")))) if many else None
    index = davies_bouldin(rows, vector, cluster).select("davies_bouldin")
    return (sizes.join(cluster_means(rows, cluster, means), cluster).withColumn("silhouette", F.lit(silhouette).cast("double"))
            .crossJoin(F.broadcast(index)))


def bisecting_clusters(df: DataFrame, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Top-down hierarchical clustering into k clusters."""
    data, _ = scaled(assembled(cut_lineage(df), features))  # read by every level
    m = BisectingKMeans(featuresCol="scaled", predictionCol="cluster", k=k, seed=seed).fit(data)
    return m.transform(data).drop("features", "scaled")


def pca_summary(df: DataFrame, features: list[str], k: int = 2, top: int = 10):
    """PCA on standardised features (M22): explained variance per component
    and the largest |loadings| of PC1."""
    data, _ = scaled(assembled(cut_lineage(df), features))  # read by the scaler and by the fit
    m = PCA(k=k, inputCol="scaled", outputCol="pca").fit(data)
    spark = df.sparkSession
    ev = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(m.explainedVariance.toArray())],
                               "component int, explained_variance double")
    pc1 = m.pc.toArray()[:, 0].tolist()
    load = sorted(zip(features, pc1), key=lambda r: (-abs(r[1]), r[0]))[:top]
    ld = spark.createDataFrame([(f, float(v)) for f, v in load], "feature string, loading double")
    return ev, ld, m.transform(data).withColumn("pc", vector_to_array("pca")).drop("features", "scaled", "pca")


def vectors_from_array(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))


def fit_pipeline(df: DataFrame, stages) -> object:
    return Pipeline(stages=stages).fit(df)
