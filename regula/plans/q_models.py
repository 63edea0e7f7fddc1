"""Registered model-based queries.

Fitted models are not SQL-expressible, so most of these carry no oracle;
they are checked by property tests in tests/.  M23 (similarity) and T4
(fold layout) are exact and have SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from regula.operators import ml_tables as M
from regula.operators import models as ML
from regula.operators import timeseries as T
from regula.operators.anomaly import isolation_forest
from regula.operators.forest_grid import forest_grid_search
from regula.operators.prescriptive import anomaly_features
from regula.operators.similarity import profile_entries, similar_items, similar_items_lsh
from regula.operators.ward import ward_clusters
from regula.plans.q_ml_tables import RECENT_YEAR, TYPES, _training_table, labelled_drugs
from regula.plans.q_timeseries import _monthly
from regula.plans.registry import register
from regula.plans.roles import roles, with_roles
from regula.session import cut_lineage, dealt, written
from regula.sources.parquet import read_table

# Features of the monthly models.
TS_FEATURES = ["lag_1", "lag_3", "lag_6", "lag_12", "rolling_mean_3", "rolling_std_3", "rolling_mean_6",
               "rolling_std_6", "rolling_mean_12", "rolling_std_12", "year", "month_of_year", "quarter",
               "days_in_month", "time_index"]


def _split_features(spark, d):
    """Train/test split first, then sponsor statistics from the training
    rows only (D9), applied to both sides."""
    t = written(M.split_flag(written(_training_table(spark, d)), ["ApplNo", "SubmissionNo", "SubmissionStatusDate"], 0.2, 42,
                             stratify="IsApproved"))
    train_raw = t.filter(~F.col("is_test"))
    feats = M.approval_features(t, recent_year=RECENT_YEAR, sponsor_stats_from=train_raw)
    # what the models read: four passes and more
    feats = cut_lineage(feats.select("ApplNo", "SubmissionNo", "IsApproved", "is_test", *M.FEATURES))
    return feats.filter(~F.col("is_test")), feats.filter(F.col("is_test"))


def _classifiers(spark, d, models=None, score=True):
    tr, te = _split_features(spark, d)
    return ML.train_classifiers(tr, te, M.FEATURES, "IsApproved", models=models, score=score)


@register("M8_classifier_comparison")
def m8_compare(spark, d):
    return _classifiers(spark, d)[0]


@register("K6_best_classifier_by_auc")
def k6_best(spark, d):
    """Arg-max over the model comparison table (K6)."""
    return ML.best_model(_classifiers(spark, d)[0], "auc")


@register("M9_rf_feature_importance_top10")
def m9_importance(spark, d):
    _, out = _classifiers(spark, d, ["Random Forest"], score=False)
    return ML.feature_importance(out["Random Forest"][0], M.FEATURES, spark, 10)


@register("M9_gbt_feature_importance_top10")
def m9_boosting(spark, d):
    _, out = _classifiers(spark, d, ["Gradient Boosting"], score=False)
    return ML.feature_importance(out["Gradient Boosting"][0], M.FEATURES, spark, 10)


@register("M6_roc_per_model")
def m6_rocs(spark, d):
    return ML.rocs_per_model(_classifiers(spark, d)[1])


@register("M10_M11_reports_per_model")
def m10_m11_reports(spark, d):
    """Classification report of every model, each class with its row of the confusion matrix."""
    _, out = _classifiers(spark, d)
    matrix = ML.matrices_per_model(out).withColumn("class", F.col("label").cast("string")).drop("label")
    return ML.reports_per_model(out).join(matrix, ["model", "class"], "left")


_RULE_SQL = with_roles("submissions") + """
, p AS (SELECT CAST(coalesce(SubmissionStatus = 'AP', false) AS INTEGER) AS y,
               CAST(coalesce(ReviewPriority = 'PRIORITY', false) AS INTEGER) AS yhat FROM submissions)
"""


def _rule(spark, d):
    """A rule-based prediction: priority reviews are approved."""
    (subs,) = roles(spark, d, "submissions")
    return subs.select(F.coalesce(F.col("SubmissionStatus") == "AP", F.lit(False)).cast("int").alias("y"),
                       F.coalesce(F.col("ReviewPriority") == "PRIORITY", F.lit(False)).cast("int").alias("yhat"))


@register("M11_confusion_matrix_rule", sql=_RULE_SQL + """
SELECT y AS label, count(CASE WHEN yhat = 0 THEN 1 END) AS pred_0, count(CASE WHEN yhat = 1 THEN 1 END) AS pred_1
FROM p GROUP BY y""")
def m11_rule(spark, d):
    return M.confusion_matrix(_rule(spark, d), "y", "yhat")


@register("M10_classification_report_rule", sql=_RULE_SQL + """
, k AS (SELECT 0 AS c UNION ALL SELECT 1)
, r AS (SELECT c, count(CASE WHEN y = c AND yhat = c THEN 1 END) AS tp, count(CASE WHEN y = c THEN 1 END) AS s,
               count(CASE WHEN yhat = c THEN 1 END) AS n FROM p, k GROUP BY c)
, m AS (SELECT c, CASE WHEN n > 0 THEN tp / n ELSE 0.0 END AS precision, CASE WHEN s > 0 THEN tp / s ELSE 0.0 END AS recall, s FROM r
        WHERE s > 0 OR n > 0)
, f AS (SELECT c, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, s FROM m)
SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, CAST(s AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(s) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * s) / sum(s), sum(recall * s) / sum(s), sum(f1 * s) / sum(s), CAST(sum(s) AS BIGINT) FROM f""")
def m10_rule(spark, d):
    return M.classification_report(_rule(spark, d), "y", "yhat")


@register("M12_rf_grid_search")
def m12_grid(spark, d):
    """24 grid points by nested evaluation: 10 fits and the refit."""
    tr, te = _split_features(spark, d)
    return forest_grid_search(tr, te, M.FEATURES, "IsApproved")


def _ts_feats(spark, d):
    return T.series_features(_monthly(spark, d))


@register("T4_time_series_cv_folds", sql=with_roles("submissions") + __import__(
    "regula.plans.q_timeseries", fromlist=["_MONTHLY_SQL"])._MONTHLY_SQL + """
, n AS (SELECT count(*) - 12 AS n FROM m)
SELECT CAST(f AS INTEGER) AS fold, CAST(n - (5 - f) * (n // 6) AS BIGINT) AS train_rows,
       CAST(n - (5 - f) * (n // 6) AS BIGINT) AS test_start, CAST(n - (5 - f) * (n // 6) + n // 6 AS BIGINT) AS test_end
FROM n, range(0, 5) r(f)
""")
def t4_folds(spark, d):
    return ML.fold_layout(ML.time_series_folds(_ts_feats(spark, d)))


@register("M13_time_series_regressors")
def m13_regressors(spark, d):
    return ML.train_regressors(_ts_feats(spark, d), TS_FEATURES, "TotalSubmissions", "month")[0]


def _best_ts_model(spark, d):
    """The regressor of least MAE of the four, the features and the assembled rows."""
    feats = _ts_feats(spark, d)
    _, model, _, data = ML.train_regressors(feats, TS_FEATURES, "TotalSubmissions", "month", validate=False)
    return model, feats, data


@register("T6_recursive_forecast_12m")
def t6_forecast(spark, d):
    model, feats, _ = _best_ts_model(spark, d)
    return ML.recursive_forecast(model, feats, TS_FEATURES, "TotalSubmissions", "month", 12)


@register("T6_recursive_forecast_frozen_lags")
def t6_frozen(spark, d):
    """The source system's variant: only time_index and calendar fields advance."""
    model, feats, _ = _best_ts_model(spark, d)
    return ML.recursive_forecast(model, feats, TS_FEATURES, "TotalSubmissions", "month", 12, update_lags=False)


@register("T7_model_residuals")
def t7_residuals(spark, d):
    model, _, data = _best_ts_model(spark, d)
    return ML.residuals(model, data, "TotalSubmissions").select("month", "TotalSubmissions", "prediction", "residual")


def _approval_time(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return M.approval_time_table(subs, apps, prods, TYPES).na.fill(0, ["ProductCount"])


_M14_FEATURES = ["HasPriority", "ProductCount"] + [f"ApplType_{t}" for t in TYPES]


def _m14(spark, d):
    return ML.approval_time_regression(_approval_time(spark, d), _M14_FEATURES)


@register("M14_approval_time_regression")
def m14_regression(spark, d):
    return _m14(spark, d)[0]


@register("M14_approval_time_importances")
def m14_importances(spark, d):
    return _m14(spark, d)[1]


# Features of the sponsor clusters.
_SPONSOR_FEATURES = ["TotalApplications", "TotalProducts", "UniqueForms", "UniqueIngredients", "ReferenceProducts",
                     "TotalSubmissions", "ApprovedSubmissions", "PriorityReviews", "ApprovalRate",
                     "ProductsPerApplication", "YearsActive", "SubmissionsPerYear", "PriorityRate"]


def _sponsors(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return M.sponsor_features(apps, prods, subs)


def _kmeans(spark, d):
    return ML.kmeans_select(_sponsors(spark, d), _SPONSOR_FEATURES)


@register("M16_M17_kmeans_k_selection")
def m16_select(spark, d):
    res, _ = _kmeans(spark, d)
    return res


@register("M16_M21_sponsor_cluster_profile")
def m16_profile(spark, d):
    _, labelled = _kmeans(spark, d)
    sizes = M.cluster_sizes(labelled, "cluster")
    means = M.cluster_means(labelled, "cluster", ["TotalApplications", "ApprovalRate", "PriorityRate",
                                                  "ProductsPerApplication"])
    return sizes.join(means, "cluster")


@register("M18_bisecting_sponsor_clusters")
def m18_bisecting(spark, d):
    lab = ML.bisecting_clusters(_sponsors(spark, d), _SPONSOR_FEATURES, k=5)
    return M.cluster_sizes(lab, "cluster")


@register("M18_ward_sponsor_clusters")
def m18_ward(spark, d):
    """Ward clusters of the sponsors: sizes, feature means, silhouette and
    Davies-Bouldin index of the whole clustering on every row."""
    labelled = ward_clusters(_sponsors(spark, d), _SPONSOR_FEATURES, k=5, scaled="scaled")
    return ML.clustering_report(labelled, "cluster", "scaled", ["TotalApplications", "ApprovalRate", "PriorityRate"])


@register("M16_M21_drug_segmentation")
def m16_drugs(spark, d):
    """Drug segments by k-means over the drug features: size, approval and
    priority rates, top forms and type mix."""
    drugs = labelled_drugs(spark, d)
    features = ["TotalSubmissions", "IsApproved", "HadPriorityReview", "IsReferenceDrug", "HasReferenceStandard", *[f"ApplType_{t}" for t in TYPES]]
    _, labelled = ML.kmeans_select(drugs, features, n_init=2)
    return M.cluster_profile(labelled, "cluster", ["IsApproved", "HadPriorityReview"], {"Form": 3, "ApplType": None}, ("DrugName", "TotalSubmissions"))


@register("M22_pca_explained_variance_embeddings")
def m22_pca(spark, d):
    emb = read_table(spark, d, "embeddings")
    dims = [f"e{i}" for i in range(64)]
    wide = emb.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    ev, _, _ = ML.pca_summary(wide, dims, k=2)
    return ev


@register("M22_pca_loadings_sponsors")
def m22_loadings(spark, d):
    _, ld, _ = ML.pca_summary(_sponsors(spark, d), _SPONSOR_FEATURES, k=2)
    return ld


_M23_SQL = with_roles("applications", "products") + """
, j AS (SELECT p.ApplNo, p.DrugName, p.Form, a.ApplType, p.ReferenceDrug FROM products p JOIN applications a ON p.ApplNo = a.ApplNo)
, ent AS (SELECT ApplNo, DrugName, 'Form_' || Form AS feature, count(*)::DOUBLE AS value FROM j WHERE Form IS NOT NULL GROUP BY ALL
          UNION ALL SELECT ApplNo, DrugName, 'Type_' || ApplType, count(*)::DOUBLE FROM j WHERE ApplType IS NOT NULL GROUP BY ALL
          UNION ALL SELECT ApplNo, DrugName, 'ReferenceDrug', sum(ReferenceDrug)::DOUBLE FROM j GROUP BY ALL)
, prof AS (SELECT i.ApplNo, i.DrugName, coalesce(p.profile, '') AS profile FROM (SELECT DISTINCT ApplNo, DrugName FROM j) i
           LEFT JOIN (SELECT ApplNo, DrugName, string_agg(feature || '=' || value, ';' ORDER BY feature) AS profile
                      FROM ent WHERE value <> 0 GROUP BY ALL) p USING (ApplNo, DrugName))
, cls AS (SELECT profile, count(*) AS n, min(struct_pack(a := ApplNo, d := DrugName)) AS rep FROM prof GROUP BY profile)
, feats AS (SELECT DISTINCT feature FROM ent WHERE value <> 0)
, dense AS (SELECT c.profile, c.n, f.feature, coalesce(e.value, 0.0) AS x FROM cls c CROSS JOIN feats f
            LEFT JOIN ent e ON e.ApplNo = c.rep.a AND e.DrugName = c.rep.d AND e.feature = f.feature)
, mean AS (SELECT feature, sum(n * x) / sum(n) AS m FROM dense GROUP BY feature)
, st AS (SELECT feature, m, sqrt(sum(n * (x - m) * (x - m)) / sum(n)) AS s FROM dense JOIN mean USING (feature)
         GROUP BY feature, m HAVING sum(n * (x - m) * (x - m)) / sum(n) > 1e-12)
, z AS (SELECT d.profile, d.feature, (d.x - st.m) / st.s AS z FROM dense d JOIN st ON d.feature = st.feature)
, norms AS (SELECT profile, sqrt(sum(z * z)) AS nrm FROM z GROUP BY profile)
, q AS (SELECT ApplNo, DrugName, profile FROM prof)
, dots AS (SELECT a.profile AS qp, b.profile AS p, sum(a.z * b.z) AS dot FROM z a JOIN z b ON a.feature = b.feature
           WHERE a.profile IN (SELECT profile FROM q) GROUP BY ALL)
, sims AS (SELECT qp, p, round(CASE WHEN n1.nrm * n2.nrm > 1e-12 THEN dot / (n1.nrm * n2.nrm) ELSE 0.0 END, 10) AS s
           FROM dots JOIN norms n1 ON qp = n1.profile JOIN norms n2 ON p = n2.profile)
, few AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ApplNo, DrugName) AS r FROM prof QUALIFY r <= 6)
, near AS (SELECT qp, s, f.ApplNo, f.DrugName FROM sims JOIN few f ON f.profile = sims.p
           QUALIFY row_number() OVER (PARTITION BY qp ORDER BY s DESC, f.ApplNo, f.DrugName) <= 6)
SELECT q.ApplNo AS q_ApplNo, q.DrugName AS q_DrugName, near.ApplNo, near.DrugName, near.s AS SimilarityScore,
       CAST(row_number() OVER (PARTITION BY q.ApplNo, q.DrugName ORDER BY near.s DESC, near.ApplNo, near.DrugName) AS INTEGER) AS rank
FROM q JOIN near ON near.qp = q.profile AND NOT (near.ApplNo = q.ApplNo AND near.DrugName = q.DrugName)
QUALIFY rank <= 5
"""


def _drugs(spark, d):
    """Profile entries and all drugs."""
    apps, prods = roles(spark, d, "applications", "products")
    items = dealt(prods.select("ApplNo", "DrugName"), "ApplNo").join(apps.select("ApplNo"), "ApplNo", "left_semi").distinct()
    return profile_entries(prods, apps), cut_lineage(items), ["ApplNo", "DrugName"]  # items are counted and listed


@register("M23_drug_recommendations_top5", sql=_M23_SQL)
def m23_recs(spark, d):
    """Every drug against all drugs."""
    return similar_items(*_drugs(spark, d), k=5)


@register("M23_drug_recommendations_lsh")
def m23_recs_lsh(spark, d):
    """The drugs whose application number 20 divides, against all drugs."""
    entries, items, cols = _drugs(spark, d)
    return similar_items_lsh(entries, items, cols, items.where("ApplNo % 20 = 0"), k=5)


@register("M24_isolation_forest_applications")
def m24_iforest(spark, d):
    prods, subs = roles(spark, d, "products", "submissions")
    f = anomaly_features(subs, prods)
    return isolation_forest(f, ["ApplNo"], ["WithdrawalCount", "WithdrawalRate", "TotalSubmissions", "PriorityRate",
                                            "ProductCount"])
