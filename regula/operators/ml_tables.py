"""Feature tables, encodings and evaluation metrics for the ML operators
(M1-M7, M10, M11, M14 table, M15, M19-M21).  All are plain DataFrame
compositions; the model fitting lives in ``regula.operators.models``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regula.functions.columns import count_of, ratio
from regula.operators.relational import few_broadcast, grouped_quantiles, prefix_sums
from regula.session import cut_lineage, dealt, written


# ------------------------------------------------------------- M1 / M2 / M3

def approval_training_table(subs: DataFrame, apps: DataFrame, products: DataFrame, *, key: str = "ApplNo",
                            date: str = "SubmissionStatusDate", status: str = "SubmissionStatus",
                            approved: str = "AP") -> DataFrame:
    """Submissions with application and per-application product counts and
    the IsApproved label (M1).  Missing product info -> 0 (C14)."""
    s = (subs.withColumn("Year", F.year(date)).withColumn("Month", F.month(date))
             .withColumn("IsApproved", F.coalesce(F.col(status) == approved, F.lit(False)).cast("int")))
    s = dealt(s, key)
    a = apps.select(key, "ApplType", "SponsorName")
    p = dealt(products.select(key, "ProductNo", "Form", "ActiveIngredient", "ReferenceDrug"), key)
    p = p.groupBy(key).agg(F.count("ProductNo").alias("ProductCount"),
                           F.countDistinct("Form").alias("UniqueFormCount"),
                           F.countDistinct("ActiveIngredient").alias("UniqueIngredientCount"),
                           F.sum("ReferenceDrug").alias("ReferenceProductCount"))
    j = s.join(a, key, "left").join(p, key, "left")
    return j.na.fill(0, ["ProductCount", "UniqueFormCount", "UniqueIngredientCount", "ReferenceProductCount"])


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Alphabetical integer codes (M3), like ``StringIndexer(alphabetAsc)``:
    codes are ranked over the distinct values only, then joined back; those of
    few values go to all tasks."""
    values = df.select(col).filter(F.col(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    codes = cut_lineage(prefix_sums(values, col, ["_one"]).select(col, F.col("_one_before").cast("int").alias(out)))
    return df.join(few_broadcast(codes), col, "left")


# The model's features.
FEATURES = ["ApplType_Encoded", "ReviewPriority_Encoded", "SubmissionClassCodeID", "ProductCount",
            "UniqueFormCount", "UniqueIngredientCount", "ReferenceProductCount", "SponsorSubmissionCount",
            "SponsorApprovalRate", "Year", "Month", "IsRecentSubmission", "IsQ4Submission"]


def approval_features(table: DataFrame, *, recent_year: int = 2015, sponsor_stats_from: DataFrame | None = None,
                      key: str = "ApplNo") -> DataFrame:
    """The 13-feature classification table (M2).  Sponsor count and approval
    rate come from ``sponsor_stats_from`` (the training split, D9); pass
    None for the reference's whole-data (leaky) statistics."""
    table = written(table)  # a three-way join that four steps below read, few columns each
    t = label_encode(table, "ApplType", "ApplType_Encoded")
    t = label_encode(t, "ReviewPriority", "ReviewPriority_Encoded")
    src = table if sponsor_stats_from is None else sponsor_stats_from
    sp = (src.filter(F.col("SponsorName").isNotNull()).groupBy("SponsorName")
             .agg(F.count(key).alias("SponsorSubmissionCount"), F.avg("IsApproved").alias("SponsorApprovalRate")))
    t = dealt(t, "SponsorName", rows=table.count()).join(sp, "SponsorName", "left")
    t = (t.withColumn("IsRecentSubmission", F.coalesce(F.col("Year") >= recent_year, F.lit(False)).cast("int"))
          .withColumn("IsQ4Submission", F.coalesce(F.col("Month").isin(10, 11, 12), F.lit(False)).cast("int")))
    return t.na.drop(subset=FEATURES + ["IsApproved"])


# ----------------------------------------------------------------- M4 / M7

def one_hot(df: DataFrame, col: str, values: list, prefix: str | None = None) -> DataFrame:
    """``get_dummies`` with a fixed value list (M4): one 0/1 column per value."""
    p = prefix or col
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{p}_{v}") for v in values]) \
             .na.fill(0, [f"{p}_{v}" for v in values])


def hash_cuts(df: DataFrame, key_cols: list[str], stratum: str | None, shares: list[float], seed: int, name: str) -> DataFrame:
    """``name``: how many of the cuts at ``shares`` a row's seeded key hash has
    passed, the cuts being quantiles of the hash within the row's stratum, so
    that every stratum is cut in the very shares."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key_cols]), F.lit(1 << 40)).cast("double")
    keys = [stratum] if stratum else []
    rows = df.withColumn("_h", h)
    cuts = grouped_quantiles(rows, keys, "_h", shares, "_cuts")
    if stratum:
        cuts = cut_lineage(cuts.withColumnRenamed(stratum, "_stratum"))
        rows = rows.join(few_broadcast(cuts), F.col(stratum).eqNullSafe(F.col("_stratum")))
    else:
        rows = rows.crossJoin(F.broadcast(cuts))
    passed = F.aggregate("_cuts", F.lit(0), lambda n, cut: n + (F.col("_h") >= cut).cast("int"))
    return rows.withColumn(name, passed).drop("_h", "_cuts", "_stratum")


def split_flag(df: DataFrame, key_cols: list[str], test_fraction: float = 0.2, seed: int = 42,
               name: str = "is_test", stratify: str | None = None) -> DataFrame:
    """Deterministic train/test split (M7) by a seeded hash of the row key:
    the ``test_fraction`` of each class of ``stratify`` with the least hashes."""
    return hash_cuts(df, key_cols, stratify, [test_fraction], seed, "_part").withColumn(name, F.col("_part") == 0).drop("_part")


# ------------------------------------------------------------- M6 / M10 / M11

def roc_points(scored: DataFrame, score: str, label: str) -> DataFrame:
    """ROC curve at every distinct score threshold (M6): cumulative true and
    false positives over the distinct scores, descending."""
    g = cut_lineage(scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_pos"),
                                              F.count_if(F.col(label) == 0).alias("_neg")))
    tot = g.agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    c = prefix_sums(g, score, ["_pos", "_neg"], descending=True).crossJoin(F.broadcast(tot))
    return c.select(F.col(score).alias("threshold"),
                    F.try_divide(F.col("_pos_before") + F.col("_pos"), F.col("_P")).alias("tpr"),
                    F.try_divide(F.col("_neg_before") + F.col("_neg"), F.col("_N")).alias("fpr"))


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks (tie-aware), M6.  The
    ranks are taken over distinct scores.  Null where a class is missing."""
    g = scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_pos"),
                                  F.count_if(F.col(label) == 0).alias("_neg"))
    r = prefix_sums(g.withColumn("_t", F.col("_pos") + F.col("_neg")), score, ["_t"])
    r = r.withColumn("_rank", F.col("_t_before") + (F.col("_t") + 1) / 2.0)
    a = r.agg(F.sum(F.col("_pos") * F.col("_rank")).alias("_r"), F.sum("_pos").alias("n_pos"),
              F.sum("_neg").alias("n_neg"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return a.select("n_pos", "n_neg", F.try_divide(F.col("_r") - p * (p + 1) / 2, p * n).alias("auc"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2 x 2 confusion matrix (M11) as rows of true label with predicted 0/1."""
    p = pred.select(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("_p"))
    return p.groupBy("label").agg(F.count_if(F.col("_p") == 0).alias("pred_0"),
                                  F.count_if(F.col("_p") == 1).alias("pred_1"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision / recall / F1 / support per class plus macro and weighted
    averages (M10); undefined ratios are 0, as the library reports them."""
    p = pred.select(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("yhat"))
    classes = p.select(F.col("y").alias("cls")).union(p.select(F.col("yhat").alias("cls"))).distinct()
    cnt = p.groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    tp = cnt.filter(F.col("y") == F.col("yhat")).select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    sup = cnt.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    predn = cnt.groupBy(F.col("yhat").alias("cls")).agg(F.sum("n").alias("predicted"))
    r = (classes.join(tp, "cls", "left").join(sup, "cls", "left").join(predn, "cls", "left")
                .na.fill(0, ["tp", "support", "predicted"]))
    r = (r.withColumn("precision", F.coalesce(ratio("tp", "predicted"), F.lit(0.0)))
          .withColumn("recall", F.coalesce(ratio("tp", "support"), F.lit(0.0))))
    r = r.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"),
                                            F.col("precision") + F.col("recall")), F.lit(0.0)))
    per = r.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                   F.col("support").cast("long").alias("support"))
    tot = r.agg(F.sum("support").alias("_s"))
    macro = r.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                  F.sum("support").cast("long").alias("support"))
    wr = r.crossJoin(F.broadcast(tot))
    weighted = wr.agg(F.lit("weighted avg").alias("class"),
                      (F.sum(F.col("precision") * F.col("support")) / F.first("_s")).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / F.first("_s")).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / F.first("_s")).alias("f1"),
                      F.sum("support").cast("long").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


# ------------------------------------------------------------ M14 / M15 / M20

def approval_time_table(subs: DataFrame, apps: DataFrame, products: DataFrame, types: list[str], *,
                        key: str = "ApplNo") -> DataFrame:
    """Approval-time regression table (M14): days between first and last
    approved submission (0..3650), any priority review, product count,
    one-hot application type."""
    a = subs.filter(F.col("SubmissionStatus") == "AP")
    t = a.groupBy(key).agg(F.min("SubmissionStatusDate").alias("_f"), F.max("SubmissionStatusDate").alias("_l"),
                           F.coalesce(F.bool_or(F.col("ReviewPriority") == "PRIORITY"), F.lit(False)).alias("_hp"))
    t = (t.withColumn("DaysToApproval", F.timestamp_diff("DAY", F.col("_f"), F.col("_l")).cast("long"))
          .filter(F.col("DaysToApproval").between(0, 3650))
          .select(key, "DaysToApproval", F.col("_hp").cast("int").alias("HasPriority")))
    j = apps.select(key, "ApplType").join(t, key, "inner")
    pc = products.groupBy(key).agg(F.count(F.lit(1)).alias("ProductCount"))
    j = j.join(pc, key, "left")
    return one_hot(j, "ApplType", types).drop("ApplType")


def sponsor_features(apps: DataFrame, products: DataFrame, subs: DataFrame, *, key: str = "ApplNo",
                     sponsor: str = "SponsorName", min_apps: int = 5) -> DataFrame:
    """Sponsor feature table (M15): 10 base + 5 derived features, sponsors
    with at least ``min_apps`` applications, remaining nulls -> 0."""
    a = apps.select(key, sponsor).filter(F.col(sponsor).isNotNull())
    base = a.groupBy(sponsor).agg(F.count(key).alias("TotalApplications"))
    pj = products.join(a, key, "inner")
    ps = pj.groupBy(sponsor).agg(F.count("ProductNo").alias("TotalProducts"), F.countDistinct("Form").alias("UniqueForms"),
                                 F.countDistinct("ActiveIngredient").alias("UniqueIngredients"),
                                 F.sum("ReferenceDrug").alias("ReferenceProducts"))
    sj = subs.withColumn("_y", F.year("SubmissionStatusDate")).join(a, key, "inner")
    ss = sj.groupBy(sponsor).agg(F.count("SubmissionNo").alias("TotalSubmissions"),
                                 count_of("SubmissionStatus", "AP").alias("ApprovedSubmissions"),
                                 count_of("ReviewPriority", "PRIORITY").alias("PriorityReviews"),
                                 F.min("_y").alias("FirstYear"), F.max("_y").alias("LastYear"))
    f = base.filter(F.col("TotalApplications") >= min_apps).join(ps, sponsor, "left").join(ss, sponsor, "left")
    f = (f.withColumn("ApprovalRate", ratio("ApprovedSubmissions", "TotalSubmissions"))
          .withColumn("ProductsPerApplication", ratio("TotalProducts", "TotalApplications"))
          .withColumn("YearsActive", F.col("LastYear") - F.col("FirstYear") + 1))
    f = (f.withColumn("SubmissionsPerYear", ratio("TotalSubmissions", "YearsActive"))
          .withColumn("PriorityRate", ratio("PriorityReviews", "TotalSubmissions")))
    longs = ["TotalProducts", "UniqueForms", "UniqueIngredients", "ReferenceProducts", "TotalSubmissions",
             "ApprovedSubmissions", "PriorityReviews"]
    ints = ["FirstYear", "LastYear", "YearsActive"]
    dbls = ["ApprovalRate", "ProductsPerApplication", "SubmissionsPerYear", "PriorityRate"]
    return f.na.fill(0, longs + ints).na.fill(0.0, dbls)


def drug_features(products: DataFrame, apps: DataFrame, subs: DataFrame, types: list[str], *,
                  key: str = "ApplNo", carry: tuple[str, ...] = ()) -> DataFrame:
    """Drug (product) feature table (M20): submissions, approved and priority
    flags of the application, reference flags (D2) and one-hot type; rows of
    applications without submissions are dropped.  ``carry`` names further
    columns of the products, or ApplType, to keep."""
    s = subs.groupBy(key).agg(F.count("SubmissionNo").alias("TotalSubmissions"),
                              F.coalesce(F.bool_or(F.col("SubmissionStatus") == "AP"), F.lit(False)).cast("int").alias("IsApproved"),
                              F.coalesce(F.bool_or(F.col("ReviewPriority") == "PRIORITY"), F.lit(False)).cast("int").alias("HadPriorityReview"))
    j = products.join(apps.select(key, "ApplType"), key, "left").join(s, key, "inner")
    rs = F.col("ReferenceStandard")
    j = (j.withColumn("IsReferenceDrug", F.coalesce(F.col("ReferenceDrug").cast("int"), F.lit(0)))
          .withColumn("HasReferenceStandard",
                      F.coalesce(rs.isNotNull() & (rs.cast("string") != "") & (rs.cast("string") != "0"), F.lit(False)).cast("int")))
    j = one_hot(j, "ApplType", types)
    return j.select(key, "ProductNo", "TotalSubmissions", "IsApproved", "HadPriorityReview", "IsReferenceDrug",
                    "HasReferenceStandard", *[f"ApplType_{t}" for t in types], *carry)


# ----------------------------------------------------------------- M19 / M21

def _vec_dist(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def centroids(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Per-cluster mean vector: positions exploded, averaged, re-assembled
    in position order (partial aggregation keeps this cluster-sized)."""
    e = df.select(cluster, F.posexplode(vec).alias("_pos", "_v"))
    m = e.groupBy(cluster, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return m.groupBy(cluster).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("centroid"))


def davies_bouldin(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Davies-Bouldin index (M19): mean over clusters of the worst
    (S_i + S_j) / d(c_i, c_j).  Pairs of centroids are joined, one row a pair."""
    c = centroids(df, vec, cluster)
    s = (df.select(cluster, F.col(vec).cast("array<double>").alias("_x")).join(c, cluster)
           .groupBy(cluster).agg(F.avg(_vec_dist(F.col("_x"), F.col("centroid"))).alias("_s")))
    cs = cut_lineage(c.join(s, cluster))
    other = cs.select(F.col(cluster).alias("_other"), F.col("centroid").alias("_c2"), F.col("_s").alias("_s2"))
    ratio_ = F.try_divide(F.col("_s") + F.col("_s2"), _vec_dist(F.col("centroid"), F.col("_c2")))
    pairs = cs.join(other, F.col(cluster) != F.col("_other")).groupBy(cluster).agg(F.max(ratio_).alias("_m"))
    return pairs.filter(F.col("_m").isNotNull()).agg(F.avg("_m").alias("davies_bouldin"), F.count(F.lit(1)).alias("n_clusters"))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """Cluster sizes and shares."""
    from regula.operators.relational import value_counts
    return value_counts(df, cluster, count_name="size")


def cluster_means(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Feature means per cluster."""
    return df.groupBy(cluster).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def cluster_vector_means(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Per-cluster mean of every vector position, long form."""
    e = df.select(cluster, F.posexplode(vec).alias("position", "_v"))
    return e.groupBy(cluster, "position").agg(F.avg(F.col("_v").cast("double")).alias("mean"))


def cluster_top_members(df: DataFrame, cluster: str, member: str, by: str, k: int = 3) -> DataFrame:
    """The ``k`` members of each cluster with the greatest ``by``, ties by
    member (M21)."""
    from regula.operators.relational import top_k_per_group
    return top_k_per_group(df.select(cluster, member, by), cluster, k, [F.col(by).desc(), F.col(member)])


def cluster_category_mix(df: DataFrame, cluster: str, category: str, k: int | None = None) -> DataFrame:
    """Rows and share of each category in each cluster, most frequent first;
    the first ``k`` with ``k`` (M21: top forms, type mix).  Null is no category."""
    n = df.filter(F.col(category).isNotNull()).groupBy(cluster, category).agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy(cluster).agg(F.sum("n").alias("_all"))
    shared = n.join(whole, cluster).withColumn("pct", F.col("n") / F.col("_all") * 100).drop("_all")
    w = Window.partitionBy(cluster).orderBy(F.col("n").desc(), F.col(category))
    ranked = shared.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def cluster_profile(df: DataFrame, cluster: str, means: list[str], categories: dict[str, int | None], members: tuple[str, str] | None = None) -> DataFrame:
    """One row per cluster: size, pct, mean of each of ``means``, an array
    ``top_<category>`` of (value, n, pct) per category (its first ones, or all),
    and with ``members`` = (member, by) the three greatest members (M21)."""
    out = cluster_sizes(df, cluster).join(cluster_means(df, cluster, means), cluster)

    def listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        top = F.sort_array(F.collect_list(F.struct("rank", *fields)))
        return rows.groupBy(cluster).agg(F.transform(top, lambda t: F.struct(*[t[f].alias(f) for f in fields])).alias(name))

    for c, k in categories.items():
        mix = cluster_category_mix(df, cluster, c, k).withColumnRenamed(c, "value")
        out = out.join(listed(mix, f"top_{c}", "value", "n", "pct"), cluster, "left")
    if members:
        top = cluster_top_members(df, cluster, *members).withColumnsRenamed({members[0]: "member", members[1]: "by"})
        out = out.join(listed(top, "top_members", "member", "by"), cluster, "left")
    return out
