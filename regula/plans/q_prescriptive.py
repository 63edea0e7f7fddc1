"""Registered prescriptive scoring queries (P-series, M25, Z7)."""

from __future__ import annotations

from regula.operators import prescriptive as P
from regula.operators import stats as Z
from regula.plans.registry import register
from regula.plans.roles import roles, with_roles

_RISK_SQL = """
, g AS (SELECT ApplNo, count(SubmissionStatus) AS TotalSubmissions,
               count(CASE WHEN SubmissionStatus = 'WD' THEN 1 END) AS Withdrawals,
               count(CASE WHEN SubmissionStatus IN ('TA', 'RL') THEN 1 END) AS Rejections,
               date_diff('day', min(SubmissionStatusDate), max(SubmissionStatusDate)) AS days,
               coalesce(bool_or(ReviewPriority = 'PRIORITY'), false) AS HasPriority
        FROM submissions GROUP BY ApplNo)
, g2 AS (SELECT ApplNo, TotalSubmissions, Withdrawals, Rejections, HasPriority,
                Withdrawals::DOUBLE / nullif(TotalSubmissions, 0) AS WithdrawalRate,
                Rejections::DOUBLE / nullif(TotalSubmissions, 0) AS RejectionRate,
                CASE WHEN days = 0 THEN 1 ELSE days END AS DevelopmentDays FROM g)
, g3 AS (SELECT *, TotalSubmissions / (DevelopmentDays / 365) AS SubmissionFrequency FROM g2)
, mf AS (SELECT quantile_cont(SubmissionFrequency, 0.95) AS maxf FROM g3)
, g4 AS (SELECT g3.*, CASE WHEN mf.maxf > 0 THEN CASE WHEN SubmissionFrequency / mf.maxf > 1 THEN 1.0::DOUBLE
                                                     ELSE SubmissionFrequency / mf.maxf END
                      ELSE 0.0::DOUBLE END AS NormalizedFrequency FROM g3, mf)
, rs AS (SELECT *, 0.3::DOUBLE * coalesce(WithdrawalRate, 0.0::DOUBLE) + 0.3::DOUBLE * coalesce(RejectionRate, 0.0::DOUBLE)
                   + 0.2::DOUBLE * NormalizedFrequency + 0.2::DOUBLE * CAST(HasPriority AS INTEGER) AS RiskScore FROM g4)
, ed AS (SELECT quantile_cont(RiskScore, [0.0, 0.33, 0.67, 1.0]) AS q, min(RiskScore) AS lo, max(RiskScore) AS hi FROM rs)
, lv AS (SELECT rs.*, CASE WHEN RiskScore IS NULL THEN NULL
                      WHEN q[1] < q[2] AND q[2] < q[3] AND q[3] < q[4] THEN
                           CASE WHEN RiskScore <= q[2] THEN 'Low' WHEN RiskScore <= q[3] THEN 'Medium' ELSE 'High' END
                      WHEN hi - lo > 0 THEN
                           CASE WHEN RiskScore <= lo + (hi - lo) * 0.33 THEN 'Low'
                                WHEN RiskScore <= lo + (hi - lo) * 0.67 THEN 'Medium' ELSE 'High' END
                      ELSE 'Medium' END AS RiskLevel
         FROM rs, ed)
"""


def _levelled(spark, d):
    (subs,) = roles(spark, d, "submissions")
    return P.risk_levels(P.risk_indicators(subs))


@register("P1_P2_risk_scores", sql=with_roles("submissions") + _RISK_SQL + "SELECT * FROM lv")
def p1_risk(spark, d):
    return _levelled(spark, d)


@register("P3_high_risk_top15", sql=with_roles("submissions") + _RISK_SQL + """
SELECT CAST(row_number() OVER (ORDER BY RiskScore DESC, ApplNo) AS INTEGER) AS rank, ApplNo, RiskScore, TotalSubmissions, Withdrawals, Rejections,
       CASE WHEN RiskScore > 0.7 THEN 'Weekly monitoring' ELSE 'Bi-weekly monitoring' END AS Action
FROM lv WHERE RiskLevel = 'High' ORDER BY RiskScore DESC, ApplNo LIMIT 15
""")
def p3_top(spark, d):
    return P.high_risk_list(_levelled(spark, d))


@register("P3_risk_level_distribution", sql=with_roles("submissions") + _RISK_SQL + """
, c AS (SELECT RiskLevel, count(*) AS count FROM lv GROUP BY RiskLevel)
SELECT RiskLevel, count, count::DOUBLE / (SELECT sum(count) FROM c) * 100 AS pct FROM c WHERE RiskLevel IS NOT NULL
""")
def p3_dist(spark, d):
    return P.risk_distribution(_levelled(spark, d))


@register("Z7_risk_factor_correlations", sql=with_roles("submissions") + _RISK_SQL + """
, f AS (SELECT WithdrawalRate AS a1, RejectionRate AS a2, SubmissionFrequency AS a3, RiskScore AS a4 FROM lv)
""" + "".join(
    f"{'SELECT' if (i, j) == (0, 0) else 'UNION ALL SELECT'} '{a}' AS col_a, '{b}' AS col_b, corr(a{j + 1}, a{i + 1}) AS corr FROM f\n"
    for i, a in enumerate(["WithdrawalRate", "RejectionRate", "SubmissionFrequency", "RiskScore"])
    for j, b in enumerate(["WithdrawalRate", "RejectionRate", "SubmissionFrequency", "RiskScore"])))
def z7_corr(spark, d):
    return Z.correlation_matrix(_levelled(spark, d),
                                ["WithdrawalRate", "RejectionRate", "SubmissionFrequency", "RiskScore"])


_READY_SQL = """
, ranked AS (SELECT ApplNo, SubmissionStatus, row_number() OVER (
               PARTITION BY ApplNo ORDER BY (SubmissionStatusDate IS NULL) DESC, SubmissionStatusDate DESC,
                                           SubmissionNo DESC, SubmissionStatus DESC) AS rn
             FROM submissions WHERE SubmissionStatus IS NOT NULL)
, latest AS (SELECT ApplNo, SubmissionStatus AS CurrentStatus FROM ranked WHERE rn = 1)
, pending AS (SELECT * FROM latest WHERE NOT coalesce(CurrentStatus IN ('AP', 'WD'), false))
, s AS (SELECT ApplNo, count(*) AS TotalSubmissions,
               coalesce(bool_or(ReviewPriority = 'PRIORITY'), false) AS HasPriorityReview,
               coalesce(date_diff('day', min(SubmissionStatusDate), max(SubmissionStatusDate)), 0) AS DaysSinceFirst
        FROM submissions GROUP BY ApplNo)
, p AS (SELECT ApplNo, count(*) AS ProductCount, CAST(sum(ReferenceDrug) AS BIGINT) AS ReferenceProducts
        FROM products GROUP BY ApplNo)
, a AS (SELECT ApplNo, min(ApplType) AS ApplType FROM applications GROUP BY ApplNo)
, r AS (SELECT pending.ApplNo, pending.CurrentStatus, a.ApplType, s.TotalSubmissions, s.HasPriorityReview,
               s.DaysSinceFirst, coalesce(p.ProductCount, 0) AS ProductCount,
               coalesce(p.ReferenceProducts, 0) AS ReferenceProducts
        FROM pending JOIN a ON pending.ApplNo = a.ApplNo JOIN s ON pending.ApplNo = s.ApplNo
        LEFT JOIN p ON pending.ApplNo = p.ApplNo)
, mx AS (SELECT greatest(max(TotalSubmissions), 1) AS ms, greatest(max(ProductCount), 1) AS mp,
                greatest(max(DaysSinceFirst), 1) AS md FROM r)
, sc AS (SELECT r.*, TotalSubmissions / ms AS SubmissionScore, ProductCount / mp AS ProductScore,
                DaysSinceFirst / md AS TimeScore, CAST(HasPriorityReview AS INTEGER) * 0.2::DOUBLE AS PriorityBonus
         FROM r, mx)
, sc2 AS (SELECT *, 0.3::DOUBLE * SubmissionScore + 0.2::DOUBLE * ProductScore + 0.3::DOUBLE * TimeScore
                    + 0.2::DOUBLE * PriorityBonus AS ReadinessScore FROM sc)
, rd AS (SELECT *, CAST(dense_rank() OVER (ORDER BY ReadinessScore DESC) AS INTEGER) AS ReadinessRank FROM sc2)
"""


def _readiness(spark, d):
    apps, prods, subs = roles(spark, d, "applications", "products", "submissions")
    return P.approval_readiness(subs, apps, prods)


@register("P4_readiness_top20", sql=with_roles("applications", "products", "submissions") + _READY_SQL
          + "SELECT * FROM rd ORDER BY ReadinessRank, ApplNo LIMIT 20")
def p4_top(spark, d):
    return P.top_ready(_readiness(spark, d))


@register("P4_readiness_by_type", sql=with_roles("applications", "products", "submissions") + _READY_SQL
          + "SELECT ApplType, avg(ReadinessScore) AS mean_readiness, count(*) AS n FROM rd GROUP BY ApplType")
def p4_type(spark, d):
    return P.readiness_by_type(_readiness(spark, d))


@register("P4_readiness_components", sql=with_roles("applications", "products", "submissions") + _READY_SQL
          + """SELECT avg(SubmissionScore) AS SubmissionScore, avg(ProductScore) AS ProductScore,
                      avg(TimeScore) AS TimeScore, avg(PriorityBonus) AS PriorityBonus FROM rd""")
def p4_components(spark, d):
    return P.readiness_components(_readiness(spark, d))


@register("P5_sponsor_success_top20", sql=with_roles("applications", "submissions") + """
, j AS (SELECT s.*, a.SponsorName FROM submissions s JOIN applications a ON s.ApplNo = a.ApplNo
        WHERE a.SponsorName IS NOT NULL)
, m AS (SELECT SponsorName, count(SubmissionStatus) AS TotalSubmissions,
               count(CASE WHEN SubmissionStatus = 'AP' THEN 1 END) AS Approvals,
               count(CASE WHEN ReviewPriority = 'PRIORITY' THEN 1 END) AS PriorityReviews,
               count(DISTINCT ApplNo) AS UniqueApplications FROM j GROUP BY SponsorName)
, m2 AS (SELECT *, Approvals::DOUBLE / nullif(TotalSubmissions, 0) AS ApprovalRate,
                TotalSubmissions::DOUBLE / nullif(UniqueApplications, 0) AS SubmissionEfficiency FROM m)
, m3 AS (SELECT *, 0.4::DOUBLE * ApprovalRate + 0.3::DOUBLE * (1.0::DOUBLE / nullif(SubmissionEfficiency, 0))
          + 0.3::DOUBLE * (PriorityReviews::DOUBLE / nullif(TotalSubmissions, 0)) AS SuccessScore
        FROM m2 WHERE TotalSubmissions >= 10)
SELECT *, CAST(row_number() OVER (ORDER BY SuccessScore DESC, SponsorName) AS INTEGER) AS "Rank" FROM m3
ORDER BY SuccessScore DESC, SponsorName LIMIT 20
""")
def p5_success(spark, d):
    apps, subs = roles(spark, d, "applications", "submissions")
    return P.sponsor_success_list(P.sponsor_success(subs, apps))


_DOSE_SQL = """
, appr AS (SELECT ApplNo, bool_or(coalesce(SubmissionStatus = 'AP', false)) AS IsApproved FROM submissions GROUP BY ApplNo)
, dose AS (SELECT p.*, TRY_CAST(nullif(regexp_extract(Strength, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS DosageValue,
                  appr.IsApproved
           FROM products p LEFT JOIN appr ON p.ApplNo = appr.ApplNo)
, dz AS (SELECT * FROM dose WHERE DosageValue IS NOT NULL)
"""


def _doses(spark, d):
    prods, subs = roles(spark, d, "products", "submissions")
    return P.dose_table(prods, subs)


@register("P6_dose_range_by_form", sql=with_roles("products", "submissions") + _DOSE_SQL + """
, g AS (SELECT Form, avg(DosageValue) AS mean_dose, stddev_samp(DosageValue) AS std_dose, min(DosageValue) AS min_dose,
               max(DosageValue) AS max_dose, count(DosageValue) AS n, avg(CAST(IsApproved AS INTEGER)) AS approval_rate
        FROM dz WHERE Form IS NOT NULL GROUP BY Form HAVING count(DosageValue) >= 10 ORDER BY n DESC, Form LIMIT 10)
SELECT *, mean_dose - std_dose AS range_low, mean_dose + std_dose AS range_high FROM g
""")
def p6_dose(spark, d):
    return P.dose_by_form(_doses(spark, d))


@register("P7_dose_decile_approval", sql=with_roles("products", "submissions") + _DOSE_SQL + """
, e AS (SELECT list_sort(list_distinct(quantile_cont(DosageValue, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))
               AS edges FROM dz)
, ei AS (SELECT CAST(generate_subscripts(edges, 1) - 1 AS INTEGER) AS i, unnest(edges) AS e FROM e)
, nb AS (SELECT count(*) AS n FROM ei)
, b AS (SELECT dz.DosageValue, dz.IsApproved,
               CASE WHEN dz.DosageValue = (SELECT min(e) FROM ei) THEN 0
                    ELSE (SELECT count(*) FROM ei WHERE ei.e < dz.DosageValue) - 1 END AS bin FROM dz)
, g AS (SELECT CAST(least(bin, (SELECT n FROM nb) - 2) AS INTEGER) AS bin, avg(CAST(IsApproved AS INTEGER)) AS approval_rate,
               count(IsApproved) AS n FROM b GROUP BY 1)
SELECT g.bin, lo.e AS bin_lower, hi.e AS bin_upper, g.approval_rate, g.n
FROM g JOIN ei lo ON lo.i = g.bin JOIN ei hi ON hi.i = g.bin + 1
WHERE g.n >= 20 ORDER BY approval_rate DESC, bin LIMIT 3
""")
def p7_deciles(spark, d):
    return P.dose_deciles(_doses(spark, d))


@register("P8_dose_histogram_top5_forms", sql=with_roles("products") + """
, tf AS (SELECT Form FROM products WHERE Form IS NOT NULL GROUP BY Form ORDER BY count(*) DESC, Form LIMIT 5)
, v AS (SELECT p.Form, TRY_CAST(nullif(regexp_extract(Strength, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS v
        FROM products p WHERE p.Form IN (SELECT Form FROM tf))
, b AS (SELECT Form, CASE WHEN v < 10 THEN 0 WHEN v < 50 THEN 1 WHEN v < 100 THEN 2 WHEN v < 200 THEN 3
                          WHEN v < 300 THEN 4 WHEN v < 400 THEN 5 WHEN v < 500 THEN 6 ELSE 7 END AS bin, count(*) AS c
        FROM v WHERE v IS NOT NULL AND v >= 0 GROUP BY 1, 2)
, lab AS (SELECT * FROM (VALUES (0, '0-10'), (1, '10-50'), (2, '50-100'), (3, '100-200'), (4, '200-300'),
                                (5, '300-400'), (6, '400-500'), (7, '500+')) t(bin, label))
SELECT tf.Form, CAST(lab.bin AS INTEGER) AS bin, lab.label, coalesce(b.c, 0) AS count
FROM tf CROSS JOIN lab LEFT JOIN b ON b.Form = tf.Form AND b.bin = lab.bin
""")
def p8_hist(spark, d):
    (prods,) = roles(spark, d, "products")
    return P.dose_histogram_top_forms(prods)


@register("P9_dose_summary_by_approval", sql=with_roles("products", "submissions") + _DOSE_SQL + """
, d2 AS (SELECT * FROM dz WHERE IsApproved IS NOT NULL)
, cap AS (SELECT IsApproved, quantile_cont(DosageValue, 0.95) AS c FROM d2 GROUP BY IsApproved)
, t AS (SELECT d2.* FROM d2 JOIN cap ON d2.IsApproved = cap.IsApproved WHERE d2.DosageValue <= cap.c)
SELECT IsApproved, count(DosageValue) AS n, min(DosageValue) AS min, quantile_cont(DosageValue, 0.25) AS q1,
       median(DosageValue) AS median, quantile_cont(DosageValue, 0.75) AS q3, max(DosageValue) AS max
FROM t GROUP BY IsApproved
""")
def p9_summary(spark, d):
    return P.dose_summary_by_approval(_doses(spark, d))


@register("P11_trimmed_dose_histograms", sql=with_roles("products", "submissions") + _DOSE_SQL + """
, cnt AS (SELECT Form, count(*) AS n FROM dz WHERE Form IS NOT NULL GROUP BY Form)
, tf AS (SELECT Form FROM (SELECT * FROM cnt ORDER BY n DESC, Form LIMIT 5) WHERE n > 10)
, d AS (SELECT dz.* FROM dz WHERE Form IN (SELECT Form FROM tf))
, cap AS (SELECT Form, quantile_cont(DosageValue, 0.95) AS c FROM d GROUP BY Form)
, t AS (SELECT d.Form, d.DosageValue FROM d JOIN cap ON d.Form = cap.Form WHERE d.DosageValue <= cap.c)
, rng AS (SELECT Form, min(DosageValue) AS lo, max(DosageValue) AS hi FROM t GROUP BY Form)
, b AS (SELECT t.Form, CAST(least(greatest(floor((DosageValue - CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END)
                          / (CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END - CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END) * 20), 0), 19) AS INTEGER) AS bin,
               count(*) AS c FROM t JOIN rng ON t.Form = rng.Form GROUP BY 1, 2)
SELECT rng.Form, CAST(s.bin AS INTEGER) AS bin, coalesce(b.c, 0) AS count
FROM rng CROSS JOIN (SELECT unnest(range(0, 20)) AS bin) s LEFT JOIN b ON b.Form = rng.Form AND b.bin = s.bin
""")
def p11_hist(spark, d):
    return P.trimmed_dose_histograms(_doses(spark, d))


@register("M25_anomaly_features", sql=with_roles("products", "submissions") + """
, s AS (SELECT ApplNo, count(CASE WHEN SubmissionStatus = 'WD' THEN 1 END) AS WithdrawalCount,
               count(SubmissionNo) AS TotalSubmissions, count(CASE WHEN ReviewPriority = 'PRIORITY' THEN 1 END) AS PriorityCount
        FROM submissions GROUP BY ApplNo)
, p AS (SELECT ApplNo, count(ProductNo) AS ProductCount, CAST(sum(ReferenceDrug) AS BIGINT) AS ReferenceCount
        FROM products GROUP BY ApplNo)
SELECT s.*, coalesce(p.ProductCount, 0) AS ProductCount, coalesce(p.ReferenceCount, 0) AS ReferenceCount,
       coalesce(WithdrawalCount::DOUBLE / nullif(TotalSubmissions, 0), 0.0) AS WithdrawalRate,
       coalesce(PriorityCount::DOUBLE / nullif(TotalSubmissions, 0), 0.0) AS PriorityRate
FROM s LEFT JOIN p ON s.ApplNo = p.ApplNo
""")
def m25_features(spark, d):
    prods, subs = roles(spark, d, "products", "submissions")
    return P.anomaly_features(subs, prods)
