"""Rank statistics, measurements, curves and row signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import arrays as A
from auditloom.functions import stats
from auditloom.operators import audit, curves, measure, models, split
from auditloom.queries.base import EPS, MANY, MARGIN, OBS, PRED, REG, VARIANTS, entropy, own, query, with_
from auditloom.sources import fixtures as fx

SCORED = "scored AS (SELECT dataset_id, row_id, round(p2, 3) AS s, CASE WHEN y = 2 THEN 1 ELSE 0 END AS lab FROM pred)"
AUC = "SELECT {k}, sum(CASE WHEN lab = 1 THEN r ELSE 0 END) AS rs, sum(lab) AS n1, count(*) - sum(lab) AS n0 FROM (SELECT {k}, lab, rank() OVER (PARTITION BY {k} ORDER BY {s}) + (count(*) OVER (PARTITION BY {k}, {s}) - 1) / 2e0 AS r FROM {t}) GROUP BY {k}"
ROC = """pts AS (SELECT dataset_id, s, sum(lab) AS pos, sum(1 - lab) AS neg FROM scored GROUP BY dataset_id, s),
  roc AS (SELECT dataset_id, s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER w / CAST(sum(pos) OVER (PARTITION BY dataset_id) AS DOUBLE) AS tpr,
  sum(neg) OVER w / CAST(sum(neg) OVER (PARTITION BY dataset_id) AS DOUBLE) AS fpr FROM pts WINDOW w AS (PARTITION BY dataset_id ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def scored(spark, sf):
    return fx.predictions(spark, sf).select("dataset_id", "row_id", F.round(F.get("probs", F.lit(2)), 3).alias("s"), F.when(F.col("y") == 2, 1).otherwise(0).alias("lab"))


@query("auc_by_signal", "dataset_id:l n_pos:l n_neg:l auc:d", with_(OBS, PRED, SCORED) + f"SELECT dataset_id, n1 AS n_pos, n0 AS n_neg, (rs - n1 * (n1 + 1) / 2e0) / (n1 * n0) AS auc FROM ({AUC.format(k='dataset_id', s='s', t='scored')})")
def auc_by_signal(spark, sf):
    return stats.auc(scored(spark, sf), ["dataset_id"], "s", "lab")


@query("auc_single_signal", "auc:d flipped:d", "labels_ AS (SELECT d.n_chars AS s, l.toxic AS lab, 1 AS g FROM documents d JOIN labels l ON d.doc_id = l.doc_id)" + " :: " + f"SELECT a AS auc, greatest(a, 1 - a) AS flipped FROM (SELECT (rs - n1 * (n1 + 1) / 2e0) / (n1 * n0) AS a FROM ({AUC.format(k='g', s='s', t='labels_')}))")
def auc_single_signal(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", "n_chars").join(fx.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").withColumn("g", F.lit(1))
    return stats.auc(rows, ["g"], "n_chars", "toxic").withColumn("flipped", F.greatest("auc", 1 - F.col("auc")))


@query("roc_curve", "dataset_id:l s:d tp:l fp:l tpr:d fpr:d", with_(OBS, PRED, SCORED, ROC) + "SELECT * FROM roc")
def roc_curve(spark, sf):
    return stats.roc(scored(spark, sf), ["dataset_id"], "s", "lab")


@query("tpr_at_fpr", "dataset_id:l tpr_at:d", with_(OBS, PRED, SCORED, ROC, "steps AS (SELECT dataset_id, tpr, fpr, coalesce(lag(tpr) OVER (PARTITION BY dataset_id ORDER BY fpr, tpr), 0e0) AS t0, coalesce(lag(fpr) OVER (PARTITION BY dataset_id ORDER BY fpr, tpr), 0e0) AS f0 FROM roc)") + "SELECT dataset_id, coalesce(max(CASE WHEN f0 <= 0.1e0 AND fpr > 0.1e0 THEN t0 + (tpr - t0) * (0.1e0 - f0) / (fpr - f0) END), max(CASE WHEN fpr <= 0.1e0 THEN tpr END)) AS tpr_at FROM steps GROUP BY dataset_id")
def tpr_at_fpr(spark, sf):
    return stats.tpr_at_fpr(scored(spark, sf), ["dataset_id"], "s", "lab", 0.1)


@query("average_precision", "dataset_id:l average_precision:d", with_(OBS, PRED, SCORED, ROC) + "SELECT dataset_id, sum(g * tp / CAST(tp + fp AS DOUBLE)) AS average_precision FROM (SELECT dataset_id, tp, fp, tpr - coalesce(lag(tpr) OVER (PARTITION BY dataset_id ORDER BY s DESC), 0e0) AS g FROM roc) GROUP BY dataset_id")
def average_precision(spark, sf):
    return stats.average_precision(scored(spark, sf), ["dataset_id"], "s", "lab")


@query("confusion_metrics", "dataset_id:l tp:l fp:l tn:l fn:l accuracy:d precision:d recall:d f1:d", with_(OBS, PRED, SCORED, "c AS (SELECT dataset_id, count(*) FILTER (WHERE s >= 0.5 AND lab = 1) AS tp, count(*) FILTER (WHERE s >= 0.5 AND lab = 0) AS fp, count(*) FILTER (WHERE s < 0.5 AND lab = 0) AS tn, count(*) FILTER (WHERE s < 0.5 AND lab = 1) AS fn FROM scored GROUP BY dataset_id)") + 'SELECT dataset_id, tp, fp, tn, fn, (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1 FROM c')
def confusion_metrics(spark, sf):
    return stats.confusion(scored(spark, sf), ["dataset_id"], "s", "lab")


@query("spearman_pairs", "dataset_id:l spearman:d", with_(OBS) + "SELECT dataset_id, corr(ra, rb) AS spearman FROM (SELECT dataset_id, rank() OVER (PARTITION BY dataset_id ORDER BY x0) + (count(*) OVER (PARTITION BY dataset_id, x0) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY dataset_id ORDER BY x1) + (count(*) OVER (PARTITION BY dataset_id, x1) - 1) / 2e0 AS rb FROM obs) GROUP BY dataset_id")
def spearman_pairs(spark, sf):
    return stats.spearman(fx.observations(spark, sf).select("dataset_id", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b")), ["dataset_id"], "a", "b")


@query("conformal_pvalues", "dataset_id:l row_id:l p_value:d", with_(OBS, PRED, SCORED, "cal AS (SELECT dataset_id, s FROM scored WHERE lab = 0)", "n AS (SELECT dataset_id, count(*) AS n FROM cal GROUP BY dataset_id)") + "SELECT t.dataset_id, t.row_id, (1 + (SELECT count(*) FROM cal c WHERE c.dataset_id = t.dataset_id AND c.s >= t.s)) / (n.n + 1e0) AS p_value FROM scored t JOIN n ON n.dataset_id = t.dataset_id WHERE t.lab = 1")
def conformal_pvalues(spark, sf):
    rows = scored(spark, sf)
    return stats.conformal(rows.where("lab = 0"), rows.where("lab = 1"), ["dataset_id"], "s")


@query("multiclass_metrics", "dataset_id:l balanced_accuracy:d ovr_auc:d", with_(OBS, PRED, "lng AS (SELECT dataset_id, 0 AS k, p0 AS p, y FROM pred UNION ALL SELECT dataset_id, 1, p1, y FROM pred UNION ALL SELECT dataset_id, 2, p2, y FROM pred)", "own_ AS (SELECT dataset_id * 3 + k AS g, p AS s, CASE WHEN y = k THEN 1 ELSE 0 END AS lab FROM lng)") + f"SELECT a.dataset_id, balanced_accuracy, ovr_auc FROM (SELECT dataset_id, avg(r) AS balanced_accuracy FROM (SELECT dataset_id, y, avg(CASE WHEN pred = y THEN 1e0 ELSE 0e0 END) AS r FROM pred GROUP BY dataset_id, y) GROUP BY dataset_id) a JOIN (SELECT g // 3 AS dataset_id, avg((rs - n1 * (n1 + 1) / 2e0) / (n1 * n0)) AS ovr_auc FROM ({AUC.format(k='g', s='s', t='own_')}) GROUP BY g // 3) b ON a.dataset_id = b.dataset_id")
def multiclass_metrics(spark, sf):
    return stats.multiclass(fx.predictions(spark, sf), ["dataset_id"], "probs", "pred", "y", 3)


@query("seed_summary", "variant:l mean:d sd:d lo:d hi:d", with_(OBS, MANY, VARIANTS) + "SELECT variant, avg(a) AS mean, stddev_samp(a) AS sd, min(a) AS lo, max(a) AS hi FROM (SELECT variant, dataset_id, avg(CASE WHEN pred = y THEN 1e0 ELSE 0e0 END) AS a FROM var GROUP BY variant, dataset_id) GROUP BY variant")
def seed_summary(spark, sf):
    per = fx.variants(spark, sf).groupBy("variant", "dataset_id").agg(F.avg(F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0)).alias("a"))
    return stats.summary(per, ["variant"], "a")


@query("meas_classification", "dataset_id:l accuracy:d max_confidence:d correct_confidence:d entropy:d loss:d prediction_margin:d", with_(OBS, PRED) + f"SELECT dataset_id, avg(CASE WHEN pred = y THEN 1e0 ELSE 0e0 END) AS accuracy, avg(greatest(p0, p1, p2)) AS max_confidence, avg({own()}) AS correct_confidence, avg({entropy()}) AS entropy, -avg(ln({own()} + {EPS})) AS loss, avg({MARGIN}) AS prediction_margin FROM pred GROUP BY dataset_id")
def meas_classification(spark, sf):
    return measure.classification(fx.predictions(spark, sf), ["dataset_id"])


@query("meas_chi_squared", "dataset_id:l chi_squared:d", with_(OBS, PRED, "b AS (SELECT dataset_id, pred AS k, 1e0 AS o, 0e0 AS e FROM pred UNION ALL SELECT dataset_id, y, 0e0, 1e0 FROM pred)", "per AS (SELECT dataset_id, k, sum(o) AS o, sum(e) AS e FROM b GROUP BY dataset_id, k)") + f"SELECT dataset_id, CASE WHEN count(*) >= 2 THEN sum(pow(o - greatest(e, {EPS}), 2) / greatest(e, {EPS})) / sum(e) END AS chi_squared FROM per GROUP BY dataset_id")
def meas_chi_squared(spark, sf):
    return measure.chi_squared(fx.predictions(spark, sf), ["dataset_id"])


@query("meas_kl", "dataset_id:l kl_divergence:d", with_(OBS, PRED, "m AS (SELECT dataset_id, unnest([0, 1, 2]) AS k, unnest([avg(CASE WHEN y = 0 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN y = 1 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN y = 2 THEN 1e0 ELSE 0e0 END)]) AS p, unnest([avg(p0), avg(p1), avg(p2)]) AS q FROM pred GROUP BY dataset_id)", f"n AS (SELECT dataset_id, (p + {EPS}) / sum(p + {EPS}) OVER (PARTITION BY dataset_id) AS p, (q + {EPS}) / sum(q + {EPS}) OVER (PARTITION BY dataset_id) AS q FROM m)") + "SELECT dataset_id, sum(p * ln(p / q)) AS kl_divergence FROM n GROUP BY dataset_id")
def meas_kl(spark, sf):
    return measure.kl_divergence(fx.predictions(spark, sf), ["dataset_id"])


WASSERSTEIN = """per AS (SELECT dataset_id, v, sum(na) AS na, sum(nb) AS nb FROM b GROUP BY dataset_id, v),
  g AS (SELECT dataset_id, lead(v) OVER w - v AS gap, sum(na) OVER w / CAST(sum(na) OVER (PARTITION BY dataset_id) AS DOUBLE) AS fa, sum(nb) OVER w / CAST(sum(nb) OVER (PARTITION BY dataset_id) AS DOUBLE) AS fb FROM per WINDOW w AS (PARTITION BY dataset_id ORDER BY v))"""


@query("meas_wasserstein", "dataset_id:l wasserstein:d", with_(OBS, PRED, "b AS (SELECT dataset_id, CAST(pred AS DOUBLE) AS v, 1 AS na, 0 AS nb FROM pred UNION ALL SELECT dataset_id, CAST(y AS DOUBLE), 0, 1 FROM pred)", WASSERSTEIN) + "SELECT dataset_id, coalesce(sum(gap * abs(fa - fb)), 0) AS wasserstein FROM g GROUP BY dataset_id")
def meas_wasserstein(spark, sf):
    return measure.wasserstein(fx.predictions(spark, sf), ["dataset_id"], "pred", "y")


@query("meas_wasserstein_regression", "dataset_id:l wasserstein:d", with_(OBS, REG, "b AS (SELECT dataset_id, pred AS v, 1 AS na, 0 AS nb FROM reg UNION ALL SELECT dataset_id, y, 0, 1 FROM reg)", WASSERSTEIN) + "SELECT dataset_id, coalesce(sum(gap * abs(fa - fb)), 0) AS wasserstein FROM g GROUP BY dataset_id")
def meas_wasserstein_regression(spark, sf):
    return measure.wasserstein(fx.regressions(spark, sf), ["dataset_id"], "pred", "y")


LOGITS = "lg AS (SELECT dataset_id, y, ln(p0) AS p0, ln(p1) AS p1, ln(p2) AS p2 FROM pred)"


@query("meas_logits", "dataset_id:l logit_margin:d logit_magnitude:d logit_kurtosis:d", with_(OBS, PRED, LOGITS, "f AS (SELECT dataset_id, p0 AS v FROM lg UNION ALL SELECT dataset_id, p1 FROM lg UNION ALL SELECT dataset_id, p2 FROM lg)") + f"SELECT a.dataset_id, logit_margin, logit_magnitude, logit_kurtosis FROM (SELECT dataset_id, avg({MARGIN}) AS logit_margin, avg(sqrt(p0 * p0 + p1 * p1 + p2 * p2)) AS logit_magnitude FROM lg GROUP BY dataset_id) a JOIN (SELECT dataset_id, kurtosis_pop(v) AS logit_kurtosis FROM f GROUP BY dataset_id) b ON a.dataset_id = b.dataset_id")
def meas_logits(spark, sf):
    return measure.logits(fx.predictions(spark, sf).withColumn("logits", F.transform("probs", lambda v: F.log(v))), ["dataset_id"])


@query("meas_regression", "dataset_id:l neg_mse:d r2:d residual_kurtosis:d residual_skewness:d pred_spread:d", with_(OBS, REG, "r AS (SELECT dataset_id, y, pred, y - pred AS r FROM reg)", "m AS (SELECT dataset_id, avg(r) AS m FROM r GROUP BY dataset_id)") + f"SELECT r.dataset_id, -avg(r.r * r.r) / 1e6 AS neg_mse, 1 - sum(r.r * r.r) / (var_pop(y) * count(*)) AS r2, kurtosis_pop(r.r) AS residual_kurtosis, avg(pow(r.r - m.m, 3)) / pow(stddev_pop(r.r), 3) AS residual_skewness, stddev_pop(pred) / (stddev_pop(y) + {EPS}) AS pred_spread FROM r JOIN m ON r.dataset_id = m.dataset_id GROUP BY r.dataset_id")
def meas_regression(spark, sf):
    return measure.regression(fx.regressions(spark, sf), ["dataset_id"]).withColumn("neg_mse", F.col("neg_mse") / 1e6)


@query("meas_reg_hist", "dataset_id:l chi_squared:d", with_(OBS, REG, "b AS (SELECT dataset_id, pred AS v, 1e0 AS o, 0e0 AS e FROM reg UNION ALL SELECT dataset_id, y, 0e0, 1e0 FROM reg)", "s AS (SELECT dataset_id, min(v) AS lo, max(v) AS hi FROM b GROUP BY dataset_id)", "h AS (SELECT b.dataset_id, least(floor((v - lo) / ((hi - lo) / 30)), 29) AS bin, sum(o) AS o, sum(e) AS e FROM b JOIN s ON b.dataset_id = s.dataset_id GROUP BY 1, 2)") + f"SELECT dataset_id, sum(pow(o - greatest(e, {EPS}), 2) / greatest(e, {EPS})) / sum(e) / 1e9 AS chi_squared FROM h GROUP BY dataset_id")
def meas_reg_hist(spark, sf):
    return measure.regression_chi_squared(fx.regressions(spark, sf), ["dataset_id"]).withColumn("chi_squared", F.col("chi_squared") / 1e9)


@query("meas_reg_kde", "dataset_id:l kl_divergence:d", with_(OBS, REG, "st AS (SELECT dataset_id, stddev_samp(y) * pow(count(*), -0.2e0) AS hy, stddev_samp(pred) * pow(count(*), -0.2e0) AS hp, least(min(y), min(pred)) AS lo, greatest(max(y), max(pred)) AS hi FROM reg GROUP BY dataset_id)", "gr AS (SELECT st.*, i, lo + (hi - lo) * i / 499e0 AS g FROM st, (SELECT unnest(generate_series(0, 499)) AS i) AS s)", f"de AS (SELECT gr.dataset_id, i, any_value(g) AS g, avg(exp(-0.5e0 * pow((g - y) / hy, 2)) / (hy * 2.5066282746310002e0)) + {EPS} AS p, avg(exp(-0.5e0 * pow((g - pred) / hp, 2)) / (hp * 2.5066282746310002e0)) + {EPS} AS q FROM gr JOIN reg ON gr.dataset_id = reg.dataset_id GROUP BY gr.dataset_id, i)", "ar AS (SELECT *, (p + lag(p) OVER w) / 2 * (g - lag(g) OVER w) AS ap, (q + lag(q) OVER w) / 2 * (g - lag(g) OVER w) AS aq FROM de WINDOW w AS (PARTITION BY dataset_id ORDER BY i))", "sc AS (SELECT dataset_id, i, g, p / sum(ap) OVER (PARTITION BY dataset_id) AS p, q / sum(aq) OVER (PARTITION BY dataset_id) AS q FROM ar)", "fs AS (SELECT dataset_id, i, g, p * ln(p / q) AS f FROM sc)") + "SELECT dataset_id, greatest(sum(a), 0) AS kl_divergence FROM (SELECT dataset_id, (f + lag(f) OVER w) / 2 * (g - lag(g) OVER w) AS a FROM fs WINDOW w AS (PARTITION BY dataset_id ORDER BY i)) GROUP BY dataset_id")
def meas_reg_kde(spark, sf):
    return measure.kde_divergence(fx.regressions(spark, sf), ["dataset_id"])


def _kl(a: str, b: str) -> str:
    return " + ".join(f"{a}.p{c} * ln(({a}.p{c} + {EPS}) / ({b}.p{c} + {EPS}))" for c in range(3))


@query("kl_to_clean", "dataset_id:l variant:l kl2clean:d rkl2clean:d", with_(OBS, MANY, VARIANTS) + f"SELECT a.dataset_id, a.variant, avg({_kl('a', 'b')}) AS kl2clean, avg({_kl('b', 'a')}) AS rkl2clean FROM var a JOIN var b ON a.dataset_id = b.dataset_id AND a.row_id = b.row_id AND b.variant = 0 GROUP BY a.dataset_id, a.variant")
def kl_to_clean(spark, sf):
    v = fx.variants(spark, sf)
    return measure.kl_to_clean(v, v.where("variant = 0"), ["dataset_id", "variant"], ["dataset_id", "row_id"])


@query("mse_to_clean", "dataset_id:l kl2clean:d", with_(OBS, REG) + "SELECT dataset_id, sqrt(avg(pow(pred - y, 2))) AS kl2clean FROM reg GROUP BY dataset_id")
def mse_to_clean(spark, sf):
    r = fx.regressions(spark, sf)
    return measure.mse_to_clean(r, r.select("dataset_id", "row_id", F.col("y").alias("pred")), ["dataset_id"], ["dataset_id", "row_id"]).withColumn("kl2clean", F.sqrt("kl2clean"))


POINTS = "pt AS (SELECT dataset_id, variant, pow(2, variant) AS intensity, avg(greatest(p0, p1, p2)) AS value FROM var GROUP BY dataset_id, variant)"


def points(spark, sf):
    return fx.variants(spark, sf).groupBy("dataset_id", "variant").agg(F.avg(F.array_max("probs")).alias("value")).withColumn("intensity", F.pow(F.lit(2.0), F.col("variant")))


@query("curve_trajectory", "dataset_id:l slope:d auc:d gain:d early:d late_gain:d", with_(OBS, MANY, VARIANTS, POINTS, "l AS (SELECT dataset_id, log2(intensity) AS x, value AS v, variant AS i FROM pt)", "st AS (SELECT *, (v + lag(v) OVER w) / 2 * (x - lag(x) OVER w) AS a FROM l WINDOW w AS (PARTITION BY dataset_id ORDER BY i))") + "SELECT dataset_id, regr_slope(v, x) AS slope, sum(a) / (max(x) - min(x)) AS auc, arg_max(v, i) - arg_min(v, i) AS gain, max(CASE WHEN i = 1 THEN v END) / max(abs(v)) AS early, max(CASE WHEN i = 4 THEN v END) - max(CASE WHEN i = 3 THEN v END) AS late_gain FROM st GROUP BY dataset_id")
def curve_trajectory(spark, sf):
    return curves.trajectory(points(spark, sf), ["dataset_id"])


@query("curve_aggregate", "dataset_id:l std:d range:d mean:d", with_(OBS, MANY, VARIANTS, POINTS) + "SELECT dataset_id, stddev_pop(value) AS std, max(value) - min(value) AS range, avg(value) AS mean FROM pt GROUP BY dataset_id")
def curve_aggregate(spark, sf):
    return curves.aggregate(points(spark, sf), ["dataset_id"])


@query("curve_legacy", "dataset_id:l slope:d gain:d late_gain:d early:d early_ratio:d", with_(OBS, MANY, VARIANTS, POINTS) + "SELECT dataset_id, regr_slope(value, log2(intensity)) AS slope, arg_max(value, variant) - arg_min(value, variant) AS gain, max(CASE WHEN variant = 4 THEN value END) - max(CASE WHEN variant = 3 THEN value END) AS late_gain, max(CASE WHEN variant = 4 THEN value END) AS early, max(CASE WHEN variant = 4 THEN value END) / max(value) AS early_ratio FROM pt GROUP BY dataset_id")
def curve_legacy(spark, sf):
    return curves.legacy(points(spark, sf), ["dataset_id"], early_at=16)


@query("curve_consistency", "dataset_id:l agreement:d steadiness:d", with_(OBS, MANY, VARIANTS, "pr AS (SELECT a.dataset_id, a.row_id, avg(CASE WHEN a.pred = b.pred THEN 1e0 ELSE 0e0 END) AS g FROM var a JOIN var b ON a.dataset_id = b.dataset_id AND a.row_id = b.row_id AND a.variant < b.variant GROUP BY a.dataset_id, a.row_id)", "sd AS (SELECT dataset_id, row_id, var_pop(pred) AS v FROM var GROUP BY dataset_id, row_id)") + "SELECT a.dataset_id, agreement, steadiness FROM (SELECT dataset_id, avg(g) AS agreement FROM pr GROUP BY dataset_id) a JOIN (SELECT dataset_id, 1 - avg(v) AS steadiness FROM sd GROUP BY dataset_id) b ON a.dataset_id = b.dataset_id")
def curve_consistency(spark, sf):
    v = fx.variants(spark, sf)
    return curves.pair_agreement(v, ["dataset_id"]).join(curves.steadiness(v, ["dataset_id"]), "dataset_id")


@query("mean_spearman", "dataset_id:l mean_spearman:d", with_(OBS, MANY, VARIANTS, "rk AS (SELECT dataset_id, row_id, variant, rank() OVER (PARTITION BY dataset_id, variant ORDER BY p0) AS r FROM var)") + "SELECT dataset_id, avg(c) AS mean_spearman FROM (SELECT a.dataset_id, a.variant AS va, b.variant AS vb, corr(a.r, b.r) AS c FROM rk a JOIN rk b ON a.dataset_id = b.dataset_id AND a.row_id = b.row_id AND a.variant < b.variant GROUP BY 1, 2, 3) GROUP BY dataset_id")
def mean_spearman(spark, sf):
    return curves.pairwise_spearman(fx.variants(spark, sf).withColumn("p0", F.get("probs", F.lit(0))), ["dataset_id"], "row_id", "variant", "p0")


CLIPPED = "-(" + " + ".join(f"greatest(p{c}, {EPS}) * ln(greatest(p{c}, {EPS}))" for c in range(3)) + ")"


@query("row_signals", "dataset_id:l row_id:l max_confidence:d margin:d entropy:d confidence:d loss:d correct:d", with_(OBS, PRED) + f"SELECT dataset_id, row_id, greatest(p0, p1, p2) AS max_confidence, {MARGIN} AS margin, {CLIPPED} AS entropy, {own()} AS confidence, -ln(greatest({own()}, {EPS})) AS loss, CASE WHEN pred = y THEN 1e0 ELSE 0e0 END AS correct FROM pred")
def row_signals(spark, sf):
    return curves.row_features(fx.predictions(spark, sf))


@query("row_regression_signals", "dataset_id:l row_id:l residual:d abs_residual:d", with_(OBS, REG) + "SELECT dataset_id, row_id, y - pred AS residual, abs(y - pred) AS abs_residual FROM reg")
def row_regression_signals(spark, sf):
    return curves.row_regression_features(fx.regressions(spark, sf))


@query("row_variants", "dataset_id:l row_id:l mean:d std:d range:d slope:d", with_(OBS, MANY, VARIANTS, "c AS (SELECT dataset_id, row_id, variant AS x, greatest(p0, p1, p2) AS v FROM var)") + "SELECT dataset_id, row_id, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS range, regr_slope(v, x) AS slope FROM c GROUP BY dataset_id, row_id")
def row_variants(spark, sf):
    return curves.row_variants(fx.variants(spark, sf).withColumn("v", F.array_max("probs")), ["dataset_id", "row_id"], "v", "variant")


@query("row_agreement", "dataset_id:l row_id:l agreement:d", with_(OBS, MANY, VARIANTS) + "SELECT dataset_id, row_id, max(c) / 5e0 AS agreement FROM (SELECT dataset_id, row_id, pred, count(*) AS c FROM var GROUP BY dataset_id, row_id, pred) GROUP BY dataset_id, row_id")
def row_agreement(spark, sf):
    return curves.modal_share(fx.variants(spark, sf), ["dataset_id", "row_id"])


@query("split_averages", "dataset_id:l mean:d split_std:d", with_(OBS, MANY, VARIANTS, POINTS) + "SELECT dataset_id, avg(value) AS mean, stddev_pop(value) AS split_std FROM pt GROUP BY dataset_id")
def split_averages(spark, sf):
    return split.averaged(points(spark, sf), ["dataset_id"], "value")


@query("elbow_k", "dataset_id:l k_star:l", with_(OBS, MANY, VARIANTS, POINTS, "e AS (SELECT dataset_id, variant, round(intensity) AS k, value, variant / 4e0 AS x, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS y FROM pt WINDOW w AS (PARTITION BY dataset_id))", "f AS (SELECT *, first_value(y) OVER (PARTITION BY dataset_id ORDER BY variant) AS y0, first_value(y) OVER (PARTITION BY dataset_id ORDER BY variant DESC) AS y1 FROM e)", "h AS (SELECT dataset_id, k, row_number() OVER (PARTITION BY dataset_id ORDER BY round(y - (y0 + (y1 - y0) * x), 12) DESC, k) AS r FROM f)") + "SELECT dataset_id, k AS k_star FROM h WHERE r = 1")
def elbow_k(spark, sf):
    return models.elbow_table(points(spark, sf).withColumn("k", F.round("intensity").cast("long")), ["dataset_id"])


@query("temperature_scale", "dataset_id:l row_id:l q0:d q1:d q2:d", with_(OBS, PRED) + "SELECT dataset_id, row_id, pow(p0, 2) / (pow(p0, 2) + pow(p1, 2) + pow(p2, 2)) AS q0, pow(p1, 2) / (pow(p0, 2) + pow(p1, 2) + pow(p2, 2)) AS q1, pow(p2, 2) / (pow(p0, 2) + pow(p1, 2) + pow(p2, 2)) AS q2 FROM pred")
def temperature_scale(spark, sf):
    p = fx.predictions(spark, sf).withColumn("q", A.softened(F.col("probs"), 0.5))
    return p.select("dataset_id", "row_id", *[F.get("q", F.lit(c)).alias(f"q{c}") for c in range(3)])


@query("column_screen", "signal:s separation:d", with_(OBS, "lng AS (SELECT dataset_id, row_id, j, v, CASE WHEN dataset_id % 2 = 1 THEN 1 ELSE 0 END AS lab FROM (SELECT dataset_id, row_id, unnest(['x0', 'x1', 'x2', 'x3']) AS j, unnest([x0, x1, x2, x3]) AS v FROM obs))") + f"SELECT j AS signal, abs((rs - n1 * (n1 + 1) / 2e0) / (n1 * n0) - 0.5e0) AS separation FROM ({AUC.format(k='j', s='v', t='lng')})")
def column_screen(spark, sf):
    long = fx.observations(spark, sf).select(F.when(F.col("dataset_id") % 2 == 1, 1).otherwise(0).alias("suspect"), F.posexplode("x").alias("j", "value")).withColumn("signal", F.concat(F.lit("x"), F.col("j")))
    return audit.separation(long, ["signal"], "value", "suspect")


MEANS = "mn AS (SELECT dataset_id, signal, v FROM (SELECT dataset_id, unnest(['x0', 'x1', 'x2', 'x3']) AS signal, unnest([avg(x0), avg(x1), avg(x2), avg(x3)]) AS v FROM obs GROUP BY dataset_id))"
HALVES = "hv AS (SELECT dataset_id, rep, CASE WHEN row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws('|', 'half', CAST(rep AS VARCHAR), '1', CAST(dataset_id AS VARCHAR))), dataset_id) <= floor(count(*) OVER (PARTITION BY rep) / 2e0) THEN 1 ELSE 0 END AS lab FROM (SELECT DISTINCT dataset_id FROM obs), (SELECT unnest(generate_series(0, 39)) AS rep) AS s)"


def means(spark, sf):
    """``dataset_id, signal, value``: feature means, each added up in the order of the stored rows."""
    columns = {"x0": "l_quantity", "x1": "l_extendedprice", "x2": "l_discount", "x3": "l_tax"}
    stored = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")]
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("dataset_id"), *stored, *[F.col(c).alias(n) for n, c in columns.items()])
    each = stats.ordered_mean(rows, ["dataset_id"], ["file", "place"], list(columns))
    return each.select("dataset_id", F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in columns])).alias("m")).select("dataset_id", "m.*")


@query("null_floor", "signal:s floor:d", with_(OBS, MEANS, HALVES, "jn AS (SELECT hv.rep || '|' || signal AS g, round(v, 9) AS v, lab FROM mn JOIN hv ON mn.dataset_id = hv.dataset_id)", f"sp AS (SELECT split_part(g, '|', 2) AS signal, abs((rs - n1 * (n1 + 1) / 2e0) / (n1 * n0) - 0.5e0) AS s FROM ({AUC.format(k='g', s='v', t='jn')}))") + "SELECT signal, quantile_cont(s, 0.95e0) AS floor FROM sp GROUP BY signal")
def null_floor(spark, sf):
    return audit.null_floor(means(spark, sf).withColumn("value", F.round("value", 9)))


@query("half_splits", "rep:l dataset_id:l half:l", with_(OBS, HALVES) + "SELECT rep, dataset_id, lab AS half FROM hv")
def half_splits(spark, sf):
    return split.half_splits(fx.observations(spark, sf).select("dataset_id").distinct().withColumn("all", F.lit(1)), ["all"], 40, "dataset_id")


@query("engineered_features", "signal:s dataset_id:l log:d over:d rank:d", with_(OBS, MEANS, "st AS (SELECT signal, count(*) AS n, kurtosis_pop(v) AS k, quantile_cont(v, 0.9e0) AS p FROM mn GROUP BY signal)") + "SELECT mn.signal, dataset_id, CASE WHEN k > 5 THEN sign(v) * ln(1 + abs(v)) END AS log, CASE WHEN stddev_pop(CASE WHEN v > p THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY mn.signal) > 0.05 THEN CASE WHEN v > p THEN 1e0 ELSE 0e0 END END AS over, (rank() OVER (PARTITION BY mn.signal ORDER BY v) + (count(*) OVER (PARTITION BY mn.signal, v) - 1) / 2e0) / n AS rank FROM mn JOIN st ON mn.signal = st.signal WHERE n >= 10")
def engineered_features(spark, sf):
    return audit.engineered(means(spark, sf))


@query("usable_signals", "signal:s", with_(OBS, MEANS) + "SELECT signal FROM mn GROUP BY signal HAVING stddev_pop(v) > 0")
def usable_signals(spark, sf):
    return audit.usable(means(spark, sf).withColumn("xt", F.col("value")).withColumn("xb", F.lit(0.0)))


