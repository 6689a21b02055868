"""Predictors, plans, signals, sinks, audits and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from auditloom.functions import stats
from auditloom.operators import audit, manip, models, predict, profile, signals, split
from auditloom.operators.measure import classification
from auditloom.plans import sweeps
from auditloom.queries.base import EPS, MANY, OBS, PRED, ROLES, VARIANTS, entropy, leaning, own, query, uniform, with_
from auditloom.queries.preparation import VECTORS
from auditloom.sinks import writers
from auditloom.sources import fixtures as fx
from auditloom.streaming import incremental

CLASSES = 10


def parts(spark, sf):
    rows = manip.with_roles(fx.vectors(spark, sf))
    return rows.where("role = 'context'").drop("role"), rows.where("role = 'query'").drop("role")


KNN = VECTORS + ", nb AS (SELECT q.row_id, q.y, c.row_id AS nid, c.y AS ny, list_distance(q.x, c.x) AS d, row_number() OVER (PARTITION BY q.row_id ORDER BY list_distance(q.x, c.x), c.row_id) AS r FROM roles q JOIN roles c ON q.dataset_id = c.dataset_id WHERE q.role = 'query' AND c.role = 'context')"
SHARES = KNN + ", wt AS (SELECT row_id, y, ny, sum(1 / (d + 1e-9)) AS w FROM nb WHERE r <= 5 GROUP BY 1, 2, 3), pr AS (SELECT k.row_id, k.y, k.k, coalesce(w, 0) / sum(coalesce(w, 0)) OVER (PARTITION BY k.row_id) AS p FROM (SELECT DISTINCT row_id, y, unnest(generate_series(0, 9)) AS k FROM nb) k LEFT JOIN wt ON wt.row_id = k.row_id AND wt.ny = k.k)"
ROWWISE = "rw AS (SELECT row_id, y, max(p) AS top, arg_max(p, p * 1000 - k * 1e-9) AS _, max(CASE WHEN k = y THEN p END) AS own, -sum(p * ln(p + 1e-10)) AS h, first(k ORDER BY p DESC, k) AS pred, list_reverse_sort(list(p)) AS ps FROM pr GROUP BY 1, 2)"


@query("knn_retrieval", "row_id:l nid:l rank:l d:d", KNN + " :: SELECT row_id, nid, r AS rank, d FROM nb WHERE r <= 5")
def knn_retrieval(spark, sf):
    return predict.neighbours(*parts(spark, sf), 5)


@query("knn_predict", "row_id:l pred:l own:d entropy:d", SHARES + ", " + ROWWISE.replace("arg_max(p, p * 1000 - k * 1e-9) AS _, ", "") + " :: SELECT row_id, pred, own, h AS entropy FROM rw")
def knn_predict(spark, sf):
    from auditloom.functions import arrays as A

    return predict.knn(*parts(spark, sf), CLASSES).select("row_id", "pred", F.get("probs", "y").alias("own"), A.entropy(F.col("probs")).alias("entropy"))


@query("base_signals", "accuracy:d max_confidence:d correct_confidence:d entropy:d loss:d prediction_margin:d", SHARES + ", " + ROWWISE.replace("arg_max(p, p * 1000 - k * 1e-9) AS _, ", "") + f" :: SELECT avg(CASE WHEN pred = y THEN 1e0 ELSE 0e0 END) AS accuracy, avg(top) AS max_confidence, avg(own) AS correct_confidence, avg(h) AS entropy, -avg(ln(own + {EPS})) AS loss, avg(ps[1] - ps[2]) AS prediction_margin FROM rw")
def base_signals(spark, sf):
    return classification(predict.knn(*parts(spark, sf), CLASSES), ["dataset_id"])


@query("prior_predict", "dataset_id:l row_id:l p0:d p1:d p2:d pred:l", with_(OBS, ROLES, "pr AS (SELECT dataset_id, avg(CASE WHEN y = 0 THEN 1e0 ELSE 0e0 END) AS p0, avg(CASE WHEN y = 1 THEN 1e0 ELSE 0e0 END) AS p1, avg(CASE WHEN y = 2 THEN 1e0 ELSE 0e0 END) AS p2 FROM roles WHERE role = 'context' GROUP BY 1)") + "SELECT r.dataset_id, row_id, p0, p1, p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM roles r JOIN pr ON r.dataset_id = pr.dataset_id WHERE role = 'query'")
def prior_predict(spark, sf):
    rows = manip.with_roles(fx.observations(spark, sf))
    p = predict.class_prior(rows.where("role = 'context'"), rows.where("role = 'query'"), 3)
    return p.select("dataset_id", "row_id", "pred", *[F.get("probs", F.lit(c)).alias(f"p{c}") for c in range(3)])


LONG = "cx AS (SELECT dataset_id, y, unnest([0, 1, 2, 3]) AS j, unnest([x0, x1, x2, x3]) AS v FROM roles WHERE role = 'context'), qx AS (SELECT dataset_id, row_id, unnest([0, 1, 2, 3]) AS j, unnest([x0, x1, x2, x3]) AS q FROM roles WHERE role = 'query')"


@query("naive_bayes_predict", "dataset_id:l row_id:l p0:d p1:d p2:d", with_(OBS, ROLES, LONG, "ep AS (SELECT dataset_id, max(v) * 1e-9 + 1e-12 AS eps FROM (SELECT dataset_id, j, var_pop(v) AS v FROM cx GROUP BY 1, 2) GROUP BY 1)", "st AS (SELECT dataset_id, y, j, avg(v) AS m, var_pop(v) AS s FROM cx GROUP BY 1, 2, 3)", "pi AS (SELECT dataset_id, y, ln(c / CAST(sum(c) OVER (PARTITION BY dataset_id) AS DOUBLE)) AS lp FROM (SELECT dataset_id, y, count(*) AS c FROM roles WHERE role = 'context' GROUP BY 1, 2))", "ll AS (SELECT qx.dataset_id, row_id, st.y, sum(-0.5e0 * (ln(6.283185307179586e0 * (s + eps)) + pow(q - m, 2) / (s + eps))) AS l FROM qx JOIN st ON qx.dataset_id = st.dataset_id AND qx.j = st.j JOIN ep ON ep.dataset_id = qx.dataset_id GROUP BY 1, 2, 3)", "ex AS (SELECT ll.dataset_id, row_id, ll.y, exp(l + lp - max(l + lp) OVER (PARTITION BY ll.dataset_id, row_id)) AS e FROM ll JOIN pi ON ll.dataset_id = pi.dataset_id AND ll.y = pi.y)") + "SELECT dataset_id, row_id, sum(CASE WHEN y = 0 THEN e ELSE 0e0 END) / sum(e) AS p0, sum(CASE WHEN y = 1 THEN e ELSE 0e0 END) / sum(e) AS p1, sum(CASE WHEN y = 2 THEN e ELSE 0e0 END) / sum(e) AS p2 FROM ex GROUP BY 1, 2")
def naive_bayes_predict(spark, sf):
    rows = manip.with_roles(fx.observations(spark, sf))
    p = predict.naive_bayes(rows.where("role = 'context'"), rows.where("role = 'query'"), 3)
    return p.select("dataset_id", "row_id", *[F.get("probs", F.lit(c)).alias(f"p{c}") for c in range(3)])


@query("centroid_predict", "dataset_id:l row_id:l p0:d p1:d p2:d", with_(OBS, ROLES, "ce AS (SELECT dataset_id, y, avg(x0) AS c0, avg(x1) AS c1, avg(x2) AS c2, avg(x3) AS c3 FROM roles WHERE role = 'context' GROUP BY 1, 2)", "di AS (SELECT r.dataset_id, row_id, ce.y, sqrt(pow(x0 - c0, 2) + pow(x1 - c1, 2) + pow(x2 - c2, 2) + pow(x3 - c3, 2)) AS d FROM roles r JOIN ce ON r.dataset_id = ce.dataset_id WHERE role = 'query')", "ex AS (SELECT dataset_id, row_id, y, exp(min(d) OVER (PARTITION BY dataset_id, row_id) - d) AS e FROM di)") + "SELECT dataset_id, row_id, sum(CASE WHEN y = 0 THEN e ELSE 0e0 END) / sum(e) AS p0, sum(CASE WHEN y = 1 THEN e ELSE 0e0 END) / sum(e) AS p1, sum(CASE WHEN y = 2 THEN e ELSE 0e0 END) / sum(e) AS p2 FROM ex GROUP BY 1, 2")
def centroid_predict(spark, sf):
    rows = manip.with_roles(fx.observations(spark, sf))
    p = predict.centroids(rows.where("role = 'context'"), rows.where("role = 'query'"), 3)
    return p.select("dataset_id", "row_id", *[F.get("probs", F.lit(c)).alias(f"p{c}") for c in range(3)])


@query("ensemble_mean", "dataset_id:l row_id:l p0:d p1:d p2:d", with_(OBS, MANY, VARIANTS) + "SELECT dataset_id, row_id, avg(p0) AS p0, avg(p1) AS p1, avg(p2) AS p2 FROM var GROUP BY 1, 2")
def ensemble_mean(spark, sf):
    p = predict.ensemble(fx.variants(spark, sf), ["dataset_id", "row_id"])
    return p.select("dataset_id", "row_id", *[F.get("probs", F.lit(c)).alias(f"p{c}") for c in range(3)])


@query("head_slice", "dataset_id:l row_id:l", with_(OBS, ROLES) + "SELECT dataset_id, row_id FROM roles WHERE role = 'context' QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) <= 64")
def head_slice(spark, sf):
    return predict.head_slice(manip.with_roles(fx.observations(spark, sf)).where("role = 'context'"), 64)


#: Distances that ``Nearest`` holds at once.
DISTANCES = 1 << 18


class Nearest:
    """A plug-in predictor: the class of the nearest row."""

    def fit(self, x, y):
        self.x, self.y, self.k = x, y, int(y.max()) + 1
        return self

    def predict_proba(self, x):
        nearest, columns = np.empty(len(x), int), np.ascontiguousarray(self.x.T)
        step = max(1, DISTANCES // len(self.x))
        for a in range(0, len(x), step):
            d = np.zeros((len(x[a : a + step]), len(self.x)))
            for j, column in enumerate(columns):
                d += (x[a : a + step, j, None] - column) ** 2
            nearest[a : a + step] = np.sqrt(d).argmin(1)
        return np.eye(self.k)[self.y[nearest]]


@query("plug_in_predict", "row_id:l pred:l", KNN + ", lv AS (SELECT y, dense_rank() OVER (ORDER BY y) - 1 AS code FROM (SELECT DISTINCT y FROM roles WHERE role = 'context')) :: SELECT row_id, code AS pred FROM nb JOIN lv ON nb.ny = lv.y WHERE r = 1")
def plug_in_predict(spark, sf):
    return predict.plug_in(manip.with_roles(fx.vectors(spark, sf)).withColumn("manip_key", F.lit("default")), Nearest)


NAMES = "one AS (SELECT unnest(['base', 'ctxeqq', 'nnsplit']) AS s), tra AS (SELECT unnest(['ctx', 'noise', 'mislbl_random', 'col', 'rowdup', 'qleak', 'tserum', 'bwash', 'splitsize']) AS s), agg AS (SELECT unnest(['temp', 'tshuffle', 'lperm', 'ftx', 'rowshuf', 'tabdpt_sim']) AS s), me AS (SELECT unnest(['accuracy', 'max_confidence', 'correct_confidence', 'prediction_margin', 'entropy', 'loss', 'chi_squared', 'kl_divergence', 'wasserstein']) AS m), mc AS (SELECT m FROM me UNION ALL SELECT unnest(['kl2clean', 'rkl2clean'])), tr AS (SELECT unnest(['slope', 'auc', 'gain', 'early', 'late_gain']) AS r), ar AS (SELECT unnest(['std', 'range', 'mean']) AS r), nm AS (SELECT s || '_' || m AS signal, s AS sweep, m AS measurement, '' AS reduction FROM one, me UNION ALL SELECT s || '_' || m || '_' || r, s, m, r FROM tra, mc, tr UNION ALL SELECT s || '_' || m || '_' || r, s, m, r FROM agg, me, ar), sig AS (SELECT * FROM nm WHERE NOT (sweep = 'temp' AND measurement IN ('accuracy', 'chi_squared', 'wasserstein') AND reduction IN ('std', 'range')))"


def names(spark):
    return spark.createDataFrame(sweeps.signal_names(), "signal string, sweep string")


@query("signal_family", "signal:s family:s", NAMES + " :: SELECT signal, CASE WHEN sweep = 'mislbl_random' THEN 'mislbl' ELSE sweep END AS family FROM sig")
def signal_family(spark, sf):
    return names(spark).select("signal", signals.family("signal").alias("family"))


@query("signal_scope", "scope:s n:l", NAMES + " :: SELECT 'ALL' AS scope, count(*) AS n FROM sig UNION ALL SELECT 'no:ctx', count(*) FROM sig WHERE sweep <> 'ctx' UNION ALL SELECT 'ctx+noise', count(*) FROM sig WHERE sweep IN ('ctx', 'noise')")
def signal_scope(spark, sf):
    rows = names(spark).withColumn("family", signals.family("signal"))
    counts = [rows.where(signals.in_scope(s)).agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n") for s in ("ALL", "no:ctx", "ctx+noise")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("signal_arms", "arm:s n_cols:l", NAMES + " :: SELECT 'ALL' AS arm, count(*) AS n_cols FROM sig UNION ALL SELECT CASE WHEN sweep = 'mislbl_random' THEN 'mislbl' ELSE sweep END, count(*) FROM sig GROUP BY 1 HAVING count(*) >= 2")
def signal_arms(spark, sf):
    return signals.arms(names(spark).withColumn("family", signals.family("signal")))


@query("signal_codes", "signal:s sweep:s measurement:s reduction:s", NAMES + " :: SELECT signal, CASE WHEN sweep = 'mislbl_random' THEN 'mislbl' ELSE sweep END AS sweep, measurement, reduction FROM sig")
def signal_codes(spark, sf):
    return names(spark).select("signal", signals.codes("signal").alias("c")).select("signal", "c.*")


@query("denylist", "n_all:l n_denied:l", NAMES + " :: SELECT (SELECT count(*) FROM nm) AS n_all, (SELECT count(*) FROM nm) - (SELECT count(*) FROM sig) AS n_denied")
def denylist(spark, sf):
    every = [n for s in sweeps.AGGREGATES for m in sweeps.MEASUREMENTS for n in [f"{s}_{m}_{r}" for r in sweeps.AGGREGATE_REDUCTIONS]]
    every += [f"{s}_{m}" for s in sweeps.ONE_SHOTS for m in sweeps.MEASUREMENTS] + [f"{s}_{m}_{r}" for s in sweeps.TRAJECTORIES for m in (*sweeps.MEASUREMENTS, "kl2clean", "rkl2clean") for r in sweeps.TRAJECTORY_REDUCTIONS]
    rows = spark.createDataFrame([(n,) for n in every], "signal string")
    return rows.agg(F.count("*").alias("n_all"), F.sum(signals.denied("signal").cast("long")).alias("n_denied"))


BLIND = leaning("bld", "obs", "0e0", "b")


def _six(t: str) -> str:
    return f"SELECT dataset_id, avg(CASE WHEN pred = y THEN 1e0 ELSE 0e0 END) AS accuracy, avg(greatest(p0, p1, p2)) AS max_confidence, avg({own()}) AS correct_confidence, avg({entropy()}) AS entropy, -avg(ln({own()} + {EPS})) AS loss, avg(greatest(p0, p1, p2) - (p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2))) AS prediction_margin FROM {t} GROUP BY dataset_id"


def _long(t: str, out: str) -> str:
    cols = ("accuracy", "max_confidence", "correct_confidence", "entropy", "loss", "prediction_margin")
    return f"SELECT dataset_id, unnest([{', '.join(repr('base_' + c) for c in cols)}]) AS signal, unnest([{', '.join(cols)}]) AS {out} FROM ({_six(t)})"


POOL = f"lb AS (SELECT dataset_id, CASE WHEN count(*) > 600 THEN 1 ELSE 0 END AS y FROM obs GROUP BY 1), pool AS (SELECT t.dataset_id, lb.y, t.signal, 'base' AS family, xt, xb FROM ({_long('pred', 'xt')}) t JOIN ({_long('bld', 'xb')}) b ON t.dataset_id = b.dataset_id AND t.signal = b.signal JOIN lb ON lb.dataset_id = t.dataset_id)"


@query("pool_align", "dataset_id:l y:l signal:s family:s xt:d xb:d", with_(OBS, PRED, BLIND, POOL) + "SELECT * FROM pool")
def pool_align(spark, sf):
    pool = fx.pool(spark, sf)
    cols = [r for r in ("base_accuracy", "base_max_confidence", "base_correct_confidence", "base_entropy", "base_loss", "base_prediction_margin")]
    wide = lambda side: signals.wide(pool.select("dataset_id", F.col("y").alias("label"), "signal", F.col(side).alias("value")), cols, ("dataset_id", "label")).withColumn("success", F.lit(True))
    return signals.align(wide("xt"), wide("xb"))


@query("signal_pivot", "dataset_id:l base_accuracy:d base_entropy:d base_loss:d", with_(OBS, PRED) + f"SELECT dataset_id, accuracy AS base_accuracy, entropy AS base_entropy, loss AS base_loss FROM ({_six('pred')})")
def signal_pivot(spark, sf):
    return signals.wide(fx.pool(spark, sf).select("dataset_id", "signal", F.col("xt").alias("value")), ["base_accuracy", "base_entropy", "base_loss"])


@query("upsert_signals", "dataset_id:l v:d w:d", "SELECT s_suppkey AS dataset_id, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS v, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_nationkey AS DOUBLE) END AS w FROM supplier")
def upsert_signals(spark, sf):
    s = fx.table(spark, sf, "supplier")
    return signals.upsert(s.select(F.col("s_suppkey").alias("dataset_id"), F.col("s_acctbal").alias("v")), s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("dataset_id"), (F.col("s_acctbal") * 2).alias("v"), F.col("s_nationkey").cast("double").alias("w")))


@query("last_file_wins", "id:l v:l", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS v FROM customer")
def last_file_wins(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return signals.last_wins([c.withColumn("v", F.lit(1)), c.where("id % 2 = 0").withColumn("v", F.lit(2))], "id")


@query("reference_compare", "dataset_id:l same:b", "SELECT coalesce(a.s_suppkey, b.s_suppkey) AS dataset_id, a.s_acctbal IS NOT DISTINCT FROM b.s_acctbal AS same FROM (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) a FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0e0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0) b ON a.s_suppkey = b.s_suppkey")
def reference_compare(spark, sf):
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("dataset_id"), "s_acctbal")
    return signals.compared(s.where("dataset_id % 5 <> 0"), s.where("dataset_id % 7 <> 0").withColumn("s_acctbal", F.when(F.col("dataset_id") % 4 == 0, 0.0).otherwise(F.col("s_acctbal"))), ["dataset_id"], "s_acctbal")


@query("cache_misses", "dataset_id:l manip_key:s", with_(OBS, "pl AS (SELECT DISTINCT dataset_id, unnest(['default', 'noise=0.1', 'noise=0.2']) AS manip_key FROM obs)") + "SELECT * FROM pl WHERE NOT (dataset_id % 2 = 0 AND manip_key = 'default')")
def cache_misses(spark, sf):
    plan = fx.observations(spark, sf).select("dataset_id").distinct().withColumn("manip_key", F.explode(F.array(F.lit("default"), F.lit("noise=0.1"), F.lit("noise=0.2")))).withColumn("pred_key", F.lit("plain"))
    return writers.missing(plan, plan.where("dataset_id % 2 = 0 and manip_key = 'default'"))


@query("dump_halves", "part:s n:l", "SELECT CASE WHEN l_suppkey < (SELECT (max(l_suppkey) + 1) // 2 FROM lineitem) THEN 'a' ELSE 'b' END AS part, count(*) AS n FROM lineitem GROUP BY 1")
def dump_halves(spark, sf):
    return writers.halves(fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("table_id"))).groupBy("part").agg(F.count("*").alias("n"))


@query("result_json", "line:l kind:s key:l value:d", "SELECT s_suppkey AS line, 'row' AS kind, s_suppkey AS key, s_acctbal AS value FROM supplier UNION ALL SELECT 0, 'head', count(*), avg(s_acctbal) FROM supplier")
def result_json(spark, sf):
    rows = fx.table(spark, sf, "supplier")
    mean = rows.agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("m")).first()
    lines = writers.result_json({"model": "knn"}, {"n": mean["n"], "mean": mean["m"]}, rows)
    at = lambda path: F.get_json_object("value", path)
    head = at("$.metadata.model").isNotNull()
    return lines.select(F.coalesce(at("$.s_suppkey"), F.lit(0)).alias("line"), F.when(head, "head").otherwise("row").alias("kind"), F.coalesce(at("$.metrics.n"), at("$.s_suppkey")).alias("key"), F.coalesce(at("$.metrics.mean"), at("$.s_acctbal")).alias("value"))


@query("render_internal", "dataset_id:l cell:s", with_(OBS, PRED, BLIND, POOL, "g AS (SELECT dataset_id, avg(xt - xb) AS m, stddev_samp(xt - xb) AS s FROM pool GROUP BY 1)") + "SELECT dataset_id, regexp_replace(printf('%+.4f', m), '^([+-]?)0\\.', '\\1.') || ' ± ' || regexp_replace(printf('%.4f', s), '^0\\.', '.') AS cell FROM g")
def render_internal(spark, sf):
    g = fx.pool(spark, sf).groupBy("dataset_id").agg(F.avg(F.col("xt") - F.col("xb")).alias("m"), F.stddev_samp(F.col("xt") - F.col("xb")).alias("s"))
    return g.select("dataset_id", writers.signed("m", "s").alias("cell"))


@query("hist_by_class", "lab:l bin:l share:d", "v AS (SELECT l.toxic AS lab, CAST(d.n_chars AS DOUBLE) AS v FROM documents d JOIN labels l ON d.doc_id = l.doc_id), s AS (SELECT quantile_cont(v, 0.005e0) AS lo, quantile_cont(v, 0.995e0) AS hi FROM v), b AS (SELECT lab, greatest(0, least(39, floor((v - lo) / (hi - lo) * 40))) AS bin FROM v, s) :: SELECT lab, bin, count(*) / CAST(sum(count(*)) OVER (PARTITION BY lab) AS DOUBLE) AS share FROM b GROUP BY 1, 2")
def hist_by_class(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", "n_chars").join(fx.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("lab")), "doc_id")
    return writers.histogram(rows, ["lab"], "n_chars")


CONFORMAL = "cal AS (SELECT dataset_id, greatest(p0, p1, p2) AS s FROM pred WHERE row_id % 2 = 0), tst AS (SELECT dataset_id, row_id, greatest(p0, p1, p2) AS s FROM pred WHERE row_id % 2 = 1), cp AS (SELECT 1 AS g, log10(greatest((1 + (SELECT count(*) FROM cal WHERE cal.dataset_id = tst.dataset_id AND cal.s >= tst.s)) / (1e0 + (SELECT count(*) FROM cal WHERE cal.dataset_id = tst.dataset_id)), 1e-4)) AS v FROM tst)"


@query("pvalue_hist", "bin:l share:d", with_(OBS, PRED, CONFORMAL, "s AS (SELECT min(v) AS lo FROM cp)", "b AS (SELECT greatest(0, least(23, floor((v - lo) / (0 - lo) * 24))) AS bin FROM cp, s)") + "SELECT bin, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM b GROUP BY 1")
def pvalue_hist(spark, sf):
    scored = fx.predictions(spark, sf).select("dataset_id", "row_id", F.array_max("probs").alias("s"))
    p = stats.conformal(scored.where("row_id % 2 = 0"), scored.where("row_id % 2 = 1"), ["dataset_id"], "s")
    return writers.pvalue_histogram(p.select(F.lit(1).alias("g"), "p_value"), ["g"], "p_value")


@query("coverage", "target_cov:d blind_cov:d", with_(OBS, PRED, BLIND, POOL) + "SELECT avg(CASE WHEN xt IS NULL THEN 0e0 ELSE 1e0 END) AS target_cov, avg(CASE WHEN xb IS NULL THEN 0e0 ELSE 1e0 END) AS blind_cov FROM pool")
def coverage(spark, sf):
    return audit.coverage(fx.pool(spark, sf))


@query("class_centroids", "label:l j:l centre:d", "SELECT label, j, avg(v) AS centre FROM (SELECT label, unnest(generate_series(0, 63)) AS j, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY 1, 2")
def class_centroids(spark, sf):
    return fx.vectors(spark, sf).select(F.col("y").alias("label"), F.posexplode("x").alias("j", "v")).groupBy("label", "j").agg(F.avg("v").alias("centre"))


@query("wide_guard", "dataset_id:l n_features:l reason:s", "SELECT conv_id AS dataset_id, count(*) AS n_features, CASE WHEN count(*) > 4 THEN 'too many features' END AS reason FROM conversations GROUP BY 1")
def wide_guard(spark, sf):
    sizes = fx.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("dataset_id")).agg(F.count("*").alias("n_features"))
    return profile.wide_guard(sizes, 4)


@query("external_audit", "arm:s scheme:s target_auc:d blind_auc:d gap:d draws:l")
def external_audit(spark, sf):
    pool = fx.pool(spark, sf)
    kinds = pool.select("signal", "family").distinct()
    named = kinds.orderBy("signal").collect()  # one row per signal
    arms = {r["arm"]: [n["signal"] for n in named if r["arm"] in ("ALL", n["family"])] for r in signals.arms(kinds).collect()}
    schemes = {"noscreen": False, "screen": True}
    parts = [audit.evaluate(audit.external(pool, arms, screened=on)).withColumn("scheme", F.lit(name)) for name, on in schemes.items()]
    cells = spark.createDataFrame([(a, s) for a in arms for s in schemes], "arm string, scheme string")
    return cells.join(parts[0].unionByName(parts[1]), ["arm", "scheme"], "left").fillna(0, ["draws"])  # no draw may survive the screen


@query("internal_audit", "scope:s kind:s n_cols:l k_star:l target:d blind:d gap:d")
def internal_audit(spark, sf):
    every = [f"base_{n}" for n in ("accuracy", "max_confidence", "correct_confidence", "entropy", "loss", "prediction_margin")]
    return audit.internal(fx.pool(spark, sf), {"ALL": every}, ("lr", "trees"))


@query("contributions", "signal:s target_importance:d blind_importance:d target_rank:l blind_rank:l")
def contributions(spark, sf):
    return audit.contributions(fx.pool(spark, sf))


def pool_wide(spark, sf, *more):
    pool = fx.pool(spark, sf)
    cols = ["base_accuracy", "base_max_confidence", "base_correct_confidence", "base_entropy", *more]
    return signals.wide(pool.select("dataset_id", "y", "signal", F.col("xt").alias("value")), cols, ("dataset_id", "y")), cols


@query("loo_logistic", "dataset_id:l y:l score:d")
def loo_logistic(spark, sf):
    wide, cols = pool_wide(spark, sf, "base_loss", "base_prediction_margin")
    return models.loo_table(wide.withColumn("g", F.lit(1)), ["g"], "dataset_id", "y", cols)


@query("combo_search", "k:l combo:s auc:d place:l")
def combo_search(spark, sf):
    wide, cols = pool_wide(spark, sf, "base_loss", "base_prediction_margin")
    return models.top_of(models.combos(wide, "dataset_id", "y", cols), ["k"], "auc", 5, "combo")


def _draws(u: str) -> str:
    return " + ".join(f"CASE WHEN {u} >= {c!r} THEN 1 ELSE 0 END" for c in split.POISSON)


BOOT = f"""bw AS (SELECT rep, dataset_id, y, xt, xb, {_draws('u')} AS w FROM (SELECT r.rep, p.dataset_id, p.y, p.xt, p.xb, {uniform(0, 'boot', 'r.rep', 'p.dataset_id')} AS u FROM pool p, (SELECT unnest(generate_series(0, 1999)) AS rep) r WHERE p.signal = 'base_accuracy')),
  bl AS (SELECT rep, side, y, w, CASE side WHEN 'target' THEN xt ELSE xb END AS s FROM bw, (SELECT unnest(['target', 'blind']) AS side) WHERE w > 0),
  bs AS (SELECT rep, side, s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE w END) AS neg FROM bl GROUP BY 1, 2, 3),
  bc AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep, side ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bs),
  ba AS (SELECT rep, side, sum(pos * (below + neg / 2e0)) / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auc FROM bc GROUP BY 1, 2 HAVING sum(pos) * sum(neg) > 0),
  bg AS (SELECT rep, max(CASE WHEN side = 'target' THEN auc END) AS t, max(CASE WHEN side = 'blind' THEN auc END) AS b FROM ba GROUP BY 1)"""


@query("paired_bootstrap", "g:l target_sd:d blind_sd:d gap_sd:d p_gap_le_0:d used:l", with_(OBS, PRED, BLIND, POOL, BOOT) + "SELECT 1 AS g, stddev_pop(t) AS target_sd, stddev_pop(b) AS blind_sd, stddev_pop(t - b) AS gap_sd, avg(CASE WHEN t - b <= 0 THEN 1e0 ELSE 0e0 END) AS p_gap_le_0, count(*) AS used FROM bg")
def paired_bootstrap(spark, sf):
    pool = fx.pool(spark, sf).where("signal = 'base_accuracy'")
    return split.bootstrap(pool.select(F.lit(1).alias("g"), F.col("dataset_id").alias("row_id"), "y", F.col("xt").alias("target"), F.col("xb").alias("blind")), ["g"], 2000)


@query("transfer_eval", "dataset_id:l score:d")
def transfer_eval(spark, sf):
    wide, cols = pool_wide(spark, sf, "base_loss", "base_prediction_margin")
    return audit.transfer(wide.where("dataset_id % 2 = 0"), wide.where("dataset_id % 2 = 1"), cols, "y")


@query("event_windows", "start:s event_type:s n:l mean_value:d", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed(events).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("event_props", "event_type:s n:l mean_k:d", "SELECT event_type, count(*) AS n, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS mean_k FROM events GROUP BY 1")
def event_props(spark, sf):
    return fx.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.get_json_object("props", "$.k").cast("double")).alias("mean_k"))
