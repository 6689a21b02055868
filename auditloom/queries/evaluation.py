"""Registries, readers, evaluations and report data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom.functions import stats
from auditloom.operators import audit, evaluate, instances, manip, prep, signals
from auditloom.plans import sweeps
from auditloom.queries import audits
from auditloom.queries.base import OBS, PRED, ROLES, key, query, with_
from auditloom.sinks import tables, writers
from auditloom.sources import fixtures as fx
from auditloom.sources import readers, registry

POOL = (OBS, PRED, audits.BLIND, audits.POOL)


@query("file_listing", "id:s", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS id")
def file_listing(spark, sf):
    return readers.path_index(readers.listed(spark, sf).withColumn("path", F.regexp_replace("path", r"\.parquet/[^/]+\.parquet$", ".parquet")))


@query("split_three_way", "s_suppkey:l split:s", f"SELECT s_suppkey, CASE WHEN r <= floor(n * 0.15e0) THEN 'test' WHEN r <= floor(n * 0.3e0) THEN 'valid' ELSE 'train' END AS split FROM (SELECT s_suppkey, row_number() OVER (ORDER BY {key(42, 'split', '1', 's_suppkey')}, s_suppkey) AS r, count(*) OVER () AS n FROM supplier)")
def split_three_way(spark, sf):
    return readers.load(spark, "split", "supplier", root=sf, row="s_suppkey")


@query("membership_union", "family:s dataset_id:s label:l", "SELECT 'supplier' AS family, CAST(s_suppkey AS VARCHAR) AS dataset_id, CASE WHEN s_nationkey < 12 THEN 1 ELSE 0 END AS label FROM supplier WHERE s_suppkey <= 40 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 0 FROM customer")
def membership_union(spark, sf):
    supplier, customer = fx.table(spark, sf, "supplier"), fx.table(spark, sf, "customer")
    listed = supplier.where("s_suppkey <= 40").select(F.lit("supplier").alias("family"), F.col("s_suppkey").alias("dataset_id"), (F.col("s_nationkey") < 12).cast("int").alias("label"))
    every = supplier.select(F.lit("supplier").alias("family"), F.col("s_suppkey").alias("dataset_id")).unionByName(customer.select(F.lit("customer").alias("family"), F.col("c_custkey").alias("dataset_id")))
    return registry.membership(listed, every)


@query("id_overlap", "n:l", "SELECT count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0))")
def id_overlap(spark, sf):
    a, b = fx.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("id")), fx.table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("id"))
    return spark.createDataFrame([(registry.shared_ids(a, b, "id"),)], "n long")


@query("union_by_name", "id:l a:d b:d", "SELECT s_suppkey AS id, s_nationkey AS a, NULL AS b FROM supplier UNION ALL BY NAME SELECT n_regionkey AS b, n_nationkey AS id FROM nation")
def union_by_name(spark, sf):
    return signals.union_by_name([fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("a")), fx.table(spark, sf, "nation").select(F.col("n_regionkey").alias("b"), F.col("n_nationkey").alias("id"))])


@query("padded_dump", "table_id:l row_id:l x0:d x3:d x5:d y:d n_rows:l n_features:l", with_(OBS) + "SELECT t.table_id, g.r AS row_id, coalesce(x0, 0) AS x0, coalesce(x3, 0) AS x3, 0 AS x5, coalesce(y, 0) AS y, least(n, 640) AS n_rows, 4 AS n_features FROM (SELECT dataset_id AS table_id, count(*) AS n FROM obs GROUP BY 1) t, (SELECT unnest(generate_series(0, 639)) AS r) g LEFT JOIN obs ON obs.dataset_id = t.table_id AND obs.row_id = g.r")
def padded_dump(spark, sf):
    dump = fx.observations(spark, sf).withColumnRenamed("dataset_id", "table_id")
    return writers.padded(dump, 640, 6).select("*", *[F.get("x", F.lit(j)).alias(f"x{j}") for j in (0, 3, 5)])


@query("cap_levels_fit", "c_custkey:l target:s rule:s", "kept AS (SELECT lv FROM (SELECT CAST(c_nationkey AS VARCHAR) AS lv, row_number() OVER (ORDER BY count(*) DESC, CAST(c_nationkey AS VARCHAR)) AS r FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) WHERE r < 10) :: SELECT c_custkey, CASE WHEN CAST(c_nationkey AS VARCHAR) IN (SELECT lv FROM kept) THEN CAST(c_nationkey AS VARCHAR) ELSE '__other__' END AS target, 'capped' AS rule FROM customer")
def cap_levels_fit(spark, sf):
    rows = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("level"), F.lit(1).alias("g"))
    return prep.discretise(rows.where("c_custkey % 2 = 0"), rows, ["g"], "level", numeric=False)


@query("impute_reference", "dataset_id:l signal:s filled:d", with_(*POOL, "gp AS (SELECT dataset_id, signal, CASE WHEN dataset_id % 5 = 0 THEN NULL ELSE xt END AS v FROM pool)", "md AS (SELECT signal, quantile_cont(v, 0.5e0) AS m FROM gp WHERE dataset_id % 2 = 0 GROUP BY 1)") + "SELECT dataset_id, gp.signal, coalesce(v, m, 0) AS filled FROM gp LEFT JOIN md ON gp.signal = md.signal")
def impute_reference(spark, sf):
    rows = fx.pool(spark, sf).select("dataset_id", "signal", F.when(F.col("dataset_id") % 5 != 0, F.col("xt")).alias("v"))
    return prep.impute_median(rows, ["signal"], "v", rows.where("dataset_id % 2 = 0"))


SIZES = "sz AS (SELECT dataset_id, CASE WHEN count(*) > 600 THEN 1 ELSE 0 END AS label, sum(CASE WHEN role = 'context' THEN 1 ELSE 0 END) AS n_train, sum(CASE WHEN role = 'query' THEN 1 ELSE 0 END) AS n_test, CASE WHEN dataset_id % 7 <> 0 THEN count(DISTINCT x0) END AS n_features FROM roles GROUP BY 1)"


def sizes(spark, sf):
    rows = manip.with_roles(fx.observations(spark, sf))
    count = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0))
    return rows.groupBy("dataset_id").agg((F.count("*") > 600).cast("int").alias("label"), count("context").alias("n_train"), count("query").alias("n_test"), F.when(F.col("dataset_id") % 7 != 0, F.count_distinct(F.get("x", F.lit(0)))).alias("n_features"))


@query("minimal_features", "dataset_id:l n_train:d n_test:d n_features:d reason:s", with_(OBS, ROLES, SIZES) + "SELECT dataset_id, CASE WHEN n_features IS NOT NULL THEN n_train END AS n_train, CASE WHEN n_features IS NOT NULL THEN n_test END AS n_test, n_features, CASE WHEN n_features IS NULL THEN 'missing_minimal_features' END AS reason FROM sz")
def minimal_features(spark, sf):
    kept, lost = evaluate.minimal(sizes(spark, sf))
    return signals.union_by_name([kept.select("dataset_id", *evaluate.MINIMAL), lost])


@query("baseline_splits", "seed:l dataset_id:l split:s overlap_ids:l")
def baseline_splits(spark, sf):
    parted = evaluate.repeated_splits(sizes(spark, sf), "label", 0.2, range(5))
    return parted.join(evaluate.overlap(parted), "seed")


@query("baseline_eval", "seed:l train_members:l train_others:l test_members:l test_others:l overlap_ids:l auc:d average_precision:d accuracy:d f1:d tpr_at_1fpr:d tpr_at_5fpr:d tpr_at_10fpr:d")
def baseline_eval(spark, sf):
    return evaluate.baseline(sizes(spark, sf), "label")


@query("loocv_models", "model:s dataset_id:l y:l score:d")
def loocv_models(spark, sf):
    pool = fx.pool(spark, sf).where("signal in ('base_loss', 'base_entropy')")
    both = pool.select("dataset_id", "y", "signal", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("v")) for m, c in (("target", "xt"), ("blind", "xb"))])).alias("s"))
    rows = both.select("dataset_id", "y", "signal", "s.*").groupBy("model", "dataset_id", "y").pivot("signal", ["base_loss", "base_entropy"]).agg(F.first("v")).withColumnRenamed("y", "label")
    return evaluate.leave_one_out(rows, ["model"], "dataset_id", "label", "base_loss", "base_entropy")


@query("usable_everywhere", "signal:s", with_(*POOL) + "SELECT signal FROM pool GROUP BY signal HAVING count(DISTINCT dataset_id % 2) = (SELECT count(DISTINCT dataset_id % 2) FROM pool) AND count(xt) > 5 AND stddev_pop(xt) > 1e-12")
def usable_everywhere(spark, sf):
    return evaluate.usable_everywhere(fx.pool(spark, sf).select("signal", (F.col("dataset_id") % 2).alias("task"), F.col("xt").alias("value")))


def _areas(side: str) -> str:
    return f"SELECT signal, (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / CAST(sum(y) * sum(1 - y) AS DOUBLE) AS auc FROM (SELECT signal, y, rank() OVER (PARTITION BY signal ORDER BY {side}) + (count(*) OVER (PARTITION BY signal, {side}) - 1) / 2e0 AS r FROM pool) GROUP BY 1 HAVING sum(y) * sum(1 - y) > 0"


AREAS = (f"ta AS ({_areas('xt')})", f"ba AS ({_areas('xb')})")


@query("best_single_signal", "signal:s auc:d", with_(*POOL, *AREAS) + "SELECT signal, greatest(auc, 1 - auc) AS auc FROM ta ORDER BY round(greatest(auc, 1 - auc), 12) DESC, signal DESC LIMIT 1")
def best_single_signal(spark, sf):
    return evaluate.best_single(fx.pool(spark, sf).withColumnRenamed("xt", "value"), "y")


@query("auc_bars", "signal:s side:s auc:d", with_(*POOL, *AREAS) + "SELECT signal, 'target' AS side, auc FROM ta UNION ALL SELECT signal, 'blind', auc FROM ba")
def auc_bars(spark, sf):
    pool = fx.pool(spark, sf)
    area = lambda c, out: stats.auc(pool, ["signal"], c, "y").where("auc is not null").select("signal", F.col("auc").alias(out), F.lit(None).cast("double").alias(f"{out}_sd"))
    return tables.bars(area("xt", "target_auc").join(area("xb", "blind_auc"), "signal"), ["signal"])


@query("top_overlap", "overlap:l spearman:d blind_zero:l", with_(*POOL, *AREAS, "rk AS (SELECT ta.signal, row_number() OVER (ORDER BY round(abs(ta.auc - 0.5e0), 9) DESC, ta.signal) AS tr, row_number() OVER (ORDER BY round(abs(ba.auc - 0.5e0), 9) DESC, ta.signal) AS br, abs(ba.auc - 0.5e0) AS bi FROM ta JOIN ba ON ta.signal = ba.signal)") + "SELECT sum(CASE WHEN tr <= 3 AND br <= 3 THEN 1 ELSE 0 END) AS overlap, corr(tr, br) AS spearman, sum(CASE WHEN tr <= 3 AND bi = 0 THEN 1 ELSE 0 END) AS blind_zero FROM rk")
def top_overlap(spark, sf):
    pool = fx.pool(spark, sf)
    parts = [audit.separation(pool, ["signal"], c, "y").withColumnRenamed("separation", f"{n}_importance") for c, n in (("xt", "target"), ("xb", "blind"))]
    place = lambda n: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(f"{n}_importance", 9)), "signal")).alias(f"{n}_rank")  # noqa: E731  as many rows as signals
    ranks = parts[0].join(parts[1], "signal").where("target_importance is not null").select("*", place("target"), place("blind"))
    return audit.overlap(ranks, 3)


@query("metadata_auc", "auc:d")
def metadata_auc(spark, sf):
    meta = sizes(spark, sf).select("dataset_id", "label", F.col("n_train").alias("n_pool"), F.coalesce("n_features", F.lit(0)).alias("n_features"))
    return spark.createDataFrame([(audit.metadata_auc(meta, "label"),)], "auc double")


@query("oof_at_elbow", "scope:s kind:s k:l dataset_id:l y:l target:d blind:d")
def oof_at_elbow(spark, sf):
    pool = fx.pool(spark, sf)
    return audit.at_elbow(pool, {"ALL": [r["signal"] for r in pool.select("signal").distinct().orderBy("signal").collect()]})  # six names


@query("external_pvalues", "arm:s draw:l side:s dataset_id:l y:l p_value:d")
def external_pvalues(spark, sf):
    pool = fx.pool(spark, sf)
    return audit.external_scores(pool, {"ALL": [r["signal"] for r in pool.select("signal").distinct().orderBy("signal").collect()]}, draws=1, screened=False)


@query("forced_instances", "row_id:l split:s y:l x0:d x1:d")
def forced_instances(spark, sf):
    made = instances.forced_classification(fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), "c_custkey")
    return made.rows.select("row_id", "split", "y", *[F.get("x", F.lit(j)).alias(f"x{j}") for j in (0, 1)])


# The plan and the report names, said in SQL.


def _items(sweep: str, kind: str, values, manipulation: str, prediction: str = "'plain'") -> str:
    listed = "[" + ", ".join(repr(v) if isinstance(v, str) else f"{float(v)!r}e0" for v in values) + "]"
    x = "CAST(i - 1 AS DOUBLE)" if values and isinstance(values[0], str) else "v"
    return f"SELECT '{sweep}' AS sweep, '{kind}' AS kind, i - 1 AS ordinal, {x} AS intensity, {manipulation} AS manip_key, {prediction} AS pred_key FROM (SELECT unnest({listed}) AS v, unnest(generate_series(1, {len(values)})) AS i)"


def _shot(sweep: str, manipulation: str, prediction: str = "plain") -> str:
    return f"SELECT '{sweep}', 'one_shot', 0, NULL, '{manipulation}', '{prediction}'"


def _dose(field: str) -> str:
    return f"CASE WHEN v = 0 THEN 'default' ELSE '{field}=' || printf('%g', v) END"


def _seeded(sweep: str, tag: str, most: int, more: str = "") -> str:
    return f"SELECT '{sweep}', 'aggregate', r - 1, CAST(j AS DOUBLE), 'task_shuffle=' || j || '{more}', 'plain' FROM (SELECT j, row_number() OVER (ORDER BY md5('42|{tag}|' || j), j) AS r FROM (SELECT unnest(generate_series(0, 19)) AS j)) WHERE r <= {most}"


GRID = "col_grid AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT DISTINCT CAST(round(2 * pow(10e0, k / 8e0)) AS BIGINT) AS n FROM (SELECT unnest(generate_series(0, 8)) AS k)))"
PLAN = "plan AS (" + " UNION ALL ".join([
    _items("ctx", "trajectory", sweeps.CONTEXT_SIZES, "'subsample=' || printf('%g', v)"),
    _items("temp", "aggregate", sweeps.TEMPERATURES, "'default'", "'T=' || printf('%g', v)"),
    _items("noise", "trajectory", sweeps.NOISE, _dose("noise")),
    _items("mislbl_random", "trajectory", sweeps.MISLABEL, _dose("mislabel")),
    "SELECT 'col', 'trajectory', i - 1, CAST(n AS DOUBLE), CASE WHEN n = 20 THEN 'default' ELSE 'columns=' || n END, 'plain' FROM col_grid",
    _seeded("tshuffle", "task", 8),
    _seeded("tabdpt_sim", "sim", 5, "_retrieval=knn"),
    _items("lperm", "aggregate", sweeps.PERMUTATION_SEEDS, "'permutation_seed=' || printf('%g', v)"),
    _items("rowdup", "trajectory", sweeps.ROW_DUPLICATION, _dose("duplication")),
    _items("qleak", "trajectory", sweeps.LEAKAGE, _dose("leakage")),
    _items("tserum", "trajectory", sweeps.TRUTH_SERUM, _dose("truth_serum")),
    _items("bwash", "trajectory", sweeps.BRAINWASH, _dose("brainwash")),
    _items("ftx", "aggregate", sweeps.TRANSFORMS, "'transform=' || v"),
    _items("rowshuf", "aggregate", sweeps.SHUFFLE_SEEDS, "'row_shuffle_seed=' || printf('%g', v)"),
    _items("splitsize", "trajectory", sweeps.SPLIT_SIZES, "'subsample=' || greatest(2, CAST(floor(1000 * v) AS BIGINT))"),
    _shot("base", "default"), _shot("logit", "default", "logits"), _shot("ctxeqq", "context_equals_query=True"), _shot("qonly", "query_only=True"), _shot("constlbl", "constant_label=True"), _shot("nnsplit", "nn_split=True"),
]) + ")"


@query("sweep_plan", "sweep:s kind:s ordinal:l intensity:d manip_key:s pred_key:s", with_(GRID, PLAN) + "SELECT * FROM plan")
def sweep_plan(spark, sf):
    return sweeps.plan(spark, 20, 1000)


@query("fit_groups", "manip_key:s pred_key:s entries:l", with_(GRID, PLAN) + "SELECT manip_key, pred_key, count(*) AS entries FROM plan GROUP BY 1, 2")
def fit_groups(spark, sf):
    return sweeps.fits(sweeps.plan(spark, 20, 1000))


def _named(name: str, table) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(str(t) for t in table)}) AS t(name, label, code))"


REPORT = ", ".join(["CASE WHEN sweep = 'mislbl_random' THEN 'mislbl' ELSE sweep END AS fam", "measurement", "reduction", "signal"])


@query("signal_names", "signal:s feature:s manipulation:s measurement:s reduction:s", audits.NAMES + ", " + ", ".join([_named("mn", signals.MANIPULATION_NAMES), _named("sn", signals.MEASUREMENT_NAMES), _named("rn", signals.REDUCTION_NAMES)]) + f" :: SELECT signal, mn.label || '_' || sn.label || '_' || rn.label AS feature, mn.code AS manipulation, sn.code AS measurement, rn.code AS reduction FROM (SELECT {REPORT} FROM sig) s LEFT JOIN mn ON mn.name = s.fam LEFT JOIN sn ON sn.name = s.measurement LEFT JOIN rn ON rn.name = s.reduction")
def signal_names(spark, sf):
    return audits.names(spark).select("signal", signals.described("signal").alias("c")).select("signal", "c.*")
