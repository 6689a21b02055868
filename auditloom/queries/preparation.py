"""Sources, profiles, encoding, binning, splits and perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import manip, prep, profile, split
from auditloom.queries.base import EPS, OBS, ROLES, key, query, uniform, with_
from auditloom.sources import fixtures as fx
from auditloom.sources import readers

ORDER_COLUMNS = ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey")
PROFILE = "cells AS (SELECT " + "0 AS dataset_id, unnest(['o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority', 'o_custkey']) AS col_name, unnest([CAST(o_orderstatus AS VARCHAR), CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), CAST(o_orderpriority AS VARCHAR), CAST(o_custkey AS VARCHAR)]) AS value FROM orders), lv AS (SELECT dataset_id, col_name, value, count(*) AS c FROM cells GROUP BY 1, 2, 3), pf AS (SELECT dataset_id, col_name, col_name IN ('o_totalprice', 'o_custkey') AS num, sum(c) AS n, coalesce(sum(c) FILTER (WHERE value IS NULL), 0) AS n_null, count(value) AS n_distinct, min(c) FILTER (WHERE value IS NOT NULL) AS min_level_count, col_name = 'o_orderdate' AS is_date FROM lv GROUP BY 1, 2)"


def profiles(spark, sf):
    return profile.profile(fx.table(spark, sf, "orders"), F.lit(0), ORDER_COLUMNS)


@query("profile_columns", "col_name:s n:l n_null:l n_distinct:l min_level_count:l is_date:b", PROFILE + " :: SELECT * FROM pf")
def profile_columns(spark, sf):
    return profiles(spark, sf)


ELIGIBLE = "el AS (SELECT *, 0 AS strict FROM pf WHERE NOT is_date AND (NOT num OR n_null <= 0.5 * n) AND n_distinct >= 2 AND n_distinct <= 0.2 * n AND ((num AND n_distinct > 10) OR min_level_count >= 2))"


@query("target_candidates", "col_name:s n_distinct:l", PROFILE + ", " + ELIGIBLE + " :: SELECT * FROM el")
def target_candidates(spark, sf):
    return profile.eligible(profiles(spark, sf))


@query("choose_target", "col_name:s rule:s", PROFILE + ", " + ELIGIBLE + " :: SELECT col_name, CASE WHEN n_distinct <= 10 THEN 'lowcard' ELSE 'fallback' END AS rule FROM el ORDER BY CASE WHEN n_distinct <= 10 THEN 0 ELSE 1 END, CASE WHEN n_distinct <= 10 THEN 0 ELSE n_distinct END, CASE WHEN n_distinct <= 10 THEN md5(concat_ws('|', '42', 'target', '0', col_name)) ELSE col_name END LIMIT 1")
def choose_target(spark, sf):
    return profile.choose_target(profiles(spark, sf), 42)


@query("task_type", "col_name:s task_type:s", PROFILE + " :: SELECT col_name, CASE WHEN num AND (n_distinct > 20 OR min_level_count < 2) THEN 'regression' ELSE 'classification' END AS task_type FROM pf")
def task_type(spark, sf):
    return profile.task_type(profiles(spark, sf))


UNPIVOT = "up AS (SELECT dataset_id, row_id, CAST(y AS DOUBLE) AS y, unnest([0, 1, 2, 3]) AS j, unnest([x0, x1, x2, x3]) AS v FROM obs)"


@query("dataset_metadata", "dataset_id:l j:l n:l mean:d variance:d y_mean:d slope:d intercept:d", with_(OBS, UNPIVOT) + "SELECT dataset_id, j, count(*) AS n, avg(v) AS mean, var_pop(v) / 1e3 AS variance, avg(y) AS y_mean, regr_slope(y, v) AS slope, regr_intercept(y, v) AS intercept FROM up GROUP BY dataset_id, j")
def dataset_metadata(spark, sf):
    return profile.metadata(fx.observations(spark, sf)).withColumn("variance", F.col("variance") / 1e3)


@query("raw_table_features", "dataset_id:l n_rows:l n_features:l col_kurt_avg:d distinct_avg:d distinct_max:d missing_max:d class_entropy:d majority:d minority:d y_mean:d y_std:d log_rows:d rows_per_feature:d", with_(OBS, UNPIVOT, "co AS (SELECT dataset_id, j, kurtosis_pop(v) AS k, count(DISTINCT v) / CAST(count(*) AS DOUBLE) AS d FROM up GROUP BY 1, 2)", "ca AS (SELECT dataset_id, count(*) AS n_features, avg(k) AS col_kurt_avg, avg(d) AS distinct_avg, max(d) AS distinct_max, 0e0 AS missing_max FROM co GROUP BY 1)", "cl AS (SELECT dataset_id, sum(c) AS n_rows, -sum(c / n * ln(c / n)) AS class_entropy, max(c / n) AS majority, min(c / n) AS minority FROM (SELECT dataset_id, c, CAST(sum(c) OVER (PARTITION BY dataset_id) AS DOUBLE) AS n FROM (SELECT dataset_id, y, count(*) AS c FROM obs GROUP BY 1, 2)) GROUP BY 1)", "tg AS (SELECT dataset_id, avg(y) AS y_mean, stddev_pop(y) AS y_std FROM obs GROUP BY 1)") + "SELECT ca.*, cl.* EXCLUDE (dataset_id), tg.* EXCLUDE (dataset_id), ln(1 + n_rows) AS log_rows, n_rows / CAST(n_features AS DOUBLE) AS rows_per_feature FROM ca JOIN cl ON ca.dataset_id = cl.dataset_id JOIN tg ON ca.dataset_id = tg.dataset_id")
def raw_table_features(spark, sf):
    return profile.raw_features(fx.observations(spark, sf))


@query("size_guard", "dataset_id:l ok:b reason:s", with_(OBS) + "SELECT dataset_id, n >= 600 AND n >= greatest(10, floor(n * 0.3e0)) + greatest(10, floor(n * 0.7e0)) AS ok, CASE WHEN n < 600 THEN 'too few rows' WHEN n < greatest(10, floor(n * 0.3e0)) + greatest(10, floor(n * 0.7e0)) THEN 'too few to split' END AS reason FROM (SELECT dataset_id, count(*) AS n FROM obs GROUP BY 1)")
def size_guard(spark, sf):
    return profile.size_guard(fx.observations(spark, sf).groupBy("dataset_id").agg(F.count("*").alias("n")), 600, 0.3)


@query("ordinal_encode", "p_partkey:l code:l", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part")
def ordinal_encode(spark, sf):
    return prep.ordinal_encode(fx.table(spark, sf, "part").withColumn("g", F.lit(1)), ["g"], "p_type")


@query("label_encode", "l_suppkey:l l_returnflag:s code:l n:l", "SELECT l_suppkey, l_returnflag, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag) - 1 AS code, n FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def label_encode(spark, sf):
    return prep.label_encode(fx.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")), ["l_suppkey"], "l_returnflag")


@query("quantile_bin", "dataset_id:l row_id:l bin:d", with_(OBS, ROLES, "eg AS (SELECT dataset_id, quantile_cont(t, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM roles WHERE role = 'context' GROUP BY 1)", "ex AS (SELECT DISTINCT dataset_id, unnest(e) AS e FROM eg)") + "SELECT r.dataset_id, r.row_id, count(ex.e) AS bin FROM roles r LEFT JOIN ex ON ex.dataset_id = r.dataset_id AND ex.e <= r.t GROUP BY 1, 2")
def quantile_bin(spark, sf):
    rows = manip.with_roles(fx.observations(spark, sf))
    return prep.quantile_bin(rows.where("role = 'context'"), rows, ["dataset_id"], "t")


@query("cap_categories", "capped:s n:l", "rk AS (SELECT p_type, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r, count(*) OVER () AS k FROM part GROUP BY 1) :: SELECT CASE WHEN k <= 5 OR r < 5 THEN p_type ELSE '__other__' END AS capped, sum(c) AS n FROM rk GROUP BY 1")
def cap_categories(spark, sf):
    return prep.cap_categories(fx.table(spark, sf, "part").withColumn("g", F.lit(1)), ["g"], "p_type", 5).groupBy("capped").agg(F.count("*").alias("n"))


@query("force_classification", "dataset_id:l row_id:l target:s rule:s", with_(OBS, ROLES, "eg AS (SELECT dataset_id, quantile_cont(x0, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM roles WHERE role = 'context' GROUP BY 1)", "ex AS (SELECT DISTINCT dataset_id, unnest(e) AS e FROM eg)") + "SELECT r.dataset_id, r.row_id, CAST(count(ex.e) AS VARCHAR) || '.0' AS target, 'binned' AS rule FROM roles r LEFT JOIN ex ON ex.dataset_id = r.dataset_id AND ex.e <= r.x0 GROUP BY 1, 2")
def force_classification(spark, sf):
    rows = manip.with_roles(fx.observations(spark, sf)).withColumn("q", F.get("x", F.lit(0)))
    return prep.discretise(rows.where("role = 'context'"), rows, ["dataset_id"], "q", numeric=True)


@query("clean_values", "event_id:l v:d", "SELECT event_id, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN value END AS v FROM events")
def clean_values(spark, sf):
    v = F.when(F.col("event_type") == "click", F.lit(float("inf"))).when(F.col("event_type") == "view", F.col("value")).otherwise(F.lit(3.4e38))
    return fx.table(spark, sf, "events").select("event_id", prep.clean(v).alias("v"))


@query("impute_standardise", "dataset_id:l row_id:l z:d", with_(OBS, "h AS (SELECT dataset_id, row_id, CASE WHEN row_id % 7 = 0 THEN NULL ELSE x0 END AS v FROM obs)", "md AS (SELECT dataset_id, quantile_cont(v, 0.5e0) AS m FROM h GROUP BY 1)", "fl AS (SELECT h.dataset_id, row_id, coalesce(v, m, 0) AS v FROM h JOIN md ON h.dataset_id = md.dataset_id)") + "SELECT dataset_id, row_id, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM fl WINDOW w AS (PARTITION BY dataset_id)")
def impute_standardise(spark, sf):
    rows = fx.observations(spark, sf).select("dataset_id", "row_id", F.when(F.col("row_id") % 7 != 0, F.get("x", F.lit(0))).alias("v"))
    return prep.standardise(prep.impute_median(rows, ["dataset_id"], "v"), ["dataset_id"], "filled")


@query("feature_zscore_clip", "dataset_id:l row_id:l z:d", with_(OBS) + "SELECT dataset_id, row_id, greatest(least((x1 - avg(x1) OVER w) / stddev_samp(x1) OVER w, 1.5e0), -1.5e0) AS z FROM obs WINDOW w AS (PARTITION BY dataset_id)")
def feature_zscore_clip(spark, sf):
    return prep.standardise(fx.observations(spark, sf).withColumn("v", F.get("x", F.lit(1))), ["dataset_id"], "v", sample=True, clip=1.5)


@query("prior_bucket_edges", "i:l edge:d", with_(OBS, "zs AS (SELECT (t - avg(t) OVER w) / (stddev_samp(t) OVER w + 1e-8) AS z FROM obs WINDOW w AS (PARTITION BY dataset_id))", "q AS (SELECT quantile_cont(z, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM zs)") + "SELECT unnest(generate_series(0, 10)) AS i, unnest(e) AS edge FROM q")
def prior_bucket_edges(spark, sf):
    return prep.bucket_edges(fx.observations(spark, sf), ["dataset_id"], "t", 10)


@query("canonical_ids", "s_suppkey:l grid:s plain:s", "SELECT s_suppkey, '[''openml'', ' || s_suppkey || ']' AS grid, CAST(s_suppkey AS VARCHAR) AS plain FROM supplier")
def canonical_ids(spark, sf):
    grid = prep.grid_id(F.lit("openml"), F.col("s_suppkey"))
    return fx.table(spark, sf, "supplier").select("s_suppkey", grid.alias("grid"), prep.plain_id(grid).alias("plain"))


@query("scale_minmax", "dataset_id:l row_id:l scaled:d", with_(OBS) + "SELECT dataset_id, row_id, (x0 - min(x0) OVER w) / (max(x0) OVER w - min(x0) OVER w) AS scaled FROM obs WINDOW w AS (PARTITION BY dataset_id)")
def scale_minmax(spark, sf):
    return prep.scaled(fx.observations(spark, sf).withColumn("v", F.get("x", F.lit(0))), ["dataset_id"], "v", "minmax")


@query("scale_robust", "dataset_id:l row_id:l scaled:d", with_(OBS, "st AS (SELECT dataset_id, quantile_cont(x0, 0.5e0) AS m, quantile_cont(x0, 0.75e0) - quantile_cont(x0, 0.25e0) AS w FROM obs GROUP BY 1)") + "SELECT obs.dataset_id, row_id, (x0 - m) / w AS scaled FROM obs JOIN st ON obs.dataset_id = st.dataset_id")
def scale_robust(spark, sf):
    return prep.scaled(fx.observations(spark, sf).withColumn("v", F.get("x", F.lit(0))), ["dataset_id"], "v", "robust")


@query("scale_quantile", "dataset_id:l row_id:l scaled:d", with_(OBS) + "SELECT dataset_id, row_id, (rank() OVER (PARTITION BY dataset_id ORDER BY x0) - 1 + (count(*) OVER (PARTITION BY dataset_id, x0) - 1) / 2e0) / greatest(count(*) OVER (PARTITION BY dataset_id) - 1, 1) AS scaled FROM obs")
def scale_quantile(spark, sf):
    return prep.scaled(fx.observations(spark, sf).withColumn("v", F.get("x", F.lit(0))), ["dataset_id"], "v", "quantile")


@query("membership_by_rowcount", "l_suppkey:l n_rows:l label:l", "SELECT l_suppkey, count(*) AS n_rows, CASE WHEN count(*) > 600 THEN 1 ELSE 0 END AS label FROM lineitem GROUP BY 1")
def membership_by_rowcount(spark, sf):
    return readers.membership_by_rows(fx.table(spark, sf, "lineitem"), "l_suppkey", 600)


@query("membership_by_passage", "item_id:l label:l n_documents:l", "SELECT b.item_id, CASE WHEN count(d.doc_id) > 0 THEN 1 ELSE 0 END AS label, count(d.doc_id) AS n_documents FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def membership_by_passage(spark, sf):
    items = fx.table(spark, sf, "benchmark")
    hits = readers.passages(items, fx.table(spark, sf, "documents"), "item_id", "doc_id").groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.when(F.col("n_documents") > 0, 1).otherwise(0).alias("label"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


@query("member_lookup", "s_suppkey:l label:l", "SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_tax = 0) THEN 1 ELSE 0 END AS label FROM supplier")
def member_lookup(spark, sf):
    seen = fx.table(spark, sf, "lineitem").where("l_quantity >= 50 and l_tax = 0").select(F.col("l_suppkey").alias("s_suppkey"))
    return readers.labelled(fx.table(spark, sf, "supplier"), seen, "s_suppkey")


@query("prior_batches", "step:l table_id:l n:l", "w AS (SELECT i // 3 AS step, (i + 4) % 7 AS table_id FROM (SELECT unnest(generate_series(0, 11)) AS i)) :: SELECT step, w.table_id, count(*) AS n FROM w JOIN lineitem ON l_suppkey = w.table_id GROUP BY 1, 2")
def prior_batches(spark, sf):
    dump = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("table_id"))
    return readers.prior_batches(dump, 3, 7, first=4, steps=4).groupBy("step", "table_id").agg(F.count("*").alias("n"))


@query("prior_tables", "table_id:l row_id:l split:s", with_(OBS) + f"SELECT dataset_id AS table_id, row_id, CASE WHEN row_number() OVER (PARTITION BY dataset_id ORDER BY {key(42, 'prior', 'dataset_id', 'row_id')}, row_id) <= 300 THEN 'train' ELSE 'test' END AS split FROM obs")
def prior_tables(spark, sf):
    return readers.prior_tables(fx.observations(spark, sf).select(F.col("dataset_id").alias("table_id"), "row_id", "x", "y", F.lit(300).alias("single_eval_pos")))


@query("path_index", "id:s path:s", "SELECT CAST(s_suppkey % 10 AS VARCHAR) AS id, min('chunk-' || s_suppkey || '/a/' || (s_suppkey % 10) || '.parquet') AS path FROM supplier GROUP BY 1")
def path_index(spark, sf):
    k = F.col("s_suppkey")
    return readers.path_index(fx.table(spark, sf, "supplier").select(F.concat(F.lit("chunk-"), k, F.lit("/a/"), k % 10, F.lit(".parquet")).alias("path")))


@query("split_random", "dataset_id:l row_id:l split:s", with_(OBS) + f"SELECT dataset_id, row_id, CASE WHEN row_number() OVER (PARTITION BY dataset_id ORDER BY {key(42, 'split', 'dataset_id', 'row_id')}, row_id) <= ceil(count(*) OVER (PARTITION BY dataset_id) * 0.3e0) THEN 'test' ELSE 'train' END AS split FROM obs")
def split_random(spark, sf):
    return split.random_split(fx.observations(spark, sf), ["dataset_id"], 0.3, 42)


@query("split_stratified", "dataset_id:l row_id:l y:l split:s", with_(OBS, "c AS (SELECT dataset_id, y, count(*) AS c FROM obs GROUP BY 1, 2)", "q AS (SELECT dataset_id, y, floor(c * 0.3e0) AS b, row_number() OVER (PARTITION BY dataset_id ORDER BY round(c * 0.3e0 - floor(c * 0.3e0), 9) DESC, y) AS p, ceil(sum(c) OVER (PARTITION BY dataset_id) * 0.3e0) - sum(floor(c * 0.3e0)) OVER (PARTITION BY dataset_id) AS l FROM c)") + f"SELECT o.dataset_id, row_id, o.y, CASE WHEN row_number() OVER (PARTITION BY o.dataset_id, o.y ORDER BY {key(42, 'strat', 'o.dataset_id', 'o.y', 'row_id')}, row_id) <= b + CASE WHEN p <= l THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS split FROM obs o JOIN q ON o.dataset_id = q.dataset_id AND o.y = q.y")
def split_stratified(spark, sf):
    return split.stratified_split(fx.observations(spark, sf), ["dataset_id"], "y", 0.3, 42)


@query("row_cap", "dataset_id:l row_id:l", with_(OBS) + f"SELECT dataset_id, row_id FROM obs QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY {key(42, 'cap', 'dataset_id', 'row_id')}, row_id) <= 200")
def row_cap(spark, sf):
    return split.row_cap(fx.observations(spark, sf), ["dataset_id"], 200, 42)


@query("kfold_stratified", "dataset_id:l row_id:l fold:l", with_(OBS, "m AS (SELECT dataset_id, least(5, min(c)) AS k FROM (SELECT dataset_id, y, count(*) AS c FROM obs GROUP BY 1, 2) GROUP BY 1)") + f"SELECT o.dataset_id, row_id, (row_number() OVER (PARTITION BY o.dataset_id, y ORDER BY {key(0, 'fold', 'o.dataset_id', 'y', 'row_id')}, row_id) - 1) % k AS fold FROM obs o JOIN m ON o.dataset_id = m.dataset_id")
def kfold_stratified(spark, sf):
    return split.folds(fx.observations(spark, sf), ["dataset_id"], "y", 0)


@query("known_suspect_split", "dataset_id:l row_id:l pile:s", with_(OBS, "b AS (SELECT *, CASE WHEN y = 2 THEN 1 ELSE 0 END AS m FROM obs)") + f"SELECT dataset_id, row_id, CASE WHEN m = 0 AND row_number() OVER (PARTITION BY dataset_id, m ORDER BY {key(3, 'known', 'dataset_id', 'm', 'row_id')}, row_id) <= greatest(5, round_even(count(*) OVER (PARTITION BY dataset_id, m) * 0.5e0, 0)) THEN 'known' ELSE 'suspect' END AS pile FROM b")
def known_suspect_split(spark, sf):
    return split.known_suspect(fx.observations(spark, sf).withColumn("m", F.when(F.col("y") == 2, 1).otherwise(0)), ["dataset_id"], "m", 3)


@query("first_n", "p_brand:s p_partkey:l", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3")
def first_n(spark, sf):
    return split.first_n(fx.table(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", 3, "p_partkey")


@query("shard_round_robin", "c_custkey:l shard:l", "SELECT c_custkey, c_custkey % 7 AS shard FROM customer")
def shard_round_robin(spark, sf):
    return split.shard(fx.table(spark, sf, "customer"), "c_custkey", 7)


@query("leave_one_out", "held:l mean_rest:d", "SELECT a.s_suppkey AS held, avg(b.s_acctbal) AS mean_rest FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey GROUP BY 1")
def leave_one_out(spark, sf):
    return split.leave_one_out(fx.table(spark, sf, "supplier"), "s_suppkey").groupBy("held").agg(F.avg("s_acctbal").alias("mean_rest"))


@query("nn_split", "dataset_id:l row_id:l side:l")
def nn_split(spark, sf):
    return split.nn_split(fx.observations(spark, sf))


def roles(spark, sf):
    return manip.with_roles(fx.observations(spark, sf))


def flat(df):
    return df.select("*", *[F.get("x", F.lit(j)).alias(f"x{j}") for j in range(4)])


@query("manip_roles", "dataset_id:l row_id:l role:s", with_(OBS, ROLES) + "SELECT * FROM roles")
def manip_roles(spark, sf):
    return roles(spark, sf)


@query("manip_task_shuffle", "dataset_id:l row_id:l y:d x0:d x3:d", with_(OBS, ROLES, "eg AS (SELECT dataset_id, quantile_cont(x1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM roles WHERE role = 'context' GROUP BY 1)", "ex AS (SELECT DISTINCT dataset_id, unnest(e) AS e FROM eg)") + "SELECT r.dataset_id, r.row_id, count(ex.e) AS y, any_value(x0) AS x0, any_value(y) AS x3 FROM roles r LEFT JOIN ex ON ex.dataset_id = r.dataset_id AND ex.e <= r.x1 GROUP BY 1, 2")
def manip_task_shuffle(spark, sf):
    return flat(manip.task_shuffle(roles(spark, sf), 1))


@query("manip_feature_transform", "dataset_id:l row_id:l a:d b:d c:d e:d", with_(OBS) + "SELECT dataset_id, row_id, sign(x1) * ln(1 + abs(x1)) AS a, sign(x1) * sqrt(abs(x1)) AS b, x0 * x0 AS c, sign(x1) / (1 + abs(x1)) AS e FROM obs")
def manip_feature_transform(spark, sf):
    obs = fx.observations(spark, sf)
    x = lambda k, j: F.get(F.transform("x", manip.TRANSFORMS[k]), F.lit(j))
    return obs.select("dataset_id", "row_id", x("log", 1).alias("a"), x("sqrt", 1).alias("b"), x("square", 0).alias("c"), x("reciprocal", 1).alias("e"))


@query("manip_row_shuffle", "dataset_id:l row_id:l role:s ord:l", with_(OBS, ROLES) + f"SELECT dataset_id, row_id, role, row_number() OVER (PARTITION BY dataset_id, role ORDER BY CASE WHEN role = 'context' THEN {key(200, 'rows', 'dataset_id', 'row_id')} END, row_id) - 1 AS ord FROM roles")
def manip_row_shuffle(spark, sf):
    return manip.row_shuffle(roles(spark, sf), 200)


@query("manip_subsample_rows", "dataset_id:l row_id:l role:s", with_(OBS, ROLES) + f"SELECT dataset_id, row_id, role FROM roles QUALIFY role = 'query' OR row_number() OVER (PARTITION BY dataset_id, role ORDER BY {key(42, 'sub', 'dataset_id', 'row_id')}, row_id) <= 64")
def manip_subsample_rows(spark, sf):
    return manip.subsample_rows(roles(spark, sf), 64)


@query("manip_subsample_columns", "dataset_id:l row_id:l s:d", with_(OBS, "k AS (SELECT j FROM (SELECT unnest([0, 1, 2, 3]) AS j) QUALIFY row_number() OVER (ORDER BY md5('9|cols|' || j), j) <= 2)", "up AS (SELECT dataset_id, row_id, unnest([0, 1, 2, 3]) AS j, unnest([x0, x1, x2, x3]) AS v FROM obs)") + "SELECT dataset_id, row_id, sum(v) AS s FROM up JOIN k ON up.j = k.j GROUP BY 1, 2")
def manip_subsample_columns(spark, sf):
    return manip.subsample_columns(fx.observations(spark, sf), 4, 2, 9).withColumn("s", F.get("x", F.lit(0)) + F.get("x", F.lit(1)))


def _z(j: int) -> str:
    k = ("dataset_id", "row_id", str(j))
    return f"sqrt(-2e0 * ln(greatest({uniform(5, 'noise', *k)}, 1e-12))) * cos(6.283185307179586e0 * {uniform(5, 'noise', *k, at=9)})"


@query("manip_noise", "dataset_id:l row_id:l x0:d x1:d", with_(OBS, ROLES, "sd AS (SELECT dataset_id, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1 FROM roles WHERE role = 'context' GROUP BY 1)") + f"SELECT dataset_id, row_id, CASE WHEN role = 'context' THEN x0 + 0.2e0 * (s0 + {EPS}) * z0 ELSE x0 END AS x0, CASE WHEN role = 'context' THEN x1 + 0.2e0 * (s1 + {EPS}) * z1 ELSE x1 END AS x1 FROM (SELECT r.*, s0, s1, {_z(0).replace('CAST(dataset_id', 'CAST(r.dataset_id')} AS z0, {_z(1).replace('CAST(dataset_id', 'CAST(r.dataset_id')} AS z1 FROM roles r JOIN sd ON r.dataset_id = sd.dataset_id)")
def manip_noise(spark, sf):
    return flat(manip.inject_noise(roles(spark, sf), 0.2, 5))


@query("manip_label_permutation", "dataset_id:l row_id:l y:l", with_(OBS, "a AS (SELECT dataset_id, y, row_number() OVER (PARTITION BY dataset_id ORDER BY y) AS r FROM (SELECT DISTINCT dataset_id, y FROM obs))", f"b AS (SELECT dataset_id, y, row_number() OVER (PARTITION BY dataset_id ORDER BY {key(100, 'perm', 'dataset_id', 'y')}, y) AS r FROM (SELECT DISTINCT dataset_id, y FROM obs))") + "SELECT o.dataset_id, o.row_id, b.y FROM obs o JOIN a ON o.dataset_id = a.dataset_id AND o.y = a.y JOIN b ON a.dataset_id = b.dataset_id AND a.r = b.r")
def manip_label_permutation(spark, sf):
    return manip.label_permutation(fx.observations(spark, sf), 100)


@query("manip_constant_label", "dataset_id:l row_id:l y:l", with_(OBS, ROLES, "m AS (SELECT dataset_id, y FROM roles WHERE role = 'context' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, min(row_id)) = 1)") + "SELECT r.dataset_id, r.row_id, CASE WHEN role = 'context' THEN m.y ELSE r.y END AS y FROM roles r JOIN m ON r.dataset_id = m.dataset_id")
def manip_constant_label(spark, sf):
    return manip.constant_labels(roles(spark, sf))


LEVELS = "ls AS (SELECT dataset_id, list(DISTINCT y ORDER BY y) AS ls FROM roles WHERE role = 'context' GROUP BY 1)"


def other(seed: int, tag: str, *cols: str, y: str = "y") -> str:
    """SQL for a seeded label of ls other than y."""
    rest = f"list_filter(ls, lambda v: v <> {y})"
    return f"CASE WHEN len({rest}) = 0 THEN {y} ELSE {rest}[CAST(least(floor({uniform(seed, tag, *cols)} * len({rest})), len({rest}) - 1) AS BIGINT) + 1] END"


MISLABEL = f"mk AS (SELECT *, role = 'context' AND row_number() OVER (PARTITION BY dataset_id, role ORDER BY {key(11, 'mis', 'dataset_id', 'row_id')}, row_id) <= floor(sum(CASE WHEN role = 'context' THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id) * 0.2e0) AS hit FROM roles)"


@query("manip_mislabel_random", "dataset_id:l row_id:l y:l", with_(OBS, ROLES, LEVELS, MISLABEL) + f"SELECT dataset_id, row_id, CASE WHEN hit THEN {other(11, 'to', 'dataset_id', 'row_id')} ELSE y END AS y FROM (SELECT mk.*, ls FROM mk JOIN ls ON mk.dataset_id = ls.dataset_id)")
def manip_mislabel_random(spark, sf):
    return manip.mislabel_random(roles(spark, sf), 0.2, 11)


@query("manip_mislabel_swap", "dataset_id:l row_id:l y:l", with_(OBS, ROLES, MISLABEL, "tp AS (SELECT dataset_id, max(CASE WHEN r = 1 THEN y END) AS l1, max(CASE WHEN r = 2 THEN y END) AS l2 FROM (SELECT dataset_id, y, row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, y) AS r FROM roles WHERE role = 'context' GROUP BY 1, 2) GROUP BY 1)") + "SELECT mk.dataset_id, row_id, CASE WHEN hit AND l2 IS NOT NULL AND y = l1 THEN l2 WHEN hit AND l2 IS NOT NULL AND y = l2 THEN l1 ELSE y END AS y FROM mk JOIN tp ON mk.dataset_id = tp.dataset_id")
def manip_mislabel_swap(spark, sf):
    return manip.mislabel_swap(roles(spark, sf), 0.2, 11)


VECTORS = f"vr AS (SELECT 0 AS dataset_id, CAST(vec_id AS BIGINT) AS row_id, CAST(embedding AS DOUBLE[]) AS x, label AS y FROM embeddings), ranked AS (SELECT *, row_number() OVER (ORDER BY {key(42, 'role', 'dataset_id', 'row_id')}, row_id) AS rr, count(*) OVER () AS rn FROM vr), roles AS (SELECT dataset_id, row_id, x, y, CASE WHEN rr <= ceil(rn * 0.3e0) THEN 'query' ELSE 'context' END AS role FROM ranked)"


@query("manip_mislabel_boundary", "row_id:l y:l", VECTORS + ", nb AS (SELECT a.row_id, b.y <> a.y AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.x, b.x), b.row_id) AS r FROM roles a JOIN roles b ON a.row_id <> b.row_id WHERE a.role = 'context' AND b.role = 'context'), dg AS (SELECT row_id, avg(CASE WHEN d THEN 1e0 ELSE 0e0 END) AS g FROM nb WHERE r <= 4 GROUP BY 1), pl AS (SELECT row_id, row_number() OVER (ORDER BY g DESC, row_id) <= floor(count(*) OVER () * 0.2e0) AS hit FROM dg), " + LEVELS + f" :: SELECT row_id, CASE WHEN hit THEN {other(11, 'to', 'dataset_id', 'row_id')} ELSE y END AS y FROM (SELECT roles.*, ls, hit FROM roles LEFT JOIN pl USING (row_id) JOIN ls ON roles.dataset_id = ls.dataset_id)")
def manip_mislabel_boundary(spark, sf):
    return manip.mislabel_boundary(manip.with_roles(fx.vectors(spark, sf)), 0.2, 11)


DRAWS = """cx AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) - 1 AS i FROM roles WHERE role = 'context'),
  nn AS (SELECT dataset_id, count(*) AS n FROM cx GROUP BY 1),
  dd AS (SELECT dataset_id, n, unnest(generate_series(1, CAST(greatest(1, floor(n * 0.1e0)) AS BIGINT))) AS d FROM nn)"""


def drawn(seed: int, tag: str) -> str:
    return f"dr AS (SELECT dd.dataset_id, d, CAST(least(floor({uniform(seed, tag, 'dd.dataset_id', 'd')} * n), n - 1) AS BIGINT) AS i FROM dd)"


@query("manip_row_duplication", "dataset_id:l row_id:l role:s y:l copy:l", with_(OBS, ROLES, DRAWS, drawn(8, "dup")) + "SELECT dataset_id, row_id, role, y, 0 AS copy FROM roles UNION ALL SELECT cx.dataset_id, row_id, role, y, d FROM dr JOIN cx ON dr.dataset_id = cx.dataset_id AND dr.i = cx.i")
def manip_row_duplication(spark, sf):
    return manip.row_duplication(roles(spark, sf), 0.1, 8)


@query("manip_truth_serum", "dataset_id:l row_id:l role:s y:l copy:l", with_(OBS, ROLES, DRAWS, drawn(8, "serum"), LEVELS) + f"SELECT dataset_id, row_id, role, y, 0 AS copy FROM roles UNION ALL SELECT dataset_id, row_id, role, {other(8, 'to', 'dataset_id', 'd')}, d FROM (SELECT cx.dataset_id, row_id, role, y, d, ls FROM dr JOIN cx ON dr.dataset_id = cx.dataset_id AND dr.i = cx.i JOIN ls ON ls.dataset_id = cx.dataset_id)")
def manip_truth_serum(spark, sf):
    return manip.truth_serum(roles(spark, sf), 0.1, 8)


def leaked(tag: str, known: bool) -> str:
    only = "AND EXISTS (SELECT 1 FROM roles c WHERE c.dataset_id = q.dataset_id AND c.role = 'context' AND c.y = q.y)" if known else ""
    return f"nn AS (SELECT dataset_id, count(*) AS n FROM roles WHERE role = 'context' GROUP BY 1), lk AS (SELECT * FROM (SELECT q.dataset_id, row_id, y, n, row_number() OVER (PARTITION BY q.dataset_id ORDER BY {key(9, tag, 'q.dataset_id', 'row_id')}, row_id) AS r FROM roles q JOIN nn ON q.dataset_id = nn.dataset_id WHERE role = 'query' {only}) WHERE r <= greatest(1, floor(n * 0.1e0)))"


@query("manip_query_leakage", "dataset_id:l row_id:l role:s y:l copy:l", with_(OBS, ROLES, leaked("leak", True)) + "SELECT dataset_id, row_id, role, y, 0 AS copy FROM roles UNION ALL SELECT dataset_id, row_id, 'context', y, 1 FROM lk")
def manip_query_leakage(spark, sf):
    return manip.query_leakage(roles(spark, sf), 0.1, 9)


@query("manip_brainwash", "dataset_id:l row_id:l role:s y:l copy:l", with_(OBS, ROLES, leaked("wash", False), LEVELS) + f"SELECT dataset_id, row_id, role, y, 0 AS copy FROM roles UNION ALL SELECT dataset_id, row_id, 'context', {other(9, 'to', 'dataset_id', 'row_id')}, 1 FROM (SELECT lk.*, ls FROM lk JOIN ls ON lk.dataset_id = ls.dataset_id)")
def manip_brainwash(spark, sf):
    return manip.brainwash(roles(spark, sf), 0.1, 9)


@query("manip_context_equals_query", "dataset_id:l row_id:l role:s", with_(OBS, ROLES) + "SELECT dataset_id, row_id, 'context' AS role FROM roles WHERE role = 'context' UNION ALL SELECT dataset_id, row_id, 'query' FROM roles WHERE role = 'context'")
def manip_context_equals_query(spark, sf):
    return manip.context_equals_query(roles(spark, sf))
