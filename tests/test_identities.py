"""Identities that the audit's numbers must meet, and small versions of what SQL cannot say."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.functions import rng, stats
from auditloom.operators import audit, curves, manip, measure, models, predict, prep, profile, signals, split
from auditloom.plans import sweeps
from auditloom.sinks import writers
from auditloom.sources import fixtures as fx
from auditloom.sources import readers


def test_signal_counts():
    names = sweeps.signal_names()
    assert len(names) == len(set(names)) == 678
    assert sum(s != "ctx" for _, s in names) == 623
    assert len(sweeps.signal_names("regression")) == 565


def test_plan_shares_runs(spark):
    plan = sweeps.plan(spark, 20, 1000)
    assert sweeps.fits(plan).agg(F.sum("entries")).first()[0] == plan.count()
    done = plan.where("sweep = 'base'")
    assert sweeps.misses(plan, done).count() == sweeps.fits(plan).count() - 1


def test_auc_flips(spark):
    rows = spark.createDataFrame([(1, float(i % 7), i % 3 == 0) for i in range(60)], "g int, s double, l boolean").withColumn("l", F.col("l").cast("int"))
    a = stats.auc(rows, ["g"], "s", "l").first()["auc"]
    b = stats.auc(rows.withColumn("s", -F.col("s")), ["g"], "s", "l").first()["auc"]
    pdf = rows.toPandas()
    assert a + b == pytest.approx(1) and a == pytest.approx(models.rank_auc(pdf.s.to_numpy(), pdf.l.to_numpy()))


def test_auc_of_one_class_is_null(spark):
    assert stats.auc(spark.createDataFrame([(1, 0.5, 1)], "g int, s double, l int"), ["g"], "s", "l").first()["auc"] is None


def test_all_tied_scores(spark):
    rows = spark.createDataFrame([(1, 0.5, i % 2) for i in range(10)], "g int, s double, l int")
    assert stats.auc(rows, ["g"], "s", "l").first()["auc"] == 0.5


def test_kl_of_the_clean_point_is_zero(spark, sf):
    v = fx.variants(spark, sf)
    zero = measure.kl_to_clean(v, v.where("variant = 0"), ["variant"], ["dataset_id", "row_id"]).where("variant = 0").first()
    assert zero["kl2clean"] == pytest.approx(0, abs=1e-12) and zero["rkl2clean"] == pytest.approx(0, abs=1e-12)


def test_softening_keeps_the_class(spark, sf):
    p = fx.predictions(spark, sf)
    assert predict.temperature(p, 2.0).select("dataset_id", "row_id", F.col("pred").alias("b")).join(p, ["dataset_id", "row_id"]).where("pred <> b").count() == 0


def test_conformal_is_a_share(spark, sf):
    p = fx.predictions(spark, sf).withColumn("s", F.array_max("probs"))
    out = stats.conformal(p.where("y = 0"), p.where("y = 1"), ["dataset_id"], "s").agg(F.min("p_value"), F.max("p_value")).first()
    assert 0 < out[0] <= out[1] <= 1


def test_partitioning_changes_nothing(spark, sf):
    rows = manip.with_roles(fx.observations(spark, sf))
    one = lambda n: manip.mislabel_random(rows.repartition(n), 0.2, 11).orderBy("dataset_id", "row_id").select("y").toPandas()
    pd.testing.assert_frame_equal(one(1), one(17))


def test_curve_edges(spark):
    rows = spark.createDataFrame([("few", 1.0, 0.5), ("flat", 0.0, 0.0), ("flat", 1.0, 0.0), ("nan", 0.0, float("nan")), ("nan", 1.0, 1.0), ("none", 0.0, None), ("none", 2.0, 3.0), ("none", 4.0, 5.0)], "k string, intensity double, value double")
    got = {r["k"]: r for r in curves.trajectory(rows, ["k"]).collect()}
    assert got["few"]["slope"] is None and got["nan"]["gain"] is None
    assert got["flat"]["early"] == 0 and got["none"]["gain"] == 2 and got["none"]["slope"] == pytest.approx(1)


def test_labels_out_of_range(spark):
    rows = spark.createDataFrame([(1, 0, [0.7, 0.3], 0), (1, 5, [0.4, 0.6], 1)], "g int, y int, probs array<double>, pred int")
    got = measure.classification(rows, ["g"]).first()
    assert got["loss"] is None and got["correct_confidence"] == pytest.approx(0.65)


def test_one_class_chi_squared_is_null(spark):
    rows = spark.createDataFrame([(1, 0, 0)], "g int, y int, pred int")
    assert measure.chi_squared(rows, ["g"]).first()["chi_squared"] is None


def test_plug_in_needs_two_classes(spark):
    rows = spark.createDataFrame([(1, "default", "context", i, [float(i)], 0) for i in range(4)] + [(1, "default", "query", 9, [1.0], 0)], "dataset_id int, manip_key string, role string, row_id int, x array<double>, y int")
    assert predict.plug_in(rows, lambda: None).count() == 0


def test_clean_and_bins(spark):
    rows = spark.createDataFrame([(1, "1.5"), (1, "x"), (1, "inf"), (1, "3.4e38"), (1, None)], "g int, v string")
    assert [r[0] for r in rows.select(prep.clean("v")).collect()] == [1.5, None, None, None, None]
    ten = spark.createDataFrame([(1, float(i)) for i in range(100)], "g int, v double")
    assert prep.quantile_bin(ten, ten, ["g"], "v").select("bin").distinct().count() == 10
    few = spark.createDataFrame([(1, 3.0), (1, 4.0)], "g int, v double")
    assert {r["bin"] for r in prep.quantile_bin(few, few, ["g"], "v").collect()} == {3.0, 4.0}


def test_profile_finds_dates(spark):
    rows = spark.createDataFrame([("2020-01-02", "a"), (None, "b"), ("2020-01-03T10:00:00", None)], "d string, s string")
    got = {r["col_name"]: r for r in profile.profile(rows, F.lit(0), ["d", "s"]).collect()}
    assert got["d"]["is_date"] and not got["s"]["is_date"] and got["s"]["n_null"] == 1


def test_nn_split_against_a_plain_loop(spark):
    rng_ = np.random.default_rng(0)
    points = rng_.normal(size=(60, 3)).round(1)
    points[7, 1] = np.nan
    rows = spark.createDataFrame([(1, i, p.tolist()) for i, p in enumerate(points)], "dataset_id long, row_id long, x array<double>")
    got = split.nn_split(rows).toPandas().sort_values("row_id").side.tolist()
    filled = np.where(np.isnan(points), np.nanmedian(points, axis=0), points)
    want: dict[int, int] = {}
    for i in range(60):
        if i not in want:
            want[i] = 0
            nearest = min((j for j in range(60) if j != i), key=lambda j: (((filled[i] - filled[j]) ** 2).sum(), j))
            want.setdefault(nearest, 1)
    assert got == [want[i] for i in range(60)] and any(want[i] == 0 and want[j] == 0 for i in want for j in [min((j for j in range(60) if j != i), key=lambda j: ((filled[i] - filled[j]) ** 2).sum())])
    assert split.nn_split(rows.where("row_id < 9")).count() == 0


def test_neighbours_in_many_blocks(spark, sf, monkeypatch):
    rows = manip.with_roles(fx.vectors(spark, sf).limit(300))
    parts = [rows.where(f"role = '{r}'").drop("role") for r in ("context", "query")]
    order = ["row_id", "rank"]
    one = predict.neighbours(*parts, 5).select("row_id", "nid", "rank", "d").orderBy(*order).collect()
    monkeypatch.setattr(predict, "BLOCK_ROWS", 37)
    assert predict.neighbours(*parts, 5).select("row_id", "nid", "rank", "d").orderBy(*order).collect() == one and len(one) == 5 * parts[1].count()


def test_passages_by_word(spark):
    items = spark.createDataFrame([(1, "the zebra crossed"), (2, "word"), (3, "ab cd"), (4, None), (5, "no such passage here")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "then the zebra crossed it"), (2, "xthe zebra crossedy"), (3, "the zebra  crossed"), (4, "swords cab cde"), (5, None)], "doc_id int, text string")
    assert sorted(tuple(r) for r in readers.passages(items, docs, "item_id", "doc_id").collect()) == [(1, 1), (1, 2), (2, 4), (3, 4)]


def test_over_ten_classes_is_an_error(spark):
    from pyspark.errors import PySparkException

    rows = spark.createDataFrame([(1, str(i)) for i in range(11)], "g int, v string")
    with pytest.raises(PySparkException, match="more than 10 classes"):
        prep.label_encode(rows, ["g"], "v").collect()


def test_loo_logistic_matches_refits():
    g = np.random.default_rng(1)
    x, y = g.normal(size=(30, 2)), (g.random(30) < 0.5).astype(int)
    out = models.leave_one_out(x, y)
    keep = np.arange(30) != 4
    assert out[4] == pytest.approx(models.probability(models.logistic(x[keep], y[keep]), x[4:5])[0])


def test_forest_finds_the_outlier():
    x = np.vstack([np.random.default_rng(2).normal(size=(200, 3)), [[9, 9, 9]]])
    assert models.Forest(50).fit(x[:200]).score(x).argmax() == 200


def test_contributions_sum_to_the_margin():
    g = np.random.default_rng(3)
    x = g.normal(size=(80, 4))
    model = models.BoostedTrees(rounds=20).fit(x, (x[:, 0] + 0.2 * x[:, 1] > 0).astype(int))
    phi = model.contributions(x)
    rest = model.margin(x) - phi.sum(1)
    assert rest == pytest.approx(np.full(80, rest[0])) and np.abs(phi).mean(0).argmax() == 0


def test_elbow(spark):
    curves_ = {"bend": {1: 0.5, 2: 0.8, 4: 0.82, 8: 0.83}, "flat": {1: 0.5, 2: 0.5, 4: 0.5}, "two": {1: 0.5, 2: 0.7}}
    rows = spark.createDataFrame([(g, k, v) for g, c in curves_.items() for k, v in c.items()], "g string, k int, value double")
    assert {r["g"]: r["k_star"] for r in models.elbow_table(rows, ["g"]).collect()} == {"bend": 2, "flat": 1, "two": 2}


def test_combinations_by_place():
    from itertools import combinations

    for n, k in ((6, 1), (6, 3), (7, 5)):
        assert [tuple(models._combination(n, k, i)) for i in range(math.comb(n, k))] == list(combinations(range(n), k))


def test_internal_audit_separates(spark):
    draw = lambda *key: float(np.random.default_rng(key).normal())
    rows = [(i, i % 2, f"base_{s}", draw(i, j) + 2 * (i % 2) * (s == "a"), draw(i, j, 1)) for i in range(120) for j, s in enumerate("abcd")]
    pool = spark.createDataFrame(rows, "dataset_id long, y int, signal string, xt double, xb double")
    names = [f"base_{s}" for s in "abcd"]
    got = {r["kind"]: r for r in audit.internal(pool, {"ALL": names}, replicates=50).collect()}
    assert set(got) == {"lr", "trees"} and all(r["target"] > 0.8 > r["blind"] and r["n_cols"] == 4 and r["k_star"] in (1, 2, 4) for r in got.values())
    assert audit.contributions(pool).where("target_rank = 1").first()["signal"] == "base_a"


def test_external_audit_separates(spark):
    rows = [(i, int(i >= 60), f"base_{s}", float(np.random.default_rng([i, j]).normal() + 3 * (i >= 60) * (s == "a")), float(np.random.default_rng([i, j, 1]).normal())) for i in range(120) for j, s in enumerate("abc")]
    pool = spark.createDataFrame(rows, "dataset_id long, y int, signal string, xt double, xb double")
    got = audit.evaluate(audit.external(pool, {"ALL": ["base_a", "base_b", "base_c"]}, draws=3, screened=False, trees=50)).first()
    assert got["target_auc"] > 0.8 > got["blind_auc"] and got["draws"] == 3


def test_alignment_errors(spark):
    t = spark.createDataFrame([(1, 0, 0.5, True), (2, 1, 0.6, True)], "dataset_id int, label int, base_loss double, success boolean")
    assert signals.align(t, t).count() == 2
    with pytest.raises(signals.Misaligned):
        signals.align(t, t.where("dataset_id = 1"))
    with pytest.raises(signals.Misaligned):
        signals.align(t, t.withColumn("label", F.lit(1)))


def test_upsert_and_names(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "dataset_id int, a double")
    assert {tuple(r) for r in signals.upsert(old, spark.createDataFrame([(2, 5.0), (3, 6.0)], "dataset_id int, a double")).collect()} == {(1, 1.0), (2, 5.0), (3, 6.0)}
    twice = spark.createDataFrame([(2, 5.0), (2, 6.0)], "dataset_id int, a double")
    for pair in ((old, twice), (twice, old)):
        with pytest.raises(ValueError):
            signals.upsert(*pair)
    row = spark.createDataFrame([("ctx_kl2clean_late_gain",), ("mislbl_random_loss_auc",), ("other_thing",)], "signal string").select(signals.described("signal").alias("d"), signals.family("signal").alias("f")).collect()
    assert row[0]["d"]["feature"] == "RowSampling_KLDClean_LateGain" and row[0]["d"]["reduction"] == "R6"
    assert row[1]["d"]["feature"] == "LabelCorruption_CELoss_AUC" and row[2]["f"] == "other" and row[2]["d"]["feature"] is None


def test_sinks_round_trip(spark, tmp_path):
    long = spark.createDataFrame([(1, "base_loss", 0.5), (2, "base_loss", 0.7)], "dataset_id int, signal string, value double")
    meta = spark.createDataFrame([(1, 1, "classification"), (2, 0, "classification")], "dataset_id int, true_label int, task_type string")
    writers.write_datasets(long, meta, ["base_loss"], str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert set(back.columns) == {"dataset_id", "true_label", "task_type", "base_loss", "label"} and back.count() == 2
    writers.write_samples([long.select("dataset_id"), meta.select("dataset_id", "true_label")], str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    pred = spark.createDataFrame([("m", "1", "all", 0.5)], "model string, dataset_id string, part string, p double")
    writers.cache_predictions(pred, str(tmp_path / "c"))
    writers.cache_predictions(pred.withColumn("dataset_id", F.lit("2")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    assert "| 1 |" in writers.markdown(meta, ["dataset_id"], ["dataset_id"]) and "tabular" in writers.latex(meta, ["dataset_id"], ["dataset_id"])


def test_readers(spark, tmp_path, sf):
    assert readers.load(spark, "parquet", "nation", root=sf).count() == 25
    with pytest.raises(KeyError):
        readers.load(spark, "nowhere", "x")
    dump = readers.generated(spark, 3, 20, 4)
    assert readers.load(spark, "synthetic", "1", dump=dump).count() == 20
    assert {r["split"] for r in readers.prior_tables(dump).collect()} == {"train", "test"}
    index = readers.path_index(readers.listed(spark, sf))
    assert index.where("id = 'nation'").count() == 1
    assert readers.load(spark, "index", "region", index=index).count() == 5
    (tmp_path / "r.json").write_text('{"metadata": {}, "successful_results": [{"dataset_id": "a", "x": 1}, {"dataset_id": "b", "x": 2}]}')
    assert readers.results(spark, [str(tmp_path / "r.json")]).count() == 2
    assert readers.registry(spark, {"t4": [1, 2]}, {"t4": [3]}).where("label = 1").count() == 2


def test_upsert_stream(spark, tmp_path):
    from auditloom.streaming.incremental import _versions, upsert_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0.5), (2, 0.6)], "dataset_id int, v double").write.parquet(src)
    run = lambda: upsert_stream(spark, spark.readStream.schema("dataset_id int, v double").parquet(src), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([(2, 0.9), (3, 0.1)], "dataset_id int, v double").write.mode("append").parquet(src)
    run()
    last = _versions(spark, str(tmp_path / "t"))[-1]
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / f"v{last}")).collect()} == {(1, 0.5), (2, 0.9), (3, 0.1)}


def test_hash_normal_moments(spark):
    got = spark.range(20_000).select(rng.normal(1, "t", "id").alias("z")).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(got[0]) < 0.03 and math.isclose(got[1], 1, abs_tol=0.03)
