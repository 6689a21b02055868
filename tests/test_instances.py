"""Instances of tasks, evaluations, registries, readers and report tables, against plain versions."""

from __future__ import annotations

import gzip
import io
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditloom.operators import curves, evaluate, instances, models, profile
from auditloom.sinks import tables, writers
from auditloom.sources import readers, registry


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal()) if i % 9 else float("inf"), ["a", "b", "c", None][i % 4], float(i % 30), "only", f"2020-01-{i % 28 + 1:02d}", float(i)) for i in range(200)]
    return spark.createDataFrame(rows, "id long, num double, cat string, many double, same string, day string, unique double").persist()


def test_forced_classification(raw):
    got = instances.forced_classification(raw, "id", seed=1)
    meta, pdf = got.metadata, got.rows.toPandas()
    assert meta["column"] == "cat" and meta["rule"] == "lowcard" and meta["n_classes"] == 3  # the only column of few values that repeat
    assert len(pdf) == 150 and (pdf.split == "test").sum() == 45 and set(pdf.y) == {0, 1, 2}
    assert got.columns == ["num", "many", "same", "day", "unique"] and all(len(x) == 5 for x in pdf.x)
    assert pdf[pdf.split == "test"].y.value_counts().max() - pdf[pdf.split == "test"].y.value_counts().min() <= 1
    assert all(x[0] is None or np.isnan(x[0]) for i, x in zip(pdf.row_id, pdf.x, strict=True) if i % 9 == 0)
    binned = instances.forced_classification(raw.drop("cat"), "id", seed=1)
    assert binned.metadata["column"] == "many" and binned.metadata["rule"] == "binned" and binned.metadata["n_classes"] <= 10
    with pytest.raises(ValueError):
        instances.forced_classification(raw.limit(20), "id")


def test_binning_looks_at_training_rows_only(spark):
    rows = spark.createDataFrame([(i, float(i % 8) if i < 40 else float(100 + i), "train" if i < 40 else "test", 1) for i in range(60)], "row_id long, y double, split string, _one int")
    out, rule = instances._discretised(rows, True)
    got = {r["row_id"]: r["y"] for r in out.collect()}
    assert rule == "binned" and got[0] == 0.0 and got[7] == 7.0 and got[59] == 7.0


def test_pick_target(raw):
    p = profile.profile(raw, F.lit(0), [c for c in raw.columns if c != "id"])
    assert instances.pick_target(p, 3, "classification") == "cat" == instances.pick_target(p, 3, fewest=True)
    assert instances.pick_target(p, 3) in ("cat", "many", "same")
    only = p.where("col_name = 'unique'")
    with pytest.raises(ValueError):
        instances.pick_target(only, 3, "classification")
    with pytest.warns(UserWarning):
        assert instances.pick_target(only, 3, last="unique") == "unique"
    assert instances.pick_target(only, 3, fewest=True) == "unique"


def test_prepared(raw):
    got = instances.prepared(raw, "id", "many", bin_to=10)
    assert got.metadata["target_was_binned"] and got.metadata["target_type"] == "classification" and got.rows.select("y").distinct().count() <= 10
    plain = instances.prepared(raw, "id", "many")
    assert plain.metadata["target_type"] == "regression" and not plain.metadata["stratified"]
    cat = instances.prepared(raw, "id", "cat")
    assert cat.metadata == {"target_type": "classification", "n_samples": 150, "n_features": 5, "n_classes": 3, "target_was_binned": False, "stratified": True}


def test_feature_matrix(spark):
    fit = spark.createDataFrame([(0, "1", "x", "k", None), (1, "3", "y", "k", "5"), (2, None, "y", "k", "7")], "id int, n string, c string, one string, g string")
    new = spark.createDataFrame([(9, "10", "z", "k", None), (8, None, "x", "k", "6")], "id int, n string, c string, one string, g string")
    got = instances.feature_matrix(fit, new, "id", ["n", "c", "one", "g"])
    assert got.columns == ["n", "c", "g", "n_missing", "g_missing"]
    assert {r["row_id"]: r["x"] for r in got.rows.collect()} == {9: [10.0, 1.0, 6.0, 0.0, 1.0], 8: [2.0, 0.0, 6.0, 1.0, 0.0]}


@pytest.fixture(scope="module")
def sized(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, float(rng.normal() + (i % 2)), float(rng.normal()), float("nan") if i == 7 else float(rng.normal()), "m" if i % 3 else "n") for i in range(120)]
    return spark.createDataFrame(rows, "dataset_id long, y int, n_train double, n_test double, n_features double, model string").persist()


def test_baseline(spark, sized):
    kept, lost = evaluate.minimal(sized)
    assert kept.count() == 119 and [tuple(r) for r in lost.collect()] == [(7, "missing_minimal_features")]
    got = evaluate.baseline(sized, "y", seeds=(0, 1, 2)).toPandas()
    assert list(got.seed.sort_values()) == [0, 1, 2] and (got.overlap_ids == 0).all() and (got.train_members + got.train_others == 24).all() and (got.test_members == 48).all()
    assert got.auc.mean() > 0.65 and (got.tp + got.fn == 48).all() and (got.tpr_at_1fpr <= got.tpr_at_10fpr).all()
    assert evaluate.complete(sized, ["n_features"]).count() == 119


def test_leave_one_out_by_model(sized):
    for anew in (True, False):
        got = evaluate.leave_one_out(sized, ["model"], "dataset_id", "y", "n_train", "n_test", anew).toPandas()
        assert len(got) == 120 and all(models.rank_auc(g.score.to_numpy(), g.y.to_numpy()) > 0.55 for _, g in got.groupby("model"))
    pdf = sized.where("model = 'n'").toPandas().sort_values("dataset_id")
    late, n = pdf.n_train.to_numpy(), len(pdf)
    x = np.column_stack([pd.Series(late).rank() / n, late > np.quantile(late, 0.9), pdf.n_test])
    keep = np.arange(n) != 0
    z = (x - x[keep].mean(0)) / x[keep].std(0)
    want = models.probability(models.logistic(z[keep], pdf.y.to_numpy()[keep]), z[:1])[0]
    assert got[got.model == "n"].sort_values("dataset_id").score.iloc[0] == pytest.approx(want)


def test_usable_and_best(spark):
    rows = [(s, t, d, d % 2, float(d % 2 if s == "good" else 1 if s == "flat" else d)) for s in ("good", "flat", "half") for t in ("p", "q") for d in range(8) if not (s == "half" and t == "q")]
    long = spark.createDataFrame(rows, "signal string, task string, dataset_id int, y int, value double")
    assert [r["signal"] for r in evaluate.usable_everywhere(long).collect()] == ["good"]
    assert tuple(evaluate.best_single(long, "y").first()) == ("good", 1.0)


def test_membership_rules(spark):
    listed = spark.createDataFrame([("a", "1", 1), ("a", "2", 0)], "family string, dataset_id string, label int")
    every = spark.createDataFrame([("a", "1"), ("a", "9"), ("b", "5"), ("b", "6")], "family string, dataset_id string")
    assert {tuple(r) for r in registry.membership(listed, every).collect()} == {("a", "1", 1), ("a", "2", 0), ("b", "5", 0), ("b", "6", 0)}
    assert registry.membership(listed, every, "b").agg(F.max("label")).first()[0] == 0
    with pytest.raises(ValueError):
        registry.membership(listed.where("label = 0"), every)
    sides = registry.synthetic_sides(spark, {"classification": 10, "regression": 4})
    assert sides.count() == 14 and sides.where("label = 1").count() == 7
    assert registry.shared_ids(listed, every) == 1


def test_readers_of_splits_and_arrays(spark, sf, tmp_path):
    spark.range(100).select(F.col("id").alias("row_id"), F.rand(1).alias("v")).write.parquet(str(tmp_path / "t.parquet"))
    got = {r["split"]: r["count"] for r in readers.load(spark, "split", "t", root=str(tmp_path)).groupBy("split").count().collect()}
    assert got == {"test": 15, "valid": 15, "train": 70}
    folder = tmp_path / "task"
    folder.mkdir()
    for name, array in (("X", np.arange(12.0).reshape(6, 2)), ("y", np.array([0, 1, 0, 1, 0, 1]))):
        sink = io.BytesIO()
        np.save(sink, array)
        (folder / f"{name}.npy.gz").write_bytes(gzip.compress(sink.getvalue()))
    (folder / "split_indices.json").write_text(json.dumps([{"train": [0, 1, 2], "test": [3, 4]}]))
    rows = {r["row_id"]: (r["x"], r["y"], r["split"]) for r in readers.load(spark, "arrays", "task", root=str(tmp_path)).collect()}
    assert rows[3] == ([6.0, 7.0], 1.0, "test") and rows[5][2] is None and len(rows) == 6


def test_retries():
    waits, calls = [], []

    def read():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("away")
        return "here"

    assert readers.with_retries(read, sleep=waits.append) == "here" and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        readers.with_retries(lambda: 1 / 0, attempts=2, sleep=waits.append)


def test_guards_and_types(spark, raw):
    assert readers.guarded(raw, "id", ["num", "cat"], "many").groupBy("split").count().count() == 2
    with pytest.raises(ValueError):
        readers.guarded(raw.limit(10), "id", ["num"], "many")
    types = spark.createDataFrame([(1, "classification"), (2, "regression")], "dataset_id int, task_type string")
    assert readers.of_task(types.select("dataset_id"), types).count() == 1
    for prior in ("linear", "mlp", "steps"):
        assert readers.generated(spark, 2, 30, 3, prior=prior).select("y").distinct().count() == 2


def test_padded_dump(spark):
    dump = spark.createDataFrame([(0, 0, [1.0, 2.0], 1.0), (0, 1, [3.0, 4.0], 0.0), (1, 0, [5.0, 6.0, 7.0, 8.0], 1.0)], "table_id long, row_id long, x array<double>, y double")
    got = {(r["table_id"], r["row_id"]): r for r in writers.padded(dump, 3, 3).collect()}
    assert len(got) == 6 and got[0, 1]["x"] == [3.0, 4.0, 0.0] and got[0, 2]["x"] == [0.0] * 3 and got[1, 0]["x"] == [5.0, 6.0, 7.0]
    assert (got[0, 0]["n_rows"], got[0, 0]["n_features"], got[1, 0]["n_features"]) == (2, 2, 3)


def test_flattened_rows(spark):
    rows = [(1, r, "b1", "loss", float(r)) for r in range(3)] + [(1, r, "b2", "gone", float(r)) for r in range(2)]
    got = curves.flattened(spark.createDataFrame(rows, "dataset_id int, row_id int, bundle string, signal string, value double"), ["loss", "gone", "never"]).toPandas().sort_values("row_id")
    assert list(got.columns) == ["dataset_id", "row_id", "loss", "gone", "never"] and got.loss.tolist() == [0.0, 1.0, 2.0] and got.gone.isna().all()


INTERNAL = {"first": {"meta": {"pool": "first"}, "cells": {"ALL": {"n_cols": 9, "lr": {"K": 16, "target": 0.6746, "blind": 0.6858, "gap": -0.0112, "gap_sd": 0.0437, "target_sd": 0.0356, "blind_sd": 0.0354, "p_gap_le_0": 0.5865}}, "no:ctx": {"n_cols": 3, "lr": {"K": 1, "target": 0.9, "blind": 0.8, "gap": 0.1, "gap_sd": 0.01, "target_sd": 0.02, "blind_sd": 0.03, "p_gap_le_0": 0}}}}}
EXTERNAL = {"first": [{"pool": "first", "arm": "ALL", "n_cols": 9, "target_cov": 0.9949, "blind_cov": 0.9036, "noscreen": {"target_auc": 0.5701, "target_auc_sd": 0.0423, "blind_auc": 0.4636, "blind_auc_sd": 0.0269, "gap": 0.1064, "gap_sd": 0.0311, "n_selected": 9, "draws": 10}, "screen": None}]}


def test_report_tables(spark, tmp_path):
    paths = []
    for name, content in (("i", INTERNAL), ("e", EXTERNAL)):
        paths.append(str(tmp_path / f"{name}.json"))
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    cells = tables.internal_cells(spark, paths[:1])
    wanted = spark.createDataFrame([(0, "One", "first", "ALL", "lr"), (1, "One", "first", "ALL", "trees")], "place int, label string, pool string, scope string, kind string")
    rows = tables.picked(cells, wanted, ["pool", "scope", "kind"])
    assert tables.internal_table(rows).split("\n")[2:] == ["| One | lr | 16 | 0.675 ± 0.036 | 0.686 ± 0.035 | -0.011 ± 0.044 |", "| One | trees | — | — | — | — |"]
    assert r"One & lr & 16 & 0.675 $\pm$ 0.036 & 0.686 $\pm$ 0.035 & $-$0.011 $\pm$ 0.044 \\" in tables.internal_table(rows, latex=True)
    ext = tables.external_cells(spark, paths[1:])
    assert ext.where("scheme = 'screen'").first()["gap"] is None
    arm = tables.picked(ext, spark.createDataFrame([(0, "One", "first", "ALL", "noscreen")], "place int, label string, pool string, arm string, scheme string"), ["pool", "arm", "scheme"])
    assert tables.external_table(arm).endswith("| One | 0.570 ± 0.042 | 0.464 ± 0.027 | +0.106 ± 0.031 |")
    assert {(r["side"], r["auc"]) for r in tables.bars(arm, ["label"]).collect()} == {("target", 0.5701), ("blind", 0.4636)}
    back = json.loads(tables.audit_json(cells, {"folds": 5}).first()["value"])
    assert back["first"]["cells"]["ALL"]["lr"]["K"] == 16 and back["first"]["meta"] == {"folds": 5, "pool": "first"}
    ranks = spark.createDataFrame([("ctx_loss_slope", 0.5, 0.25, 1), ("other", 0.1, 0.0, 2)], "signal string, target_importance double, blind_importance double, target_rank int")
    assert tables.contribution_table(ranks, 1).endswith("| RowSampling_CELoss_Slope | M4 | S5 | R2 | 0.5000 | 0.2500 |")
    assert r"\_" in tables.contribution_table(ranks, 2, latex=True)


def test_suite_instances(spark):
    known = spark.createDataFrame([(1, "classification", 5, 100), (2, "classification", 900, 100), (3, "regression", 5, 100)], "dataset_id int, task_type string, n_features int, n_rows int")
    folds = spark.createDataFrame([(d, f, 0, "train") for d in (1, 2, 3) for f in (0, 1)], "dataset_id int, fold int, row_id int, split string")
    assert [tuple(r) for r in readers.suite_instances(known, folds).collect()] == [(1, 0, 0, "train")]


def test_command_line(spark, tmp_path):
    from auditloom import cli

    call = lambda *argv: cli.run(spark, cli._parser().parse_args([str(a) for a in argv]))
    call("prior", "--out", tmp_path / "dump", "--tables", 3, "--rows", 10, "--features", 2, "--pad-rows", 12, "--prior", "steps")
    assert spark.read.parquet(str(tmp_path / "dump")).count() == 36
    draw = lambda *key: float(np.random.default_rng(key).normal())
    names = ("base_loss", "base_entropy", "ctx_loss_slope", "ctx_loss_auc")
    for side, lift in (("target", 2.0), ("blind", 0.0)):
        rows = [(i, i % 2, *(draw(i, j, int(lift)) + lift * (i % 2) * (j == 0) for j in range(4))) for i in range(80)]
        spark.createDataFrame(rows, "dataset_id long, label int, " + ", ".join(f"{n} double" for n in names)).write.parquet(str(tmp_path / side))
    pool = ("--target", tmp_path / "target", "--blind", tmp_path / "blind")
    text = call("internal", *pool, "--scopes", "ALL", "no:ctx", "--kinds", "lr", "--replicates", 20, "--out", tmp_path / "i")
    assert "| no:ctx | lr |" in text and "| ALL | lr |" in text
    cell = json.loads(spark.read.text(str(tmp_path / "i")).first()["value"])["pool"]["cells"]["ALL"]["lr"]
    assert cell["target"] > 0.8 > cell["blind"] and cell["n_cols"] == 4
    text = call("external", *pool, "--draws", 2, "--trees", 20, "--out", tmp_path / "e")
    assert "| ctx noscreen |" in text and spark.read.json(str(tmp_path / "e")).count() >= 3
