"""Work that larger tables ask for: same results however rows are dealt, and nothing that grows with the square."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from auditloom.functions import stats
from auditloom.operators import evaluate, measure, models
from auditloom.queries import statistics


def test_means_of_copies_tie(spark, sf, tmp_path):
    one = pq.read_table(f"{sf}/lineitem.parquet")
    at = one.schema.get_field_index("l_suppkey")
    copies = [one.set_column(at, "l_suppkey", pa.compute.add(one["l_suppkey"], 1000 * i)) for i in range(6)]
    pq.write_table(pa.concat_tables(copies), tmp_path / "lineitem.parquet", row_group_size=1700)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "20000")
    try:
        got = statistics.means(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    distinct = {(r["signal"], r["dataset_id"] % 1000): set() for r in got}
    for r in got:
        distinct[r["signal"], r["dataset_id"] % 1000].add(r["value"])
    assert len(got) == 6 * len(distinct) and all(len(v) == 1 for v in distinct.values())


def test_bells_are_plain_sums():
    rng = np.random.default_rng(1)
    for v in (rng.normal(size=700), np.r_[rng.normal(size=50), 40.0], np.r_[rng.normal(size=2000) * 1e-3, 1e4], rng.integers(0, 3, 30).astype(float)):
        lo, hi, h = v.min() - 0.5, v.max(), v.std(ddof=1) * len(v) ** -0.2
        for width in (h, h / 300):
            g = lo + (hi - lo) * np.arange(500) / 499
            plain = np.exp(-0.5 * ((g[None] - v[:, None]) / width) ** 2).sum(0)
            np.testing.assert_allclose(measure.bells(v, lo, hi, width, 500), plain, rtol=1e-9, atol=1e-12)


def test_kde_divergence_holds_no_grid_of_rows(spark, monkeypatch):
    rows = [(g, float(i % 37) + g, float(i * i % 41)) for g in (1, 2) for i in range(300)] + [(3, 1.0, 1.0), (3, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, y double, pred double")
    once = measure.kde_divergence(df, ["g"])
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # 500 rows per group could be taken for a small table to broadcast
    want = {r["g"]: r["kl_divergence"] for r in once.collect()}
    monkeypatch.setattr(measure, "KDE_ROWS", 50)
    got = {r["g"]: r["kl_divergence"] for r in measure.kde_divergence(df, ["g"]).collect()}
    assert set(got) == set(want) == {1, 2} and all(abs(got[g] - want[g]) < 1e-12 for g in got)


def test_quantiles_cut_ranges(spark):
    values = np.r_[np.random.default_rng(3).normal(size=900), [7.5] * 300, 1e9, -1e9]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = [i / 10 for i in range(11)]
    got = stats.quantiles(df, "v", shares, bins=8)
    want = df.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("e")).first()["e"]
    assert np.allclose(got, want, rtol=1e-14, atol=0)
    assert stats.quantiles(df.where("v is null"), "v", [0.5]) == [None]


def test_leave_one_out_of_many_rows_needs_few_fits(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20000, 3))
    y = (rng.random(20000) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    fits, logistic = [], models.logistic
    monkeypatch.setattr(models, "logistic", lambda *a, **more: fits.append(1) or logistic(*a, **more))
    for balanced in (False, True):
        got = models.leave_one_out(x, y, balanced=balanced)
        assert len(fits) < 200
        for i in (0, 1, 77, int(np.abs(x).sum(1).argmax())):
            keep = np.arange(20000) != i
            assert abs(got[i] - models.probability(logistic(x[keep], y[keep], 1.0, balanced), x[i : i + 1])[0]) < 1e-10
        fits.clear()


def plainly_left_out(y, late, rest, anew):
    out, n = [], len(y)
    every, over = pd.Series(late).rank().to_numpy() / n, (late > np.quantile(late, 0.9)).astype(float)
    for i in range(n):
        keep = np.arange(n) != i
        x, held = np.column_stack([every, over, rest])[keep], np.array([every[i], over[i], rest[i]])
        if anew:
            x[:, 0] = pd.Series(x[:, 0]).rank().to_numpy() / keep.sum()
            below = x[:, 0] <= held[0]
            held[0] = x[below, 0].mean() if below.any() else 0.0
            limit = np.quantile(x[:, 0], 0.9)
            x[:, 1], held[1] = x[:, 0] > limit, held[0] > limit
        mean, sd = x.mean(0), x.std(0)
        sd = np.where(sd < 1e-12, 1, sd)
        out.append(models.probability(models.logistic((x - mean) / sd, y[keep]), ((held - mean) / sd)[None])[0])
    return np.array(out)


def test_leave_one_out_reports_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 260
    late = np.r_[rng.normal(size=200), rng.integers(0, 4, 60)].astype(float)
    table = pd.DataFrame({"dataset_id": np.arange(n), "label": (rng.random(n) < 0.4).astype(int), "late": late, "early": rng.normal(size=n)})
    both = spark.createDataFrame(pd.concat([table.assign(model="a"), table.head(50).assign(model=None)]), "dataset_id long, label int, late double, early double, model string")
    monkeypatch.setattr(evaluate, "HELD_ROWS", 64)
    counted, logistic = [], models.logistic
    for anew in (True, False):
        got = evaluate.leave_one_out(both, ["model"], "dataset_id", "label", "late", "early", anew).toPandas()
        for name, rows in (("a", table), (None, table.head(50))):
            mine = got[got["model"].isna() if name is None else got["model"] == name].sort_values("dataset_id")
            want = plainly_left_out(rows["label"].to_numpy(), rows["late"].to_numpy(), rows["early"].to_numpy(), anew)
            np.testing.assert_allclose(mine["score"].to_numpy(), want, atol=1e-9)
    monkeypatch.setattr(models, "logistic", lambda *a, **more: counted.append(1) or logistic(*a, **more))
    order = table.sort_values("late")
    evaluate._held_out(order["label"].to_numpy(), order["late"].to_numpy(), order["early"].to_numpy(), np.arange(n), True)
    assert len(counted) < n / 4


def test_heads_are_md5():
    import hashlib

    from auditloom.functions import digests

    texts = [str(i).encode() for i in (*range(300), 2**63 - 1)] + [b"", b"x" * 60, "é".encode()]
    for more in (1, 130):  # one slice, and several
        for i, at, got in digests.heads([b"0|boot|7|", b"", b"1|p|"], *digests.parts(pa.array(texts * more, pa.large_binary()))):
            want = [int(hashlib.md5([b"0|boot|7|", b"", b"1|p|"][i] + t).hexdigest()[:8], 16) for t in (texts * more)[at]]
            assert got.tolist() == want


def test_resamples_are_no_rows_of_a_plan(spark):
    import hashlib

    from auditloom.operators import split

    n, reps, rng = 90, 120, np.random.default_rng(4)
    target = [None if i % 17 == 0 else float(v) for i, v in enumerate(rng.integers(0, 9, n))]  # ties, and nulls as the lowest
    rows = [("a", i, int(rng.random() < 0.4), target[i], float(rng.normal())) for i in range(n)] + [("b", i, 1, 0.5, 0.5) for i in range(9)]
    df = split.bootstrap(spark.createDataFrame(rows, "g string, row_id long, y int, target double, blind double"), ["g"], reps)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "Window" not in plan
    areas = []
    for r in range(reps):
        w = np.array([sum(int(hashlib.md5(f"0|boot|{r}|{i}".encode()).hexdigest()[:8], 16) / 2**32 >= c for c in split.POISSON) for i in range(n)])
        at = [np.repeat([-np.inf if x[s] is None else x[s] for x in rows[:n]], w) for s in (3, 4)]
        areas.append([models.rank_auc(s, np.repeat([x[2] for x in rows[:n]], w)) for s in at])
    t, b = np.array(areas).T
    (got,) = df.collect()  # b has one class
    want = {"g": "a", "target_sd": t.std(), "blind_sd": b.std(), "gap_sd": (t - b).std(), "p_gap_le_0": (t - b <= 0).mean(), "used": reps}
    assert got.asDict() == {k: v if k in ("g", "used") else pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_internal_audit_reads_its_pool_and_ranks_once(spark):
    from auditloom.operators import audit

    read = spark.sparkContext.accumulator(0)
    rows = [(i, i % 2, f"base_{s}", float(np.random.default_rng([i, j]).normal()), float(i * j % 7)) for i in range(40) for j, s in enumerate("abc")]
    kinds, names = "dataset_id long, y int, signal string, xt double, xb double", ["base_a", "base_b", "base_c"]

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pool = spark.createDataFrame(rows, kinds)
    got = audit.internal(pool.mapInArrow(through, kinds), {"ALL": names}, replicates=50).collect()
    assert len(got) == 2 and read.value == len(rows)
    cells = audit.scoped(pool, {"ALL": names}).persist()
    plan = audit.top_scores(cells, audit.ranks(cells, ["scope"]), ("lr", "trees"), (1, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2  # the ranks and the fits


def test_pool_is_one_pass(spark, sf):
    from auditloom.sources import fixtures

    plan = fixtures.pool(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Join" not in plan
