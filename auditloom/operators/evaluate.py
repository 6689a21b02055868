"""Evaluations over a table of datasets: repeated splits, a size-only baseline, leave-one-out reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import stats
from auditloom.operators import models, split

MINIMAL = ("n_train", "n_test", "n_features")


def repeated_splits(df: DataFrame, label: str, share: float, seeds: Sequence[int], row: str = "dataset_id") -> DataFrame:
    """Every row once per seed, with ``seed`` and a stratified ``split``: ``share`` of the rows are train."""
    many = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    parted = split.stratified_split(many, ["seed"], label, share, 0, row)
    return parted.withColumn("split", F.when(F.col("split") == "test", "train").otherwise("test"))  # the share is the training part


def overlap(splits: DataFrame, keys: Sequence[str] = ("seed",), row: str = "dataset_id") -> DataFrame:
    """``overlap_ids``: ids on both sides of a split."""
    both = splits.groupBy(*keys, row).agg(F.count_distinct("split").alias("sides"))
    return both.groupBy(*keys).agg(F.sum((F.col("sides") > 1).cast("long")).alias("overlap_ids"))


def minimal(table: DataFrame, names: Sequence[str] = MINIMAL) -> tuple[DataFrame, DataFrame]:
    """Rows that have all of the size features, and the others with the reason of their rejection."""
    missing = reduce(lambda a, b: a | b, [F.col(n).isNull() | F.isnan(F.col(n).cast("double")) for n in names])
    return table.where(~missing), table.where(missing).select("dataset_id", F.lit("missing_minimal_features").alias("reason"))


def complete(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows in which all of the columns are finite."""
    finite = [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) < float("inf")) for n in names]
    return table.where(reduce(lambda a, b: a & b, finite))


def baseline_scores(table: DataFrame, label: str, names: Sequence[str], seeds: Sequence[int], share: float = 0.2) -> DataFrame:
    """``seed, dataset_id, y, score`` of every test row: medians of the training rows for what is missing,
    standardised, balanced logistic regression. Each seed is a task."""
    kind = dict(table.dtypes)["dataset_id"]
    splits = repeated_splits(table.select("dataset_id", F.col(label).cast("int").alias("y"), *names), "y", share, seeds)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dataset_id")
        train = (pdf["split"] == "train").to_numpy()
        x, y = pdf[list(names)].to_numpy(float), pdf["y"].to_numpy()
        fill = np.array([np.nanmedian(c[train]) if np.isfinite(c[train]).any() else 0.0 for c in x.T])
        x = np.where(np.isfinite(x), x, fill)
        mean, sd = x[train].mean(0), x[train].std(0)
        z = (x - mean) / np.where(sd < 1e-12, 1, sd)
        beta = models.logistic(z[train], y[train], balanced=True)
        return pd.DataFrame({"seed": pdf["seed"].values[~train], "dataset_id": pdf["dataset_id"].values[~train], "y": y[~train], "score": models.probability(beta, z[~train])})

    return splits.groupBy("seed").applyInPandas(one, f"seed int, dataset_id {kind}, y int, score double")


def baseline(table: DataFrame, label: str, names: Sequence[str] = MINIMAL, seeds: Sequence[int] = tuple(range(5)), share: float = 0.2) -> DataFrame:
    """One row per seed: sizes of both sides, AUC, average precision, rates at one half, TPR at FPR of 1, 5 and 10 %."""
    splits = repeated_splits(table.select("dataset_id", F.col(label).cast("int").alias("y")), "y", share, seeds)
    side = lambda s, y: F.sum(F.when((F.col("split") == s) & (F.col("y") == y), 1).otherwise(0))
    sizes = splits.groupBy("seed").agg(*[side(s, y).alias(f"{s}_{n}") for s in ("train", "test") for y, n in ((1, "members"), (0, "others"))])
    scores, keys = baseline_scores(table, label, names, seeds, share), ["seed"]
    at = [stats.tpr_at_fpr(scores, keys, "score", "y", v).withColumnRenamed("tpr_at", f"tpr_at_{round(v * 100)}fpr") for v in (0.01, 0.05, 0.1)]
    parts = [sizes, overlap(splits), stats.auc(scores, keys, "score", "y").select("seed", "auc"), stats.average_precision(scores, keys, "score", "y"), stats.confusion(scores, keys, "score", "y"), *at]
    return reduce(lambda a, b: a.join(b, "seed"), parts)


#: Rows that one task of ``leave_one_out`` holds out in turn.
HELD_ROWS = 1 << 10


def leave_one_out(results: DataFrame, keys: Sequence[str], row: str, label: str, late_gain: str, early: str, anew: bool = True) -> DataFrame:
    """``y, score`` of every row by leave-one-out logistic regression on three features: normalised rank of
    ``late_gain``, whether it is over its 90th percentile, and ``early``. Rows that lack either are left out.

    With ``anew`` rank and percentile come from the rows that are not held out; the row held out gets the mean
    rank of those at or below its own. Each group of ``keys`` (a model) is a table of one row per dataset; its
    rows are held out ``HELD_ROWS`` at a time, each part a task that has the table.
    """
    kinds = dict(results.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        part, parts = int(pdf["_part"].iloc[0]), int(pdf["_parts"].iloc[0])
        pdf = pdf.sort_values([late_gain, row])  # ranks, limits and the rows below a row are places in this order
        y, late, rest = pdf[label].to_numpy().astype(int), pdf[late_gain].to_numpy(float), pdf[early].to_numpy(float)
        held = np.arange(len(y) * part // parts, len(y) * (part + 1) // parts)  # neighbours, whose fits are alike
        return pd.DataFrame({**{k: pdf[k].values[held] for k in keys}, row: pdf[row].values[held], "y": y[held], "score": _held_out(y, late, rest, held, anew)})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{row} {kinds[row]}", "y int, score double"])
    whole = complete(results, [late_gain, early]).select(*keys, row, label, late_gain, early)
    sizes = whole.groupBy(*keys).agg(F.ceil(F.count("*") / HELD_ROWS).cast("int").alias("_parts"))
    same = reduce(lambda a, b: a & b, [F.col(f"_g{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)])
    sized = whole.join(sizes.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_parts"), same).drop(*[f"_g{i}" for i in range(len(keys))])
    return sized.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).groupBy(*keys, "_part").applyInPandas(one, schema)


def _held_out(y: np.ndarray, late: np.ndarray, rest: np.ndarray, held: np.ndarray, anew: bool) -> np.ndarray:
    """Scores of the rows ``held`` of a table sorted by ``late``. A fit starts at the one before it and takes steps
    with that one's Hessian until they are under 1e-9; one that does not come to rest so is made anew."""
    n = len(y)
    ranks = pd.Series(late).rank().to_numpy()
    every, over = ranks / n, (late > np.quantile(late, 0.9)).astype(float)
    penalty, out = np.diag([1e-9, 1.0, 1.0, 1.0]), np.empty(len(held))
    beta = slope = None
    for at, i in enumerate(held):
        x, gone = np.empty((n - 1, 3), order="F"), np.delete(y, i)
        for j, c in enumerate((every, over, rest)):
            x[:i, j], x[i:, j] = c[:i], c[i + 1 :]
        last = np.array([every[i], over[i], rest[i]])
        if anew:
            first, end = np.searchsorted(late, late[i], "left"), np.searchsorted(late, late[i], "right")
            x[:first, 0], x[first : end - 1, 0], x[end - 1 :, 0] = ranks[:first], ranks[i] - 0.5, ranks[end:] - 1
            x[:, 0] /= n - 1
            below = np.searchsorted(x[:, 0], last[0], "right")
            last[0] = x[:below, 0].mean() if below else 0.0
            place = 0.9 * (n - 2)
            around = x[int(place) : int(place) + 2, 0]
            limit = np.quantile(around, place - int(place)) if len(around) == 2 else around[0]
            x[:, 1], last[1] = x[:, 0] > limit, last[0] > limit
        mean, sd = x.mean(0), x.std(0)
        sd = np.where(sd < 1e-12, 1, sd)
        z = (x - mean) / sd
        a = np.ones((n - 1, 4), order="F")
        a[:, 1:] = z
        rested = False
        if beta is not None:
            now = beta.copy()
            for _ in range(8):
                p = 1 / (1 + np.exp(-np.clip(a @ now, -30, 30)))
                step = np.linalg.solve(slope, a.T @ (gone - p) - penalty @ now)
                now += step
                rested = bool(np.abs(step).max() < 1e-9)
                if rested:
                    break
        if not rested:
            now = models.logistic(z, gone)
            p = 1 / (1 + np.exp(-np.clip(a @ now, -30, 30)))
            slope = (a * (p * (1 - p))[:, None]).T @ a + penalty
        beta = now
        out[at] = models.probability(now, ((last - mean) / sd)[None])[0]
    return out


def usable_everywhere(long: DataFrame, task: str = "task") -> DataFrame:
    """Signals that every task has a value of, with over five finite values that vary."""
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    tasks = long.agg(F.count_distinct(task).alias("tasks"))
    per = long.groupBy("signal").agg(F.count_distinct(F.when(value.isNotNull(), F.col(task))).alias("t"), F.count(value).alias("n"), F.stddev_pop(value).alias("sd"))
    return per.join(F.broadcast(tasks)).where("t = tasks and n > 5 and sd > 1e-12").select("signal")  # one row


def best_single(long: DataFrame, label: str) -> DataFrame:
    """The signal that tells members from others best, whichever way it points: ``signal, auc``."""
    areas = stats.auc(long, ["signal"], "value", label).select("signal", F.greatest("auc", 1 - F.col("auc")).alias("auc"))
    return areas.agg(F.max_by("signal", F.struct("auc", "signal")).alias("signal"), F.max("auc").alias("auc"))
