"""Measurements: aggregates over the predictions of one bundle (a dataset under one manipulation)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import arrays as A

EPS = A.EPS


def classification(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, confidences, entropy, loss and margin; labels out of range switch the whole bundle's formulas."""
    y, p = F.col("y"), F.col("probs")
    own = F.get(p, y.cast("int"))
    n_classes = F.max(F.size("probs"))
    valid = (F.min("y") >= 0) & (F.max("y") < n_classes)
    return pred.groupBy(*keys).agg(
        F.avg(F.when(F.col("pred") == y, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(F.array_max(p)).alias("max_confidence"),
        F.when(valid, F.avg(own)).otherwise(F.avg(F.array_max(p))).alias("correct_confidence"),
        F.avg(A.entropy(p)).alias("entropy"),
        F.when(valid, -F.avg(F.log(own + F.lit(EPS)))).alias("loss"),
        F.avg(A.margin(p)).alias("prediction_margin"),
    )


#: What ``classification`` averages, in the order of ``row_measures``.
CLASSIFICATION = ("accuracy", "max_confidence", "correct_confidence", "entropy", "loss", "prediction_margin")


def row_measures(y: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The rows' shares in ``classification``, one array each, for weights ``raw`` (class by row) and classes ``y`` of these."""
    p = raw / sum(raw[1:], raw[0])
    own, rising = np.take_along_axis(p, y[None], 0)[0], np.sort(p, axis=0)
    entropy = sum((-v * np.log(v + EPS) for v in p), np.zeros(len(y)))
    return np.stack([(raw.argmax(0) == y).astype(float), rising[-1], own, entropy, -np.log(own + EPS), rising[-1] - rising[-2]])


def chi_squared(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predicted against true class counts over the classes of either, by n; null for fewer than two classes."""
    both = pred.select(*keys, F.explode(F.array(F.struct(F.col("pred").alias("k"), F.lit(1.0).alias("o"), F.lit(0.0).alias("e")), F.struct(F.col("y").alias("k"), F.lit(0.0).alias("o"), F.lit(1.0).alias("e")))).alias("c"))
    per = both.groupBy(*keys, F.col("c.k").alias("k")).agg(F.sum("c.o").alias("o"), F.sum("c.e").alias("e"))
    expected = F.greatest("e", F.lit(EPS))
    return per.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.sum(F.pow(F.col("o") - expected, 2) / expected) / F.sum("e")).alias("chi_squared"))


def kl_divergence(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True class shares against mean probabilities, both raised by a small number and normalised again."""
    long = pred.select(*keys, "y", F.posexplode("probs").alias("k", "p"))
    per = long.groupBy(*keys, "k").agg(F.avg(F.when(F.col("y") == F.col("k"), 1.0).otherwise(0.0)).alias("p"), F.avg("p").alias("q"))
    w = Window.partitionBy(*keys)
    scaled = per.select(*keys, ((F.col("p") + EPS) / F.sum(F.col("p") + EPS).over(w)).alias("p"), ((F.col("q") + EPS) / F.sum(F.col("q") + EPS).over(w)).alias("q"))
    return scaled.groupBy(*keys).agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl_divergence"))


def wasserstein(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Distance of two samples on a line: the area between their distribution functions."""
    both = df.select(*keys, F.explode(F.array(F.struct(F.col(a).cast("double").alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")), F.struct(F.col(b).cast("double").alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb")))).alias("s"))
    per = both.groupBy(*keys, F.col("s.v").alias("v")).agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"))
    run, every = Window.partitionBy(*keys).orderBy("v"), Window.partitionBy(*keys)
    gaps = per.select(*keys, (F.lead("v").over(run) - F.col("v")).alias("gap"), (F.sum("na").over(run) / F.sum("na").over(every)).alias("fa"), (F.sum("nb").over(run) / F.sum("nb").over(every)).alias("fb"))
    return gaps.groupBy(*keys).agg(F.coalesce(F.sum(F.col("gap") * F.abs(F.col("fa") - F.col("fb"))), F.lit(0.0)).alias("wasserstein"))


def logits(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Margin, size and excess kurtosis of logits."""
    per = pred.groupBy(*keys).agg(F.avg(A.margin(F.col("logits"))).alias("logit_margin"), F.avg(A.norm(F.col("logits"))).alias("logit_magnitude"))
    flat = pred.select(*keys, F.explode("logits").alias("v")).groupBy(*keys).agg(F.kurtosis("v").alias("logit_kurtosis"))
    return per.join(flat, list(keys))


def regression(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error, fit, moments of residuals and spread; r2 is null for a constant target."""
    r, n = F.col("y") - F.col("pred"), F.count("*")
    squares = F.var_pop("y") * n
    return pred.groupBy(*keys).agg(
        (-F.avg(r * r)).alias("neg_mse"),
        F.when(squares >= EPS, F.lit(1.0) - F.sum(r * r) / squares).alias("r2"),
        F.kurtosis(r).alias("residual_kurtosis"),
        F.skewness(r).alias("residual_skewness"),
        (F.stddev_pop("pred") / (F.stddev_pop("y") + F.lit(EPS))).alias("pred_spread"),
    )


def joint_histogram(pred: DataFrame, keys: Sequence[str], bins: int = 30) -> DataFrame:
    """Counts of predictions and targets in bins over their common range; the last bin is closed."""
    both = pred.select(*keys, F.explode(F.array(F.struct(F.col("pred").cast("double").alias("v"), F.lit(1.0).alias("o"), F.lit(0.0).alias("e")), F.struct(F.col("y").cast("double").alias("v"), F.lit(0.0).alias("o"), F.lit(1.0).alias("e")))).alias("s")).select(*keys, "s.*")
    span = both.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cell = F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), (F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    return both.join(span, list(keys)).groupBy(*keys, F.coalesce(cell, F.lit(0)).alias("bin")).agg(F.sum("o").alias("o"), F.sum("e").alias("e"))


def regression_chi_squared(pred: DataFrame, keys: Sequence[str], bins: int = 30) -> DataFrame:
    expected = F.greatest("e", F.lit(EPS))
    return joint_histogram(pred, keys, bins).groupBy(*keys).agg((F.sum(F.when((F.col("o") > 0) | (F.col("e") > 0), F.pow(F.col("o") - expected, 2) / expected)) / F.sum("e")).alias("chi_squared"))


#: Rows of a group whose densities one task adds up, values that it holds at once, and grid points on a side of a centre.
KDE_ROWS, KDE_VALUES, KDE_SIDE = 1 << 16, 1 << 9, 10


def bells(v: np.ndarray, lo: float, hi: float, h: float, points: int) -> np.ndarray:
    """Sums over ``v`` of exp(-((g - v) / h)^2 / 2) at ``points`` even places g from ``lo`` to ``hi``.

    With a = (centre - v) / h and d the step over h, the value j places from a centre is
    exp(-a^2 / 2) exp(-a d)^j exp(-(j d)^2 / 2), so two exponentials serve all places around a centre.
    """
    d, out = (hi - lo) / (points - 1) / h, np.zeros(points)
    if d > 1:  # powers would overflow; here a value touches few places
        g = lo + (hi - lo) * np.arange(points) / (points - 1)
        for at in range(0, len(v), KDE_VALUES):
            out += np.exp(-0.5 * ((g[None] - v[at : at + KDE_VALUES, None]) / h) ** 2).sum(0)
        return out
    first = np.arange(KDE_SIDE, points + KDE_SIDE, 2 * KDE_SIDE)
    centres = lo + (hi - lo) * first / (points - 1)
    wide = np.zeros((len(first), 2 * KDE_SIDE))
    for at in range(0, len(v), KDE_VALUES):
        a = np.clip((centres[None] - v[at : at + KDE_VALUES, None]) / h, -40, 40)  # beyond 30 widths all is nothing
        start, ones = np.exp(-0.5 * a * a), np.ones(len(a))
        wide[:, KDE_SIDE] += ones @ start
        ratio = np.exp(-d * a)
        for step, places in ((ratio, range(1, KDE_SIDE)), (1 / ratio, range(1, KDE_SIDE + 1))):
            side, power = 1 if step is ratio else -1, start.copy()
            for j in places:
                power *= step
                wide[:, KDE_SIDE + side * j] += ones @ power
    j = np.arange(-KDE_SIDE, KDE_SIDE)
    return (wide * np.exp(-0.5 * (j * d) ** 2)).ravel()[:points]


def kde_divergence(pred: DataFrame, keys: Sequence[str], points: int = 500) -> DataFrame:
    """Divergence of Gaussian density estimates (Scott's width) of target and prediction on a grid, at least 0.

    A group's rows are dealt into parts of some ``KDE_ROWS``; each part is a task's sums over the grid as one row, so
    no plan holds rows times grid points.
    """
    kinds = dict(pred.dtypes)
    stats = pred.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp("y").alias("sy"), F.stddev_samp("pred").alias("sp"), F.least(F.min("y"), F.min("pred")).cast("double").alias("lo"), F.greatest(F.max("y"), F.max("pred")).cast("double").alias("hi"))
    width = F.pow(F.col("n").cast("double"), F.lit(-0.2))
    stats = stats.where((F.col("sy") > EPS) & (F.col("sp") > EPS)).select(*keys, "lo", "hi", (F.col("sy") * width).alias("hy"), (F.col("sp") * width).alias("hp"), F.ceil(F.col("n") / KDE_ROWS).alias("parts"))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = pred.select(*keys, F.col("y").cast("double").alias("y"), F.col("pred").cast("double").alias("pred")).join(stats, list(keys))
    dealt = rows.select(*own, F.pmod(F.xxhash64("y", "pred"), F.col("parts")).alias("part"), "y", "pred", "lo", "hi", "hy", "hp")
    group = [f"_k{i}" for i in range(len(keys))]
    typed = ", ".join(f"_k{i} {kinds[k]}" for i, k in enumerate(keys))

    def summed(v: np.ndarray, lo: float, hi: float, h: float) -> tuple[np.ndarray, int]:
        v = v[~np.isnan(v)]
        return bells(v, lo, hi, h, points) / (h * 2.5066282746310002), len(v)

    def part(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi, hy, hp = (table.column(c)[0].as_py() for c in ("lo", "hi", "hy", "hp"))
        (p, n), (q, m) = (summed(table.column(c).to_numpy(), lo, hi, h) for c, h in (("y", hy), ("pred", hp)))
        cells = [pa.array([v], t) for v, t in ((lo, pa.float64()), (hi, pa.float64()), (p, pa.list_(pa.float64())), (q, pa.list_(pa.float64())), (n, pa.int64()), (m, pa.int64()))]
        return pa.table([table.column(c).slice(0, 1) for c in group] + cells, names=[*group, "lo", "hi", "p", "q", "n", "m"])

    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        g = lo + (hi - lo) * np.arange(points) / (points - 1)
        area = lambda f: (f[1:] + f[:-1]) / 2 * np.diff(g)
        p, q = (np.sum([np.array(v) for v in table.column(c).to_pylist()], axis=0) / sum(table.column(n).to_pylist()) + EPS for c, n in (("p", "n"), ("q", "m")))
        p, q = p / area(p).sum(), q / area(q).sum()
        return pa.table([table.column(c).slice(0, 1) for c in group] + [pa.array([max(float(area(p * np.log(p / q)).sum()), 0.0)])], names=[*group, "kl_divergence"])

    parts = dealt.groupBy(*group, "part").applyInArrow(part, f"{typed}, lo double, hi double, p array<double>, q array<double>, n long, m long")
    out = parts.groupBy(*group).applyInArrow(whole, f"{typed}, kl_divergence double")
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "kl_divergence")


def kl_to_clean(pred: DataFrame, clean: DataFrame, keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Mean divergence of each row's probabilities from its clean ones and back; null where lengths differ."""
    q = clean.select(*on, F.col("probs").alias("q"))
    p = pred.join(q, list(on))
    same = F.min(F.when(F.size("probs") == F.size("q"), 1).otherwise(0)) == 1
    return p.groupBy(*keys).agg(F.when(same, F.avg(A.kl(F.col("probs"), F.col("q")))).alias("kl2clean"), F.when(same, F.avg(A.kl(F.col("q"), F.col("probs")))).alias("rkl2clean"))


def mse_to_clean(pred: DataFrame, clean: DataFrame, keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    c = clean.select(*on, F.col("pred").alias("q"))
    return pred.join(c, list(on)).groupBy(*keys).agg(F.avg(F.pow(F.col("pred") - F.col("q"), 2)).alias("kl2clean"))
