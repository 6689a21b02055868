"""Rank statistics as DataFrame plans.

Ties are handled by grouping on the score first, so windows run over distinct
scores within a key and never over a whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_score(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve with ties at half; null for one class only."""
    w = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = _by_score(df, keys, score, label).withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    return below.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("won")).select(*keys, "n_pos", "n_neg", F.try_divide(F.col("won"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def roc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """One row per distinct score, from the highest: ``s, tp, fp, tpr, fpr``."""
    w = Window.partitionBy(*keys).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    run = _by_score(df, keys, score, label).select(*keys, "s", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))
    return run.select(*keys, "s", "tp", "fp", F.try_divide(F.col("tp").cast("double"), F.col("p")).alias("tpr"), F.try_divide(F.col("fp").cast("double"), F.col("n")).alias("fpr"))


def tpr_at_fpr(df: DataFrame, keys: Sequence[str], score: str, label: str, level: float) -> DataFrame:
    """True-positive rate at a false-positive rate, linear between points of the curve from (0, 0)."""
    w = Window.partitionBy(*keys).orderBy("fpr", "tpr")
    points = roc(df, keys, score, label).select(*keys, "tpr", "fpr").withColumn("tpr0", F.coalesce(F.lag("tpr").over(w), F.lit(0.0))).withColumn("fpr0", F.coalesce(F.lag("fpr").over(w), F.lit(0.0)))
    inside = (F.col("fpr0") <= level) & (F.col("fpr") > level)
    at = F.col("tpr0") + (F.col("tpr") - F.col("tpr0")) * (F.lit(level) - F.col("fpr0")) / (F.col("fpr") - F.col("fpr0"))
    return points.groupBy(*keys).agg(F.coalesce(F.max(F.when(inside, at)), F.max(F.when(F.col("fpr") <= level, F.col("tpr")))).alias("tpr_at"))


def average_precision(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Sum of precision times the gain in recall, over distinct scores from the highest."""
    w = Window.partitionBy(*keys).orderBy(F.desc("s"))
    steps = roc(df, keys, score, label).withColumn("gain", F.col("tpr") - F.coalesce(F.lag("tpr").over(w), F.lit(0.0)))
    return steps.groupBy(*keys).agg(F.sum(F.col("gain") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def confusion(df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Counts and rates at a threshold; a rate without a denominator is zero."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = df.groupBy(*keys).agg(count(hit & true).alias("tp"), count(hit & ~true).alias("fp"), count(~hit & ~true).alias("tn"), count(~hit & true).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return n.select(*keys, "tp", "fp", "tn", "fn", rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def average_rank(partition: Sequence[str | Column], value: str | Column) -> Column:
    """Rank from 1 with equal values sharing the mean of their ranks."""
    v = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*partition).orderBy(v)) + (F.count("*").over(Window.partitionBy(*partition, v)) - 1) / 2.0


def quantiles(df: DataFrame, value: str, shares: Sequence[float], bins: int = 4096) -> list[float | None]:
    """Exact quantiles of a whole column, linear between neighbours, as numbers; nulls do not count.

    The ranges that hold the wanted places are cut into ``bins`` until each holds one value, so no task holds the
    column's distinct values; only counts of bins reach the driver.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).persist()  # read once per cut
    try:
        n, lo, hi = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
        if not n:
            return [None] * len(shares)
        if not (abs(lo) < 1e300 and abs(hi) < 1e300):  # infinite or not a number: no ranges to cut
            return v.agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares])).alias("e")).first()["e"]
        places = [s * (n - 1) for s in shares]
        found: dict[int, float] = {}
        open_ = [(lo, hi, 0, sorted({k for p in places for k in (math.floor(p), math.ceil(p))}))]
        while open_:
            for low, high, _, ranks in open_:
                if low == high:
                    found |= dict.fromkeys(ranks, low)
            open_ = [c for c in open_ if c[0] < c[1]]
            if not open_:
                break
            inside = lambda c: F.col("v").between(c[0], c[1])
            within = [F.when(inside(c), F.struct(F.lit(i).alias("cell"), F.least(F.floor((F.col("v") - c[0]) / (c[1] - c[0]) * bins), F.lit(bins - 1)).alias("bin"))) for i, c in enumerate(open_)]
            counts = v.select("v", F.coalesce(*within).alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()  # as many rows as bins
            cut = []
            for i, (_, _, below, ranks) in enumerate(open_):
                for r in (r for r in counts if r["c"]["cell"] == i):
                    here = [k for k in ranks if below <= k < below + r["n"]]
                    if here:
                        cut.append((r["lo"], r["hi"], below, here))
                    below += r["n"]
            open_ = cut
        low = [(found[math.floor(p)], found[math.ceil(p)], p - math.floor(p)) for p in places]
        return [a if t == 0 else (1 - t) * a + t * b for a, b, t in low]
    finally:
        v.unpersist()


def ordered_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means of ``values``, added up in order of rows: the same to the last bit however rows are dealt, so groups of
    the same values in the same order tie."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.select(*keys, F.struct(*order).alias("_at"), *[part for v in values for part in (F.sum(v).over(run).alias(f"s_{v}"), F.count(v).over(run).alias(f"n_{v}"))])
    last = sums.groupBy(*keys).agg(F.max_by(F.struct(*[n for v in values for n in (f"s_{v}", f"n_{v}")]), "_at").alias("last"))
    return last.select(*keys, *[F.try_divide(F.col("last")[f"s_{v}"], F.col("last")[f"n_{v}"]).alias(v) for v in values])


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    ranked = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, average_rank(keys, a).alias("ra"), average_rank(keys, b).alias("rb"))
    return ranked.groupBy(*keys).agg(F.corr("ra", "rb").alias("spearman"))


def conformal(calibration: DataFrame, tests: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """``tests`` with p_value = (1 + calibration scores at or above) / (n + 1), by one running count instead of a range join."""
    both = calibration.select(*keys, score, F.lit(1).alias("cal"), F.lit(None).cast("long").alias("row_id")).unionByName(tests.select(*keys, score, F.lit(0).alias("cal"), F.col("row_id").cast("long")))
    counts = both.groupBy(*keys, score).agg(F.sum("cal").alias("c"))
    at_or_above = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(*keys, score, F.sum("c").over(at_or_above).alias("above"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    return tests.join(ranked, [*keys, score]).withColumn("p_value", (F.col("above") + 1.0) / (F.col("n") + 1.0)).drop("above", "n")


def multiclass(df: DataFrame, keys: Sequence[str], probs: str, pred: str, label: str, classes: int) -> DataFrame:
    """Balanced accuracy (mean recall of classes present) and one-versus-rest AUC averaged over classes."""
    recall = df.groupBy(*keys, label).agg(F.avg(F.when(F.col(pred) == F.col(label), 1.0).otherwise(0.0)).alias("r")).groupBy(*keys).agg(F.avg("r").alias("balanced_accuracy"))
    long = df.select(*keys, label, F.posexplode(probs).alias("k", "p")).where(F.col("k") < classes).withColumn("own", F.when(F.col(label) == F.col("k"), 1).otherwise(0))
    ovr = auc(long, [*keys, "k"], "p", "own").groupBy(*keys).agg(F.avg("auc").alias("ovr_auc"))
    return recall.join(ovr, list(keys))


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation, least and greatest value."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
