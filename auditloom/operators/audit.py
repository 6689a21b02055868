"""Audits over a pool of datasets: labelled (internal) and label-free (external)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import stats
from auditloom.operators import models, split

#: Column counts of the top-K curve; the second is for pools of many datasets.
K_GRID = (1, 2, 4, 8, 16, 32, 64)
K_GRID_FINE = (1, 2, 4, 6, 8, 12, 16, 24, 32, 64)
#: Parts of kept tables, which hold a few rows per dataset and column, and of the fits, so that few share a task.
KEPT_PARTS, FIT_PARTS = 24, 200


def usable(pool: DataFrame) -> DataFrame:
    """Signals that vary in the target or the blind table."""
    return pool.groupBy("signal").agg(F.stddev_pop("xt").alias("st"), F.stddev_pop("xb").alias("sb")).where("st > 0 or sb > 0").select("signal")


def separation(long: DataFrame, keys: Sequence[str], value: str, label: str) -> DataFrame:
    """|AUC - 1/2| of every column."""
    return stats.auc(long, keys, value, label).select(*keys, F.abs(F.col("auc") - 0.5).alias("separation"))


def null_floor(known: DataFrame, repeats: int = 40, share: float = 0.95) -> DataFrame:
    """Separation that halves of the known pile reach by chance: the share's percentile over repeats and columns."""
    halves = split.half_splits(known.select("dataset_id").distinct().withColumn("all", F.lit(1)), ["all"], repeats, "dataset_id").drop("all")
    return separation(known.join(halves, "dataset_id"), ["rep", "signal"], "value", "half").groupBy("signal").agg(F.percentile("separation", share).alias("floor"))


def screen(long: DataFrame, floor: DataFrame) -> DataFrame:
    """Signals whose piles differ by more than their floor."""
    return separation(long, ["signal"], "value", "suspect").join(floor, "signal").where(F.col("separation") > F.col("floor")).select("signal")


def external_scores(pool: DataFrame, arms: dict[str, Sequence[str]], draws: int = 10, screened: bool = True, repeats: int = 40, trees: int = 200) -> DataFrame:
    """``arm, draw, n_selected, side, dataset_id, y, score, p_value`` of every suspect, side xt or xb.

    Each (arm, draw) is a group of its own; it holds the arm's columns of all
    datasets of the pool, which is one row per dataset. A draw of which fewer than two columns pass gives no rows.
    """
    plan = [(a, d, s) for a, names in arms.items() for d in range(draws) for s in names]
    spark = pool.sparkSession
    chosen = spark.createDataFrame(plan, "arm string, draw int, signal string")  # as many rows as arms, draws and signals
    rows = chosen.join(pool.select("dataset_id", "y", "signal", "xt", "xb"), "signal")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        arm, draw = pdf["arm"].iloc[0], int(pdf["draw"].iloc[0])
        y = pdf.groupby("dataset_id")["y"].first().sort_index()
        known = _known(y.index, y.to_numpy(), draw)
        out, kept = [], None
        for side in ("xt", "xb"):
            x = _impute(pdf.pivot(index="dataset_id", columns="signal", values=side).sort_index().to_numpy(float), known)
            if kept is None:
                kept = _screened(x, known, draw, repeats) if screened else np.arange(x.shape[1])
            if len(kept) < 2:
                return pd.DataFrame(columns=[c.split()[0] for c in _SUSPECTS.split(", ")])
            a = models.Forest(trees, seed=draw).fit(x[known][:, kept]).score(x[:, kept])
            cal, test = np.sort(a[known]), a[~known]
            p = (1 + len(cal) - np.searchsorted(cal, test, side="left")) / (len(cal) + 1)
            out.append(pd.DataFrame({"arm": arm, "draw": draw, "n_selected": len(kept), "side": side, "dataset_id": y.index[~known], "y": y.to_numpy()[~known], "score": test, "p_value": p}))
        return pd.concat(out)

    kinds = dict(pool.dtypes)
    return rows.groupBy("arm", "draw").applyInPandas(one, _SUSPECTS.replace("dataset_id long", f"dataset_id {kinds['dataset_id']}"))


_SUSPECTS = "arm string, draw int, n_selected long, side string, dataset_id long, y int, score double, p_value double"


def external(pool: DataFrame, arms: dict[str, Sequence[str]], draws: int = 10, screened: bool = True, repeats: int = 40, trees: int = 200) -> DataFrame:
    """One row per arm and draw: AUC, TPR and FPR at p <= 0.1 of target and blind, columns kept."""
    scores = external_scores(pool, arms, draws, screened, repeats, trees)
    keys = ["arm", "draw", "side"]
    hit = lambda member: F.coalesce(F.avg(F.when((F.col("y") == 1) == F.lit(member), (F.col("p_value") <= 0.1).cast("double"))), F.lit(0.0))
    rates = scores.groupBy(*keys, "n_selected").agg(hit(True).alias("tpr"), hit(False).alias("fpr"))
    sides = rates.join(stats.auc(scores, keys, "score", "y").select(*keys, "auc"), keys)
    return sides.groupBy("arm", "draw", "n_selected").agg(*[F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{s}_{m}") for s in ("xt", "xb") for m in ("auc", "tpr", "fpr")])


def evaluate(draws: DataFrame) -> DataFrame:
    """Means and sample deviations over surviving draws, with the paired gap."""
    gap = F.col("xt_auc") - F.col("xb_auc")
    return draws.groupBy("arm").agg(F.avg("xt_auc").alias("target_auc"), F.avg("xb_auc").alias("blind_auc"), F.avg(gap).alias("gap"), F.stddev_samp("xt_auc").alias("target_auc_sd"), F.stddev_samp("xb_auc").alias("blind_auc_sd"), F.stddev_samp(gap).alias("gap_sd"), F.avg("n_selected").alias("n_selected"), F.count("*").alias("draws"))


def coverage(pool: DataFrame) -> DataFrame:
    return pool.agg(F.avg(F.col("xt").isNotNull().cast("double")).alias("target_cov"), F.avg(F.col("xb").isNotNull().cast("double")).alias("blind_cov"))


def _known(ids, y: np.ndarray, draw: int) -> np.ndarray:
    import hashlib

    outs = sorted((hashlib.md5(f"{draw}|known|{i}".encode()).hexdigest(), n) for n, i in enumerate(ids) if y[n] == 0)
    known = np.zeros(len(y), bool)
    known[[n for _, n in outs[: max(5, round(len(outs) / 2))]]] = True
    return known


def _impute(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    med = np.array([np.nanmedian(c[known]) if np.isfinite(c[known]).any() else 0.0 for c in x.T])
    return np.where(np.isfinite(x), x, med)


def _screened(x: np.ndarray, known: np.ndarray, draw: int, repeats: int) -> np.ndarray:
    def sep(a: np.ndarray, half: np.ndarray) -> np.ndarray:
        ranks = pd.DataFrame(a).rank().to_numpy()
        n1, n0 = half.sum(), (~half).sum()
        return np.abs((ranks[half].sum(0) - n1 * (n1 + 1) / 2) / max(1, n1 * n0) - 0.5)

    pile = x[known]
    floors = []
    for rep in range(repeats):
        half = np.zeros(len(pile), bool)
        half[np.random.default_rng([draw, rep]).permutation(len(pile))[: len(pile) // 2]] = True
        floors.append(sep(pile, half))
    return np.flatnonzero(sep(x, ~known) > np.quantile(floors, 0.95, axis=0))


def folds(pool: DataFrame, seed: int = 0, most: int = 5) -> DataFrame:
    """``dataset_id, y, fold``: two stratified folds or more, as many as the rarer class has datasets, ``most`` at most."""
    units = pool.groupBy("dataset_id").agg(F.min("y").cast("int").alias("y"))
    rarer = units.groupBy("y").agg(F.count("*").alias("c")).agg(F.greatest(F.lit(2), F.least(F.lit(most), F.min("c"))).alias("k"))
    ranked = split.hash_rank(units, ["y"], seed, "fold", "dataset_id")
    return ranked.join(F.broadcast(rarer)).select("dataset_id", "y", ((F.col("hr") - 1) % F.col("k")).cast("int").alias("fold"))  # one row


def _held(rows: DataFrame) -> DataFrame:
    """Every row once for each fold as the one held out: ``hold``."""
    return rows.join(rows.select(F.col("fold").alias("hold")).distinct())


def _side(pdf: pd.DataFrame, side: str, columns: Sequence[str]) -> np.ndarray:
    return pdf.pivot(index="dataset_id", columns="signal", values=side).sort_index()[list(columns)].to_numpy(float)


def ranks(cells: DataFrame, keys: Sequence[str], side: str = "xt") -> DataFrame:
    """``signal, importance, place`` for each fold held out: columns by mean size of their Shapley contributions
    to boosted trees of the other folds, one task per fold."""
    kinds = dict(cells.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        hold = pdf["hold"].iloc[0]
        train = pdf[pdf["fold"] != hold]
        names = sorted(train["signal"].unique())
        y = train.groupby("dataset_id")["y"].first().sort_index().to_numpy().astype(int)
        x = _side(train, side, names)
        size = np.abs(models.BoostedTrees().fit(x, y).contributions(x)).mean(0)
        place = np.empty(len(names), int)
        place[np.argsort(-size, kind="stable")] = np.arange(1, len(names) + 1)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "hold": hold, "signal": names, "importance": size, "place": place})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "hold int, signal string, importance double, place int"])
    return _held(cells).repartition(FIT_PARTS, *keys, "hold").groupBy(*keys, "hold").applyInPandas(one, schema)


def top_scores(cells: DataFrame, ranked: DataFrame, kinds: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """``scope, kind, k, n_cols, dataset_id, y, target, blind``: out-of-fold scores on the ``k`` first columns of
    each fold's own ranks, the same ones for target and blind. Every (scope, kind, k, fold) is a task."""
    spark = cells.sparkSession
    sized = ranked.withColumn("n_cols", F.max("place").over(Window.partitionBy("scope")))  # as many rows as columns and folds
    grid = spark.createDataFrame([(kind, k) for kind in kinds for k in ks], "kind string, k int")
    picked = sized.join(F.broadcast(grid), F.col("k") <= F.col("n_cols")).where(F.col("place") <= F.col("k"))  # a few kinds times a few counts
    rows = picked.select("scope", "kind", "k", "hold", "n_cols", "signal", "place").join(cells, ["scope", "signal"])
    fields = "scope string, kind string, k int, n_cols int, dataset_id {0}, y int, target double, blind double".format(dict(cells.dtypes)["dataset_id"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf.drop_duplicates("signal").sort_values("place")["signal"]
        head = pdf.groupby("dataset_id")[["y", "fold"]].first().sort_index()
        y, train = head["y"].to_numpy().astype(int), head["fold"].to_numpy() != pdf["hold"].iloc[0]
        out = {c: _fit_predict(pdf["kind"].iloc[0], x[train], y[train], x[~train]) for c, x in (("target", _side(pdf, "xt", names)), ("blind", _side(pdf, "xb", names)))}
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in ("scope", "kind", "k", "n_cols")}, "dataset_id": head.index[~train], "y": y[~train], **out})

    task = ["scope", "kind", "k", "hold"]
    return rows.repartition(FIT_PARTS, *task).groupBy(*task).applyInPandas(one, fields)


def scoped(pool: DataFrame, scopes: dict[str, Sequence[str]], seed: int = 0) -> DataFrame:
    """``scope, signal, dataset_id, y, fold, xt, xb`` of each scope's usable columns."""
    plan = pool.sparkSession.createDataFrame([(s, n) for s, names in scopes.items() for n in names], "scope string, signal string")
    return plan.join(usable(pool), "signal").join(pool.select("dataset_id", "signal", "xt", "xb"), "signal").join(folds(pool, seed), "dataset_id")


def internal(pool: DataFrame, scopes: dict[str, Sequence[str]], kinds: Sequence[str] = ("lr", "trees"), seed: int = 0, replicates: int = 2000, ks: Sequence[int] = K_GRID) -> DataFrame:
    """One row per scope and classifier: the elbow count K*, out-of-fold AUC of target and blind
    on the same columns there, their gap, and its spread over paired resamples.

    Columns are ranked within each training fold on the target alone, once for all classifiers.
    """
    best = at_elbow(pool, scopes, kinds, seed, ks).persist()
    keys = ["scope", "kind"]
    areas = [stats.auc(best, keys, side, "y").select(*keys, F.col("auc").alias(side)) for side in ("target", "blind")]
    heads = best.groupBy(*keys).agg(F.max("n_cols").alias("n_cols"), F.max("k").alias("k_star"))
    spread = split.bootstrap(best.withColumn("row_id", F.col("dataset_id")), keys, replicates).select(*keys, "gap_sd", "p_gap_le_0")
    out = heads.join(areas[0], keys).join(areas[1], keys).withColumn("gap", F.col("target") - F.col("blind")).join(spread, keys)
    return out.select(*keys, "n_cols", "k_star", "target", "blind", "gap", "gap_sd", "p_gap_le_0")


def at_elbow(pool: DataFrame, scopes: dict[str, Sequence[str]], kinds: Sequence[str] = ("lr", "trees"), seed: int = 0, ks: Sequence[int] = K_GRID) -> DataFrame:
    """Out-of-fold scores of each scope and classifier at its K*."""
    pool = pool.select("dataset_id", "y", "signal", "xt", "xb").repartition(KEPT_PARTS, "dataset_id").persist()  # read for columns, folds and cells
    cells = scoped(pool, scopes, seed).repartition(KEPT_PARTS, "dataset_id").persist()
    scores = top_scores(cells, ranks(cells, ["scope"]), kinds, ks).repartition(KEPT_PARTS, "scope", "kind", "k", "dataset_id").persist()  # each row is a fit's result
    curve = stats.auc(scores, ["scope", "kind", "k"], "target", "y")
    star = models.elbow_table(curve, ["scope", "kind"], "k", "auc").withColumnRenamed("k_star", "k")
    return scores.join(star, ["scope", "kind", "k"])


def _fit_predict(kind: str, x: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    if kind == "trees":
        return models.BoostedTrees().fit(x, y).predict(q)
    med = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in x.T])
    x, q = np.where(np.isfinite(x), x, med), np.where(np.isfinite(q), q, med)
    m, s = x.mean(0), np.where(x.std(0) < 1e-12, 1, x.std(0))
    return models.probability(models.logistic((x - m) / s, y), (q - m) / s)


def contributions(pool: DataFrame, seed: int = 0) -> DataFrame:
    """``signal, target_importance, blind_importance`` with the rank of each: mean size of
    Shapley contributions over training folds, target and blind side by side, one task per side and fold."""
    cells = pool.select("dataset_id", "signal", "xt", "xb").join(folds(pool, seed), "dataset_id")
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("x")) for n, c in (("target", "xt"), ("blind", "xb"))])).alias("v")
    each = ranks(cells.select("dataset_id", "signal", "y", "fold", sides).select("dataset_id", "signal", "y", "fold", "v.*"), ["side"], "x")
    imp = each.groupBy("signal").agg(*[F.avg(F.when(F.col("side") == n, F.col("importance"))).alias(f"{n}_importance") for n in ("target", "blind")])
    rank = lambda c: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(c), "signal"))  # noqa: E731  as many rows as signals
    return imp.withColumn("target_rank", rank("target_importance")).withColumn("blind_rank", rank("blind_importance"))


def overlap(ranks: DataFrame, k: int) -> DataFrame:
    """Signals in both top-k lists, rank correlation, and top signals that mean nothing to the blind model."""
    return ranks.agg(F.sum(((F.col("target_rank") <= k) & (F.col("blind_rank") <= k)).cast("int")).alias("overlap"), F.corr("target_rank", "blind_rank").alias("spearman"), F.sum(((F.col("target_rank") <= k) & (F.col("blind_importance") == 0)).cast("int")).alias("blind_zero"))


def metadata_auc(meta: DataFrame, label: str, draws: int = 10) -> float:
    """Orientation-free AUC of log sizes alone, mean over draws (one row per dataset)."""
    pdf = meta.select("dataset_id", label, F.log1p("n_pool").alias("a"), F.log1p("n_features").alias("b")).orderBy("dataset_id").toPandas()
    x, y, out = pdf[["a", "b"]].to_numpy(float), pdf[label].to_numpy(), []
    for d in range(draws):
        known = _known(pdf["dataset_id"], y, d)
        if known.sum() >= 2 and 0 < y[~known].sum() < (~known).sum():
            v = models.rank_auc(models.Forest(seed=d).fit(x[known]).score(x[~known]), y[~known])
            out.append(max(v, 1 - v))
    return float(np.mean(out)) if out else float("nan")


def transfer(first: DataFrame, others: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """Scores of ``others`` under a model of complete rows of ``first``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml import Pipeline

    n = first.count()
    steps = Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, regParam=1.0 / max(n, 1), standardization=False)])
    from pyspark.ml.functions import vector_to_array

    return steps.fit(first.na.drop(subset=list(names))).transform(others.na.drop(subset=list(names))).withColumn("score", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def engineered(long: DataFrame, keys: Sequence[str] = ("signal",)) -> DataFrame:
    """Columns made of each signal with at least ten values: signed log for heavy tails, an indicator
    above the 90th percentile (if its deviation is over 0.05), and the normalised rank."""
    kept = long.where(F.col("value").isNotNull())
    stats_ = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.kurtosis("value").alias("kurt"), F.percentile("value", 0.9).alias("p90")).where("n >= 10")
    rows = kept.join(stats_, list(keys)).withColumn("log", F.when(F.col("kurt") > 5, F.signum("value") * F.log1p(F.abs("value")))).withColumn("over", (F.col("value") > F.col("p90")).cast("double"))
    varies = F.stddev_pop("over").over(Window.partitionBy(*keys)) > 0.05
    rows = rows.withColumn("over", F.when(varies, F.col("over")))
    return rows.withColumn("rank", stats.average_rank(keys, "value") / F.col("n")).select(*keys, "dataset_id", "value", "log", "over", "rank")


