"""Splits, caps, folds and resamples by hash order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import digests, rng


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int, tag: str, row: str = "row_id", out: str = "hr") -> DataFrame:
    """Place from 1 of each row in its group's seeded order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(rng.order_key(seed, tag, *keys, row), row)))


def random_split(df: DataFrame, keys: Sequence[str], share: float, seed: int, row: str = "row_id", first: str = "test", rest: str = "train") -> DataFrame:
    """The first ceil(share * n) rows of each group in seeded order, and the rest."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return hash_rank(df, keys, seed, "split", row).withColumn("split", F.when(F.col("hr") <= F.ceil(n * F.lit(share)), first).otherwise(rest)).drop("hr")


def stratified_split(df: DataFrame, keys: Sequence[str], label: str, share: float, seed: int, row: str = "row_id") -> DataFrame:
    """Split that keeps class shares: whole parts of share * n per class, and the rows that
    remain to ceil(share * n) go to the classes of largest fractions."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*keys)
    quota = counts.withColumn("want", F.col("c") * F.lit(share)).withColumn("base", F.floor("want")).withColumn("total", F.ceil(F.sum("c").over(group) * F.lit(share)))
    quota = quota.withColumn("place", F.row_number().over(group.orderBy(F.desc(F.round(F.col("want") - F.col("base"), 9)), label))).withColumn("left", F.col("total") - F.sum("base").over(group))
    quota = quota.select(*keys, label, (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("take"))
    ranked = hash_rank(df, [*keys, label], seed, "strat", row)
    return ranked.join(quota, [*keys, label]).withColumn("split", F.when(F.col("hr") <= F.col("take"), "test").otherwise("train")).drop("hr", "take")


def row_cap(df: DataFrame, keys: Sequence[str], most: int, seed: int, row: str = "row_id") -> DataFrame:
    """At most ``most`` rows of each group, the first in seeded order."""
    return hash_rank(df, keys, seed, "cap", row).where(F.col("hr") <= most).drop("hr")


def folds(df: DataFrame, keys: Sequence[str], label: str, seed: int, most: int = 5, row: str = "row_id") -> DataFrame:
    """Stratified folds, as many as the rarest class has rows but ``most`` at most."""
    rarest = df.groupBy(*keys, label).agg(F.count("*").alias("c")).groupBy(*keys).agg(F.least(F.lit(most), F.min("c")).alias("k"))
    return hash_rank(df, [*keys, label], seed, "fold", row).join(rarest, list(keys)).withColumn("fold", ((F.col("hr") - 1) % F.col("k")).cast("int")).drop("hr", "k")


def known_suspect(df: DataFrame, keys: Sequence[str], label: str, seed: int, row: str = "row_id") -> DataFrame:
    """Half of the non-members (five at least, halves to even) are known; the rest and all members are suspects."""
    ranked = hash_rank(df, [*keys, label], seed, "known", row)
    n = F.count("*").over(Window.partitionBy(*keys, label))
    known = (F.col(label) == 0) & (F.col("hr") <= F.greatest(F.lit(5), F.bround(n * 0.5).cast("int")))
    return ranked.withColumn("pile", F.when(known, "known").otherwise("suspect")).drop("hr")


def half_splits(df: DataFrame, keys: Sequence[str], repeats: int, row: str = "row_id") -> DataFrame:
    """Each group halved ``repeats`` times: ``rep, half`` for every row and repeat."""
    many = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.md5(F.concat_ws("|", F.lit("half"), F.col("rep").cast("string"), *[F.col(k).cast("string") for k in keys], F.col(row).cast("string")))
    ranked = many.withColumn("hr", F.row_number().over(Window.partitionBy(*keys, "rep").orderBy(order, row)))
    return ranked.withColumn("half", F.when(F.col("hr") <= F.floor(F.count("*").over(Window.partitionBy(*keys, "rep")) / 2), 1).otherwise(0)).drop("hr")


def first_n(df: DataFrame, label: str, n: int | None, order: str) -> DataFrame:
    """First rows of each label; all where ``n`` is none."""
    if n is None:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def shard(df: DataFrame, ordinal: str, shards: int) -> DataFrame:
    return df.withColumn("shard", (F.col(ordinal) % shards).cast("int"))


def leave_one_out(df: DataFrame, key: str) -> DataFrame:
    """``held`` with all other rows of a small table, for closed-form folds."""
    a = df.select(F.col(key).alias("held"))
    return a.join(df, a["held"] != df[key])


def averaged(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation over splits."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("split_std"))


def nn_split(obs: DataFrame) -> DataFrame:
    """``dataset_id, row_id, side``: in order of rows, an unplaced row goes to side 0, and its nearest
    neighbour, if that is unplaced, to side 1.

    Greedy and in order within a dataset, so each dataset is one group; datasets of
    under ten rows, or with under five on a side, are left out.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        side = nn_sides(np.array(pdf["x"].tolist(), float))
        if side is None:
            return pd.DataFrame({"dataset_id": pd.Series(dtype="int64"), "row_id": pd.Series(dtype="int64"), "side": pd.Series(dtype="int32")})
        return pd.DataFrame({"dataset_id": pdf["dataset_id"].values, "row_id": pdf["row_id"].values, "side": side.astype("int32")})

    return obs.select("dataset_id", "row_id", "x").groupBy("dataset_id").applyInPandas(one, "dataset_id long, row_id long, side int")


def nn_sides(x: np.ndarray) -> np.ndarray | None:
    """``nn_split`` of one dataset's features in the order of its rows."""
    n = len(x)
    if n < 10:
        return None
    with np.errstate(all="ignore"):
        med = np.nan_to_num(np.nanmedian(x, axis=0))
    x = np.where(np.isnan(x), med, x)
    near, step = np.empty(n, int), max(1, (1 << 16) // n)
    for a in range(0, n, step):  # distances in strips of half a MB, feature by feature
        d = np.zeros((len(x[a : a + step]), n))
        each = np.empty_like(d)
        for column in x.T:
            np.subtract(column[a : a + step, None], column[None], out=each)
            d += np.multiply(each, each, out=each)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near[a : a + step] = d.argmin(1)
    side = np.full(n, -1)
    for i in range(n):
        if side[i] < 0:
            side[i] = 0
            if side[near[i]] < 0:
                side[near[i]] = 1
    return None if min((side == 0).sum(), (side == 1).sum()) < 5 else side


#: The Poisson distribution function of mean one; a ninth draw has a probability of one in a million.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402)


#: Resamples of one task: it holds a byte of each for every row of its group.
RESAMPLES = 50


def bootstrap(scores: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """``gap`` statistics of paired resamples of ``y, target, blind``: deviations and P(gap <= 0).

    A resample is a weight per row (Poisson with mean one, from a hash of replicate and row) and its AUC is weighted;
    resamples of one class drop out. ``RESAMPLES`` of a group are a task, which sorts the group's rows once; rows times
    replicates are never rows of a plan.
    """
    kinds = dict(scores.dtypes)
    tail = F.coalesce(F.concat(F.lit("|"), F.col("row_id").cast("string")), F.lit("")).cast("binary")
    starts = F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(RESAMPLES))
    rows = scores.select(*keys, F.explode(starts).alias("_from"), tail.alias("_tail"), F.coalesce(F.col("y") == 1, F.lit(False)).alias("_one"), F.col("target").cast("double").alias("target"), F.col("blind").cast("double").alias("blind"))

    def one(table: pa.Table) -> pa.Table:
        first = table["_from"][0].as_py()
        reps = range(first, min(first + RESAMPLES, replicates))
        areas = resampled(table["_tail"], table["_one"].to_numpy(), [table[c] for c in ("target", "blind")], reps)
        found = np.flatnonzero(~np.isnan(areas).any(1))
        same = {k: pa.array([table[k][0].as_py()] * len(found), table.schema.field(k).type) for k in keys}
        return pa.table({**same, "target": areas[found, 0], "blind": areas[found, 1]})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "target double, blind double"])
    both = rows.repartition(-(-replicates // RESAMPLES), *keys, "_from").groupBy(*keys, "_from").applyInArrow(one, schema).withColumn("gap", F.col("target") - F.col("blind"))
    return both.groupBy(*keys).agg(F.stddev_pop("target").alias("target_sd"), F.stddev_pop("blind").alias("blind_sd"), F.stddev_pop("gap").alias("gap_sd"), F.avg(F.when(F.col("gap") <= 0, 1.0).otherwise(0.0)).alias("p_gap_le_0"), F.count("*").alias("used"))


def resampled(tails: pa.ChunkedArray, ones: np.ndarray, sides: Sequence[pa.ChunkedArray], reps: Sequence[int]) -> np.ndarray:
    """AUC of every replicate and side, nan for one class; nulls are the lowest scores, as one tie."""
    limits = np.ceil(np.array(POISSON) * 4294967296.0).astype(np.uint32)
    weights = np.empty((len(reps), len(ones)), np.uint8)
    texts = pa.concat_arrays(tails.chunks).cast(pa.large_binary())
    for i, at, head in digests.heads([f"0|boot|{r}".encode() for r in reps], *digests.parts(texts)):
        w = weights[i, at]
        np.greater_equal(head, limits[0], out=w.view(bool))
        for limit in limits[1:]:
            np.add(w, head >= limit, out=w, casting="unsafe")
    areas = np.empty((len(reps), len(sides)))
    for s, side in enumerate(sides):
        code = np.zeros(len(ones), np.int64)
        known = side.is_valid().to_numpy()
        code[known] = 1 + np.unique(side.drop_null().to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        starts, one = np.flatnonzero(np.diff(code[order], prepend=-1)), ones[order]
        for r in range(len(reps)):
            w = weights[r, order]
            pos = w * one
            neg = np.add.reduceat(w - pos, starts, dtype=np.int64)
            pos = np.add.reduceat(pos, starts, dtype=np.int64)
            pairs = int(pos.sum()) * int(neg.sum())
            areas[r, s] = (pos * (np.cumsum(neg) - neg + neg / 2.0)).sum() / pairs if pairs else np.nan
    return areas
