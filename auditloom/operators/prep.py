"""Encoding, binning, capping and cleaning of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import stats

OTHER = "__other__"
FLOAT_MAX = 3.4028234663852886e38


def ordinal_encode(df: DataFrame, keys: Sequence[str], column: str, out: str = "code") -> DataFrame:
    """Sorted distinct levels of each dataset as 0..k-1; null stays null.

    Levels are ranked, not rows, and joined back, so no window holds a dataset.
    """
    levels = df.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    ranked = levels.withColumn(out, F.dense_rank().over(Window.partitionBy(*keys).orderBy(column)) - 1)
    return df.join(ranked, [*keys, column], "left")


def label_encode(df: DataFrame, keys: Sequence[str], column: str, out: str = "code", most: int = 10) -> DataFrame:
    """Like ``ordinal_encode``, with null as class 0. A dataset of over ``most`` classes fails when it is read."""
    coded = ordinal_encode(df, keys, column, out).withColumn(out, F.coalesce(out, F.lit(0)))
    return coded.withColumn(out, F.when(F.col(out) < most, F.col(out)).otherwise(F.raise_error(F.lit(f"{column}: more than {most} classes")).cast("int")))


def bin_edges(df: DataFrame, keys: Sequence[str], column: str, bins: int = 10) -> DataFrame:
    """Distinct interior quantiles of each dataset; none where it has no more distinct values than bins."""
    shares = [i / bins for i in range(1, bins)]
    kept = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return kept.groupBy(*keys).agg(F.when(F.count_distinct(column) > bins, F.array_distinct(F.percentile(F.col(column).cast("double"), F.array(*[F.lit(s) for s in shares])))).alias("edges"))


def quantile_bin(fit: DataFrame, apply: DataFrame, keys: Sequence[str], column: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """Number of edges at or below each value, with edges from ``fit`` only; values of few distinct levels stay."""
    edged = apply.join(bin_edges(fit, keys, column, bins), list(keys), "left")
    return edged.withColumn(out, F.when(F.col("edges").isNull(), F.col(column).cast("double")).otherwise(F.size(F.filter("edges", lambda e: e <= F.col(column))).cast("double"))).drop("edges")


def frequent_levels(df: DataFrame, keys: Sequence[str], column: str, most: int = 10) -> DataFrame:
    """The ``most`` - 1 commonest levels of each dataset where it has over ``most``; null counts as a level."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("c"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), column))).withColumn("k", F.count("*").over(Window.partitionBy(*keys)))
    return ranked.where((F.col("k") <= most) | (F.col("r") < most)).select(*keys, column)


def cap_levels(fit: DataFrame, apply: DataFrame, keys: Sequence[str], column: str, most: int = 10, out: str = "capped") -> DataFrame:
    """Levels of ``apply`` that ``fit`` keeps stay, others become one."""
    kept = frequent_levels(fit, keys, column, most).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(column).alias("_level"), F.lit(True).alias("_kept"))
    on = [apply[k] == kept[f"_{k}"] for k in keys] + [apply[column].eqNullSafe(kept["_level"])]
    joined = apply.join(kept, on, "left")
    return joined.select(*[apply[c] for c in apply.columns], F.when(F.col("_kept"), F.col(column).cast("string")).otherwise(F.lit(OTHER)).alias(out))


def cap_categories(df: DataFrame, keys: Sequence[str], column: str, most: int = 10, out: str = "capped") -> DataFrame:
    return cap_levels(df, df, keys, column, most, out)


def discretise(fit: DataFrame, apply: DataFrame, keys: Sequence[str], column: str, numeric: bool, most: int = 10) -> DataFrame:
    """A target of many values as at most ``most`` classes, with the rule that made it so:
    values of few levels pass, numbers are binned, levels are capped."""
    few = fit.groupBy(*keys).agg((F.count_distinct(column) <= most).alias("_few"))
    done = quantile_bin(fit, apply, keys, column, most, "_out").withColumn("_out", F.col("_out").cast("string")) if numeric else cap_levels(fit, apply, keys, column, most, "_out")
    joined = done.join(few, list(keys))
    return joined.withColumn("rule", F.when(F.col("_few"), "lowcard").otherwise("binned" if numeric else "capped")).withColumnRenamed("_out", "target").drop("_few")


def clean(value: str | Column) -> Column:
    """Infinite, NaN and overflow sentinels as null; text that is no number too."""
    v = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) <= F.lit(FLOAT_MAX / 10)), v)


def standardise(df: DataFrame, keys: Sequence[str], value: str, out: str = "z", sample: bool = False, clip: float | None = None, plus: float = 0.0) -> DataFrame:
    """z-scores per dataset from one aggregate joined back; a spread under 1e-12 counts as 1."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), sd.alias("_s"))
    z = (F.col(value) - F.col("_m")) / (F.when(F.col("_s") < 1e-12, F.lit(1.0)).otherwise(F.col("_s")) + F.lit(plus))
    z = F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)) if clip is not None else z
    return df.join(stats, list(keys)).withColumn(out, z).drop("_m", "_s")


def impute_median(df: DataFrame, keys: Sequence[str], value: str, fit: DataFrame | None = None, out: str = "filled") -> DataFrame:
    """Nulls as the median of the fitting rows; all null: 0."""
    medians = (df if fit is None else fit).groupBy(*keys).agg(F.percentile(value, 0.5).alias("_med"))
    return df.join(medians, list(keys), "left").withColumn(out, F.coalesce(F.col(value), F.col("_med"), F.lit(0.0))).drop("_med")


def bucket_edges(df: DataFrame, keys: Sequence[str], value: str, buckets: int) -> DataFrame:
    """Quantile limits of all datasets' z-scored targets together."""
    z = standardise(df, keys, value, "z", sample=True, plus=1e-8).select("z")
    edges = stats.quantiles(z, "z", [i / buckets for i in range(buckets + 1)])
    return df.sparkSession.createDataFrame(list(enumerate(edges)), "i int, edge double")


def plain_id(dataset_id: str | Column) -> Column:
    """The id of ``['family', id]`` text, or the text itself."""
    c = F.col(dataset_id) if isinstance(dataset_id, str) else dataset_id
    inner = F.regexp_extract(c, r"^\[\s*'?\w+'?\s*,\s*'?([^'\]]*)'?\s*\]$", 1)
    return F.when(inner != "", inner).otherwise(c)


def grid_id(family: Column, dataset_id: Column) -> Column:
    text = dataset_id.cast("string")
    return F.concat(F.lit("['"), family, F.lit("', "), F.when(text.rlike("^-?[0-9]+$"), text).otherwise(F.concat(F.lit("'"), text, F.lit("'"))), F.lit("]"))


def scaled(df: DataFrame, keys: Sequence[str], value: str, kind: str, out: str = "scaled") -> DataFrame:
    """Feature scaling by ``standard``, ``minmax``, ``robust`` or ``quantile`` (rank in 0..1)."""
    if kind == "standard":
        return standardise(df, keys, value, out)
    if kind == "quantile":
        ranks = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
        run = Window.partitionBy(*keys).orderBy(value)
        ranks = ranks.withColumn("_r", F.sum("_c").over(run) - (F.col("_c") + 1) / 2.0).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
        return df.join(ranks, [*keys, value]).withColumn(out, F.col("_r") / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_c", "_r", "_n")
    lo, width = (F.min(value), F.max(value) - F.min(value)) if kind == "minmax" else (F.percentile(value, 0.5), F.percentile(value, 0.75) - F.percentile(value, 0.25))
    stats = df.groupBy(*keys).agg(lo.alias("_lo"), width.alias("_w"))
    return df.join(stats, list(keys)).withColumn(out, (F.col(value) - F.col("_lo")) / F.when(F.abs("_w") < 1e-12, 1.0).otherwise(F.col("_w"))).drop("_lo", "_w")
