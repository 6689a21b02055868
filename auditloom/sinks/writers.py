"""Sinks: signal and sample tables, result files, the prediction cache, prior dumps, rendered tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_PARTS = ("model", "dataset_id", "part")


def write_datasets(signals: DataFrame, meta: DataFrame, names: Sequence[str], path: str) -> None:
    """One row per dataset: scalar metadata and one column per signal; ``label`` repeats ``true_label``."""
    scalars = [f.name for f in meta.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    wide = signals.groupBy("dataset_id").pivot("signal", list(names)).agg(F.first("value"))
    out = meta.select(*scalars).join(wide, "dataset_id", "left").withColumn("dataset_id", F.col("dataset_id").cast("string"))
    (out.withColumn("label", F.col("true_label")) if "true_label" in scalars else out).write.mode("overwrite").parquet(path)


def write_samples(parts: Sequence[DataFrame], path: str) -> None:
    """Fragments of different columns by name, ids as text."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.withColumn("dataset_id", F.col("dataset_id").cast("string")).write.mode("overwrite").parquet(path)


def result_json(metadata: dict, metrics: dict, rows: DataFrame) -> DataFrame:
    """One ``value`` of JSON per result row and a first one with metadata and metrics, for ``write.text``."""
    import json

    head = rows.sparkSession.createDataFrame([(json.dumps({"metadata": metadata, "metrics": metrics}),)], "value string")
    return head.unionByName(rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("value")))


def cache_predictions(pred: DataFrame, path: str) -> None:
    """Predictions by model, dataset and part; only partitions that come anew are replaced."""
    pred.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CACHE_PARTS).parquet(path)


def missing(plan: DataFrame, cached: DataFrame) -> DataFrame:
    keys = ["dataset_id", "manip_key", "pred_key"]
    return plan.join(cached.select(*keys).distinct(), keys, "left_anti")


def halves(dump: DataFrame, tables: int | None = None) -> DataFrame:
    """A prior dump parted at half its tables, which are numbered from 0; their number is counted where it is not given."""
    tables = (dump.agg(F.max("table_id")).first()[0] or 0) + 1 if tables is None else tables
    return dump.withColumn("part", F.when(F.col("table_id") < tables // 2, "a").otherwise("b"))


def padded(dump: DataFrame, most_rows: int, most_features: int) -> DataFrame:
    """A prior dump in which every table has ``most_rows`` rows of ``most_features`` features: zeros fill up, and
    ``n_rows, n_features`` say what is real. Larger tables are cut."""
    sizes = dump.groupBy("table_id").agg(F.least(F.count("*"), F.lit(most_rows)).alias("n_rows"), F.least(F.max(F.size("x")), F.lit(most_features)).alias("n_features"))
    grid = sizes.withColumn("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most_rows - 1).cast("long"))))
    zeros = F.array_repeat(F.lit(0.0), most_features)
    x = F.slice(F.concat(F.coalesce("x", F.expr("cast(array() as array<double>)")), zeros), 1, most_features)
    return grid.join(dump.select("table_id", "row_id", "x", "y"), ["table_id", "row_id"], "left").select("table_id", "row_id", x.alias("x"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"), "n_rows", "n_features")


def signed(mean: str, sd: str, digits: int = 4) -> Column:
    """``+.1234 ± .0050``; a dash where the mean is missing."""
    part = lambda c, sign: F.regexp_replace(F.format_string(f"%{sign}.{digits}f", F.col(c)), r"^([+-]?)0\.", "$1.")
    return F.when(F.col(mean).isNull(), F.lit("–")).otherwise(F.when(F.col(sd).isNull(), part(mean, "+")).otherwise(F.concat(part(mean, "+"), F.lit(" ± "), part(sd, ""))))


def markdown(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> str:
    """A table of few rows as Markdown."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("–")).alias(c) for c in columns], *[F.col(o).alias(f"_{i}") for i, o in enumerate(order)]).orderBy(*[f"_{i}" for i in range(len(order))]).select(*columns).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)] + ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join(lines)


def latex(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> str:
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("--")).alias(c) for c in columns], *[F.col(o).alias(f"_{i}") for i, o in enumerate(order)]).orderBy(*[f"_{i}" for i in range(len(order))]).select(*columns).collect()
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(columns) + r" \\ \hline", *(" & ".join(r).replace("±", r"$\pm$") + r" \\" for r in rows), r"\end{tabular}"])


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 40, low: float = 0.005, high: float = 0.995, log: bool = False) -> DataFrame:
    """``bin, share`` per group over the percentiles of all groups together; values outside go to the end bins."""
    v = F.log10(F.greatest(F.col(value), F.lit(1e-4))) if log else F.col(value)
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", v)
    values = rows.groupBy("_v").agg(F.count("*").alias("_c"))  # a value is one row, whatever its count
    span = values.agg(F.percentile("_v", low, F.col("_c")).alias("lo"), F.percentile("_v", high, F.col("_c")).alias("hi"))
    placed = rows.join(F.broadcast(span)).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0)))).cast("int"))  # one row of limits
    counts = placed.groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("_n"))
    return counts.join(totals, list(keys)).select(*keys, "bin", (F.col("c") / F.col("_n")).alias("share"))


def pvalue_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 24) -> DataFrame:
    """``bin, share`` of p-values in bins of equal logarithmic width from the least (1e-4 or more) to 1."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", F.log10(F.greatest(F.col(value), F.lit(1e-4))))
    low = rows.agg(F.min("_v").alias("lo"))
    cell = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("lo"), -F.col("lo")) * bins), F.lit(bins - 1))
    counts = rows.join(F.broadcast(low)).groupBy(*keys, F.greatest(F.lit(0), F.least(F.lit(bins - 1), cell)).cast("int").alias("bin")).agg(F.count("*").alias("c"))  # one row
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("_n"))
    return counts.join(totals, list(keys)).select(*keys, "bin", (F.col("c") / F.col("_n")).alias("share"))
