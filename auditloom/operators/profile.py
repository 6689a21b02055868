"""Column profiles, target selection, task types and metadata of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions import rng

MAX_NULLS, MAX_DISTINCT_SHARE, LOW_CARD, PER_LEVEL = 0.5, 0.2, 10, 2
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def is_date(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)


def is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType) and not isinstance(field.dataType, T.BooleanType)


def long_columns(df: DataFrame, key: Column, columns: Sequence[str]) -> DataFrame:
    """``dataset_id, col_name, numeric, date_type, value`` with one row per cell, in one pass."""
    fields = {f.name: f for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("col_name"), F.lit(is_number(fields[c])).alias("numeric"), F.lit(is_date(fields[c])).alias("date_type"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(key.alias("dataset_id"), F.explode(cells).alias("c")).select("dataset_id", "c.*")


def profile(df: DataFrame, key: Column, columns: Sequence[str]) -> DataFrame:
    """``n, n_null, n_distinct, min_level_count, is_date`` per dataset and column.

    A text column is a date if its values all read as ISO 8601 dates.
    """
    keys = ["dataset_id", "col_name", "numeric", "date_type"]
    levels = long_columns(df, key, columns).groupBy(*keys, "value").agg(F.count("*").alias("c"))
    seen = F.col("value").isNotNull()
    out = levels.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(~seen, F.col("c"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min(F.when(seen, F.col("c"))).alias("min_level_count"),
        F.coalesce(F.bool_and(F.when(seen, F.col("value").rlike(ISO_DATE))), F.lit(False)).alias("texts_date"),
    )
    return out.withColumn("is_date", F.col("date_type") | (~F.col("numeric") & F.col("texts_date"))).drop("date_type", "texts_date")


def eligible(profiles: DataFrame, relaxed: bool = False) -> DataFrame:
    """Columns that may be a target; ``relaxed`` lifts the limit on distinct values."""
    few = F.lit(True) if relaxed else F.col("n_distinct") <= MAX_DISTINCT_SHARE * F.col("n")
    sparse = ~F.col("numeric") | (F.col("n_null") <= MAX_NULLS * F.col("n"))
    counted = (F.col("numeric") & (F.col("n_distinct") > LOW_CARD)) | (F.col("min_level_count") >= PER_LEVEL)
    return profiles.where(~F.col("is_date") & sparse & (F.col("n_distinct") >= 2) & few & counted)


def choose_target(profiles: DataFrame, seed: int) -> DataFrame:
    """One column per dataset: a seeded draw among those of 2 to 10 distinct values
    (``lowcard``), else the one of fewest (``fallback``); strict candidates before relaxed ones."""
    both = eligible(profiles).withColumn("strict", F.lit(0)).unionByName(eligible(profiles, relaxed=True).withColumn("strict", F.lit(1)))
    low = F.col("n_distinct") <= LOW_CARD
    ranked = both.withColumn("rule", F.when(low, "lowcard").otherwise("fallback"))
    order = Window.partitionBy("dataset_id").orderBy("strict", F.when(low, 0).otherwise(1), F.when(low, F.lit(0)).otherwise(F.col("n_distinct")), F.when(low, rng.order_key(seed, "target", "dataset_id", "col_name")).otherwise(F.col("col_name")))
    return ranked.withColumn("r", F.row_number().over(order)).where("r = 1").select("dataset_id", "col_name", "rule", "n_distinct")


def task_type(profiles: DataFrame) -> DataFrame:
    """Numeric with over 20 distinct values: regression; other columns: classification if every level has two rows, numeric ones only."""
    rule = F.when(F.col("numeric") & (F.col("n_distinct") > 20), "regression").when(F.col("numeric") & (F.col("min_level_count") < 2), "regression").otherwise("classification")
    return profiles.withColumn("task_type", rule)


def unpivoted(obs: DataFrame) -> DataFrame:
    """``dataset_id, row_id, y, j, v`` for each feature."""
    return obs.select("dataset_id", "row_id", F.col("y").cast("double").alias("y"), F.posexplode("x").alias("j", "v"))


def metadata(obs: DataFrame) -> DataFrame:
    """Per dataset and feature: mean, variance and the least-squares line against the target (null for a constant)."""
    per = unpivoted(obs).groupBy("dataset_id", "j").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.avg("y").alias("y_mean"), F.regr_slope("y", "v").alias("slope"), F.regr_intercept("y", "v").alias("intercept"))
    flat = F.col("variance") <= 0
    return per.withColumn("slope", F.when(~flat, F.col("slope"))).withColumn("intercept", F.when(~flat, F.col("intercept")))


def raw_features(obs: DataFrame) -> DataFrame:
    """Size, column-moment, cardinality and class features of each dataset."""
    column = unpivoted(obs).groupBy("dataset_id", "j").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"), F.avg(F.when(F.col("v").isNull(), 1.0).otherwise(0.0)).alias("missing"), (F.count_distinct("v") / F.count("*")).alias("distinct_share"))
    names = ("mean", "std", "skew", "kurt")
    cols = column.groupBy("dataset_id").agg(
        F.count("*").alias("n_features"),
        *[F.avg(c).alias(f"col_{c}_avg") for c in names],
        *[F.stddev_pop(c).alias(f"col_{c}_sd") for c in names],
        F.avg("missing").alias("missing_avg"), F.max("missing").alias("missing_max"),
        F.avg("distinct_share").alias("distinct_avg"), F.min("distinct_share").alias("distinct_min"), F.max("distinct_share").alias("distinct_max"),
    )
    share = F.col("c") / F.col("n_rows")
    counts = obs.groupBy("dataset_id", "y").agg(F.count("*").alias("c")).withColumn("n_rows", F.sum("c").over(Window.partitionBy("dataset_id")))
    classes = counts.groupBy("dataset_id").agg(F.max("n_rows").alias("n_rows"), F.count("*").alias("n_classes"), F.sum(-share * F.log(share)).alias("class_entropy"), F.max(share).alias("majority"), F.min(share).alias("minority"))
    target = obs.groupBy("dataset_id").agg(F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_std"))
    return cols.join(classes, "dataset_id").join(target, "dataset_id").withColumn("log_rows", F.log1p("n_rows")).withColumn("log_features", F.log1p("n_features")).withColumn("rows_per_feature", F.col("n_rows") / F.col("n_features"))


def size_guard(sizes: DataFrame, least: int, test_share: float, n: str = "n") -> DataFrame:
    """``ok`` and the reason of a refusal for each dataset's number of rows."""
    test, train = F.greatest(F.lit(10), F.floor(F.col(n) * test_share)), F.greatest(F.lit(10), F.floor(F.col(n) * (1 - test_share)))
    reason = F.when(F.col(n) < least, "too few rows").when(F.col(n) < test + train, "too few to split")
    return sizes.withColumn("reason", reason).withColumn("ok", reason.isNull())


def wide_guard(sizes: DataFrame, most: int = 10_000) -> DataFrame:
    return sizes.withColumn("reason", F.when(F.col("n_features") > most, "too many features"))
