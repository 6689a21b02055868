"""Which datasets a model was trained on: listed members, and what that makes of all other families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def membership(registry: DataFrame, universe: DataFrame, family: str | None = None) -> DataFrame:
    """``family, dataset_id, label``: what ``registry`` lists (``family, dataset_id, label``), and every dataset of
    a family that the registry does not list as a non-member.

    With ``family`` that family alone, which may have no members. Without, a pool needs both: ValueError else.
    """
    listed = registry.select("family", F.col("dataset_id").cast("string").alias("dataset_id"), F.col("label").cast("int").alias("label"))
    others = universe.select("family", F.col("dataset_id").cast("string").alias("dataset_id")).join(listed.select("family").distinct(), "family", "left_anti").distinct().withColumn("label", F.lit(0))
    every = listed.unionByName(others)
    if family is not None:
        return every.where(F.col("family") == family)
    sizes = every.agg(F.max("label").alias("hi"), F.min("label").alias("lo")).first()
    if sizes["hi"] != 1 or sizes["lo"] != 0:
        raise ValueError("a pool needs members and non-members")
    return every


def synthetic_sides(spark, sizes: dict[str, int], split: float = 0.5) -> DataFrame:
    """The ids ``task/ordinal`` of a generated corpus by task, the first ``split`` of each as members."""
    parts = [spark.range(n).select(F.lit("synthetic").alias("family"), F.concat(F.lit(f"{task}/"), F.col("id")).alias("dataset_id"), (F.col("id") < int(n * split)).cast("int").alias("label")) for task, n in sizes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_ids(a: DataFrame, b: DataFrame, key: str = "dataset_id") -> int:
    """How many ids two tables share."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").count()
