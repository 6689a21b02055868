"""From a raw table to the instances of a task: target, encoded features, split and what was decided."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import rng
from auditloom.operators import prep, profile, split

MOST_CLASSES = 10


@dataclass
class Instances:
    """``rows``: ``row_id, split, x, y``; ``columns``: names of the features in order; ``metadata``: decisions."""

    rows: DataFrame
    columns: list[str]
    metadata: dict = field(default_factory=dict)


def pick_target(profiles: DataFrame, seed: int, task: str | None = None, fewest: bool = False, last: str | None = None) -> str:
    """A target among columns that are no dates, not half null, of levels that repeat.

    A seeded draw; for ``task`` classification only among those of 2 to 10 values, and none is an error. With
    ``fewest`` those of 2 to 10 values are drawn from where there are any (from all columns that may be capped if
    need be), else the one of fewest values is taken. Otherwise, where nothing fits, ``last`` with a warning.
    """
    numeric = F.col("numeric")
    sound = ~F.col("is_date") & F.when(numeric, F.col("n_null") <= 0.5 * F.col("n")).otherwise(F.coalesce(F.col("min_level_count") >= 2, F.lit(True)))
    rows = profiles.where(sound).select("col_name", "n_distinct", (F.col("n_distinct") <= 0.2 * F.col("n")).alias("few")).collect()  # one row per column
    key = lambda r: (draw[r["col_name"]], r["col_name"])
    draw = {r["col_name"]: r["k"] for r in profiles.select("col_name", rng.order_key(seed, "target", "dataset_id", "col_name").alias("k")).collect()}
    valid = [r for r in rows if r["few"]]
    if fewest:
        open_ = [r for r in (valid or rows) if r["n_distinct"] >= 2] or valid or rows
        low = [r for r in open_ if 2 <= r["n_distinct"] <= MOST_CLASSES]
        if low:
            return min(low, key=key)["col_name"]
        if open_:
            return min(open_, key=lambda r: (r["n_distinct"], r["col_name"]))["col_name"]
    elif task == "classification":
        valid = [r for r in valid if 2 <= r["n_distinct"] <= MOST_CLASSES]
    if valid:
        return min(valid, key=key)["col_name"]
    if task == "classification" or last is None:
        raise ValueError("no column can be a classification target")
    warnings.warn(f"no column can be a target; {last} is taken", stacklevel=2)
    return last


def encoded(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """``row_id, x``: numbers as they are (infinite ones null), other columns as codes of their sorted levels, null as null."""
    fields = {f.name: f for f in df.schema.fields}
    out, cells = df.withColumn("_one", F.lit(1)), []
    for i, c in enumerate(columns):
        if profile.is_number(fields[c]):
            cells.append(prep.clean(c))
        else:
            out = prep.ordinal_encode(out.withColumn(f"_t{i}", F.col(c).cast("string")), ["_one"], f"_t{i}", f"_c{i}")
            cells.append(F.col(f"_c{i}").cast("double"))
    return out.select(F.col(row).alias("row_id"), F.array(*cells).alias("x") if cells else F.expr("cast(array() as array<double>)").alias("x"))


def _checked(n: int, least: int, test: float) -> None:
    if n < least:
        raise ValueError(f"{n} rows, fewer than {least}")
    if n < max(10, int(n * test)) + max(10, int(n * (1 - test))):
        raise ValueError(f"{n} rows are too few to split")


def _split(df: DataFrame, label: str | None, test: float, seed: int) -> DataFrame:
    one = df.withColumn("_one", F.lit(1))
    return (split.stratified_split(one, ["_one"], label, test, seed) if label else split.random_split(one, ["_one"], test, seed)).drop("_one")


def forced_classification(df: DataFrame, row: str, seed: int = 42, test: float = 0.3, least: int = 50, whole: bool = False) -> Instances:
    """A table as a classification task, whatever it was made for.

    The target is chosen from the profile, rows without it go, the split is stratified where the target has few
    values; others are binned or capped with what the training part shows (``whole``: all rows are that).
    """
    names = [c for c in df.columns if c != row]
    chosen = profile.choose_target(profile.profile(df, F.lit(0), names), seed).first()
    if chosen is None:
        raise ValueError("no column can be a target")
    column, rule = chosen["col_name"], chosen["rule"]
    numeric = profile.is_number(df.schema[column])
    kept = df.where(F.col(column).isNotNull())
    _checked(kept.count(), least, test)
    y = F.col(column).cast("double" if numeric else "string")
    base = kept.select(F.col(row).alias("row_id"), y.alias("y"))
    parted = base.withColumn("split", F.lit("train")) if whole else _split(base, "y" if rule == "lowcard" else None, test, seed)
    one = parted.withColumn("_one", F.lit(1))
    if rule != "lowcard":
        one, rule = _discretised(one, numeric)
    coded = prep.label_encode(one, ["_one"], "y", "code", MOST_CLASSES).select("row_id", "split", F.col("code").alias("y"))
    features = [c for c in names if c != column]
    rows = coded.join(encoded(kept, row, features), "row_id")
    return Instances(rows, features, {"target_type": "classification", "column": column, "rule": rule, "n_classes": one.select("y").distinct().count()})


def _discretised(rows: DataFrame, numeric: bool) -> tuple[DataFrame, str]:
    """At most ten levels by what the training rows show; numbers of few training values get those as their bins."""
    if rows.select("y").distinct().limit(MOST_CLASSES + 1).count() <= MOST_CLASSES:
        return rows, "fallback"
    train = rows.where("split = 'train'")
    if not numeric:
        return prep.cap_levels(train, rows, ["_one"], "y", MOST_CLASSES, "_y").drop("y").withColumnRenamed("_y", "y"), "capped"
    values = train.groupBy("_one").agg(F.array_sort(F.collect_set("y")).alias("v")).select(F.slice("v", 2, MOST_CLASSES).alias("few"), F.size("v").alias("k")) if train.select("y").distinct().limit(MOST_CLASSES + 1).count() <= MOST_CLASSES else None
    if values is None:
        return prep.quantile_bin(train, rows, ["_one"], "y", MOST_CLASSES, "_y").drop("y").withColumnRenamed("_y", "y"), "binned"
    edges = values.first()["few"]  # under ten numbers
    return rows.withColumn("y", sum((F.when(F.col("y") >= e, 1.0).otherwise(0.0) for e in edges), F.lit(0.0))), "binned"


def prepared(df: DataFrame, row: str, column: str, seed: int = 42, test: float = 0.3, bin_to: int | None = None, task: str | None = None) -> Instances:
    """Rows that have the target, binned or capped to ``bin_to`` levels if wanted, with the task's type found,
    features encoded and a split: stratified where every class has two rows."""
    numeric = profile.is_number(df.schema[column])
    kept = df.where(F.col(column).isNotNull())
    base = kept.select(F.col(row).alias("row_id"), F.col(column).cast("double" if numeric else "string").alias("y")).withColumn("_one", F.lit(1))
    binned = False
    if bin_to:
        before = base.select("y").distinct().limit(bin_to + 1).count()
        if before > bin_to:
            f = prep.quantile_bin(base, base, ["_one"], "y", bin_to, "_y") if numeric else prep.cap_categories(base, ["_one"], "y", bin_to, "_y")
            base, binned = f.drop("y").withColumnRenamed("_y", "y"), True
    sizes = base.groupBy("y").agg(F.count("*").alias("c")).agg(F.count("*").alias("k"), F.min("c").alias("least"), F.sum("c").alias("n")).first()
    if not sizes["n"]:
        raise ValueError("no row has a target")
    kind = "regression" if numeric and (sizes["k"] > 20 or sizes["least"] < 2) else "classification"
    stratify = sizes["least"] >= 2
    if task == "classification" or (bin_to and 2 <= sizes["k"] <= bin_to):
        kind = "classification"
    if kind == "classification":
        levels = max(sizes["k"], MOST_CLASSES)
        base = prep.label_encode(base.withColumn("y", F.col("y").cast("string")), ["_one"], "y", "code", levels).drop("y").withColumnRenamed("code", "y")
    parted = _split(base.drop("_one"), "y" if kind == "classification" and stratify else None, test, seed)
    features = [c for c in df.columns if c not in (row, column)]
    meta = {"target_type": kind, "n_samples": sizes["n"], "n_features": len(features), "n_classes": sizes["k"] if kind == "classification" else None, "target_was_binned": binned, "stratified": kind == "classification" and stratify}
    return Instances(parted.select("row_id", "split", "y").join(encoded(kept, row, features), "row_id"), features, meta)


def feature_matrix(fit: DataFrame, apply: DataFrame, row: str, columns: Sequence[str]) -> Instances:
    """``row_id, x`` for ``apply`` with what ``fit`` shows: columns of one value go; a column of which every value
    reads as a number is filled with its mean, others are coded by sorted level (unknown ones count as missing) and
    filled with the commonest; columns with missing values in ``fit`` get an indicator, all of them at the end."""
    seen = profile.long_columns(fit, F.lit(0), columns).where("value is not null")
    number = lambda c: c.try_cast("double")
    levels = seen.groupBy("col_name", "value").agg(F.count("*").alias("c"))
    facts = levels.groupBy("col_name").agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.bool_and(number(F.col("value")).isNotNull()).alias("number"), (F.sum(number(F.col("value")) * F.col("c")) / F.sum("c")).alias("mean"))
    order = Window.partitionBy("col_name").orderBy("value")
    coded = levels.withColumn("code", (F.row_number().over(order) - 1).cast("double"))
    mode = coded.groupBy("col_name").agg(F.max_by("code", F.struct("c", -F.col("code"))).alias("mode"))
    known = {r["col_name"]: r for r in facts.join(mode, "col_name").where("k > 1").collect()}  # one row per column
    total = fit.count()
    names = [c for c in columns if c in known]
    out, cells, gaps = apply.withColumn("_row", F.col(row)), [], []
    for i, c in enumerate(names):
        r = known[c]
        if r["number"]:
            value: Column = number(F.col(c).cast("string"))
        else:
            own = coded.where(F.col("col_name") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
            out = out.join(own, F.col(c).cast("string") == F.col(f"_v{i}"), "left")
            value = F.col(f"_c{i}")
        cells.append(F.coalesce(value, F.lit(r["mean"] if r["number"] else r["mode"])))
        if r["n"] < total:
            gaps.append((f"{c}_missing", value.isNull().cast("double")))
    every = [*cells, *(g for _, g in gaps)]
    rows = out.select(F.col("_row").alias("row_id"), F.array(*every).alias("x") if every else F.expr("cast(array() as array<double>)").alias("x"))
    return Instances(rows, [*names, *(n for n, _ in gaps)])
