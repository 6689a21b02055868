"""Readers: tables by id, path indexes, prior dumps, result files, membership registries."""

from __future__ import annotations

import gzip
import io
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions import rng
from auditloom.operators import split

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(family: str):
    """Registers a reader for tables of a family."""

    def add(f):
        READERS[family] = f
        return f

    return add


def load(spark: SparkSession, family: str, dataset_id: str, **options) -> DataFrame:
    """The table of an id, read by its family's reader."""
    if family not in READERS:
        raise KeyError(f"no reader for family {family!r}; known: {sorted(READERS)}")
    return READERS[family](spark, dataset_id, **options)


@reader("parquet")
def by_path(spark: SparkSession, dataset_id: str, root: str = ".") -> DataFrame:
    return spark.read.parquet(f"{root}/{dataset_id}.parquet")


@reader("split")
def by_path_split(spark: SparkSession, dataset_id: str, root: str = ".", row: str = "row_id", seed: int = 42, valid: float = 0.15, test: float = 0.15) -> DataFrame:
    """A table with a seeded ``split``: the first shares in hash order are test and valid, the rest train."""
    rows = by_path(spark, dataset_id, root).withColumn("_one", F.lit(1))
    ranked = split.hash_rank(rows, ["_one"], seed, "split", row).withColumn("_n", F.count("*").over(Window.partitionBy("_one")))
    part = F.when(F.col("hr") <= F.floor(F.col("_n") * test), "test").when(F.col("hr") <= F.floor(F.col("_n") * (test + valid)), "valid").otherwise("train")
    return ranked.withColumn("split", part).drop("_one", "_n", "hr")


@reader("arrays")
def by_arrays(spark: SparkSession, dataset_id: str, root: str = ".", fold: int = 0) -> DataFrame:
    """``row_id, x, y, split`` of a task in a folder of ``X.npy.gz``, ``y.npy.gz`` and ``split_indices.json``
    (per fold: lists of rows by split; rows in none have null). One file is one array, read by one task."""
    import json

    folder = f"{root}/{dataset_id}"

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                array = np.load(io.BytesIO(gzip.decompress(content)), allow_pickle=False)
                yield pd.DataFrame({"row_id": np.arange(len(array)), "v": array.reshape(len(array), -1).astype(float).tolist()})

    arrays = [spark.read.format("binaryFile").load(f"{folder}/{name}.npy.gz").select("content").mapInPandas(unpacked, f"row_id long, {c} array<double>".replace(f" {c} ", " v ")).withColumnRenamed("v", c) for name, c in (("X", "x"), ("y", "y"))]
    folds = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{folder}/split_indices.json").collect()))
    listed_ = [(int(i), name) for name, rows in folds[fold].items() for i in rows]
    return arrays[0].join(arrays[1].withColumn("y", F.get("y", F.lit(0))), "row_id").join(spark.createDataFrame(listed_, "row_id long, split string"), "row_id", "left")


def with_retries(read: Callable[[], DataFrame], attempts: int = 3, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The result of ``read``, tried again after waits that double up to ``most`` seconds; tasks have Spark's own retries."""
    for attempt in range(attempts):
        try:
            return read()
        except Exception:  # whatever a store raises
            if attempt == attempts - 1:
                raise
            sleep(min(most, first * 2**attempt))
    raise ValueError("no attempts")


def of_task(tables: DataFrame, types: DataFrame, task: str = "classification", key: str = "dataset_id") -> DataFrame:
    """Tables whose type (``key, task_type``) is the task."""
    return tables.join(types.where(F.col("task_type") == task).select(key).distinct(), key, "left_semi")


def guarded(df: DataFrame, row: str, columns: Sequence[str], target: str, least: int = 50, test: float = 0.3, seed: int = 42, whole: bool = False) -> DataFrame:
    """``row_id, x, y`` and, unless ``whole``, a seeded ``split``: numbers cast, infinite ones null, rows without a
    target left out; too few rows are a ValueError."""
    from auditloom.operators import instances, prep

    rows = df.select(F.col(row).alias("row_id"), F.array(*[prep.clean(c) for c in columns]).alias("x"), prep.clean(target).alias("y")).where("y is not null")
    instances._checked(rows.count(), least, test)
    return rows if whole else instances._split(rows, None, test, seed)


@reader("index")
def by_index(spark: SparkSession, dataset_id: str, index: DataFrame) -> DataFrame:
    """Through an ``id, path`` index."""
    hit = index.where(F.col("id") == dataset_id).select("path").first()
    if hit is None:
        raise KeyError(dataset_id)
    return spark.read.parquet(hit["path"])


@reader("task")
def by_task(spark: SparkSession, dataset_id: str, root: str, fold: int = 0, valid: float = 0.15) -> DataFrame:
    """A table with its published folds: ``split`` is train, valid or test."""
    rows, folds = spark.read.parquet(f"{root}/{dataset_id}.parquet"), spark.read.parquet(f"{root}/{dataset_id}.splits.parquet")
    joined = rows.join(folds.where(F.col("fold") == fold).select("row_id", F.col("split").alias("_s")), "row_id")
    order = Window.partitionBy("_s").orderBy(rng.order_key(42, "valid", "row_id"), "row_id")
    place, n = F.row_number().over(order), F.count("*").over(Window.partitionBy("_s"))
    return joined.withColumn("split", F.when((F.col("_s") == "train") & (place <= F.ceil(n * F.lit(valid))), "valid").otherwise(F.col("_s"))).drop("_s")


@reader("synthetic")
def from_dump(spark: SparkSession, dataset_id: str, dump: DataFrame, regression: bool = False, seed: int = 42) -> DataFrame:
    """One table of a prior dump: rows without a target go (for regression those without a feature too),
    the first ``single_eval_pos`` in seeded order are train; where none are left, a fifth is test."""
    return prior_tables(dump.where(F.col("table_id") == int(dataset_id)), regression, seed)


def prior_tables(dump: DataFrame, regression: bool = False, seed: int = 42) -> DataFrame:
    ok = F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double"))
    if regression:
        ok = ok & ~F.exists("x", lambda v: v.isNull() | F.isnan(v.cast("double")))
    ranked = split.hash_rank(dump.where(ok), ["table_id"], seed, "prior").withColumn("n", F.count("*").over(Window.partitionBy("table_id")))
    cut = F.when(F.col("single_eval_pos") < F.col("n"), F.col("single_eval_pos")).otherwise(F.ceil(F.col("n") * 0.8))
    return ranked.withColumn("split", F.when(F.col("hr") <= cut, "train").otherwise("test")).drop("hr", "n")


def prior_batches(dump: DataFrame, batch: int, tables: int, first: int = 0, steps: int = 1) -> DataFrame:
    """``step`` and the dump's rows of its tables: consecutive tables that wrap around at ``tables``."""
    wanted = dump.sparkSession.range(steps * batch).select((F.col("id") / batch).cast("int").alias("step"), ((F.col("id") + first) % tables).alias("table_id"))
    return dump.join(wanted, "table_id")


def generated(spark: SparkSession, tables: int, rows: int, features: int, classes: int = 2, seed: int = 0, prior: str = "linear") -> DataFrame:
    """A prior dump of random classification tables, made where it is used: ``linear`` scores, ``mlp`` (tanh of
    eight random sums) or ``steps`` (a random step along each feature)."""
    base = spark.range(tables).select(F.col("id").alias("table_id")).withColumn("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    x = F.array(*[rng.normal(seed, f"x{j}", "table_id", "row_id") for j in range(features)])
    w = [rng.normal(seed, f"w{j}", "table_id") for j in range(features)]
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    value = lambda j: F.get("x", F.lit(j))
    scores = {
        "linear": lambda: total([value(j) * w[j] for j in range(features)]),
        "mlp": lambda: total([rng.normal(seed, f"o{h}", "table_id") * F.tanh(total([value(j) * rng.normal(seed, f"h{h},{j}", "table_id") for j in range(features)])) for h in range(8)]),
        "steps": lambda: total([w[j] * F.when(value(j) > rng.normal(seed, f"t{j}", "table_id"), 1.0).otherwise(-1.0) for j in range(features)]),
    }
    score = scores[prior]()
    return base.withColumn("x", x).withColumn("y", F.least(F.floor(F.lit(classes) / (F.lit(1.0) + F.exp(-score))), F.lit(classes - 1)).cast("double")).withColumn("single_eval_pos", F.lit(rows // 2))


def path_index(files: DataFrame) -> DataFrame:
    """``id, path`` of parquet files by stem; the first path of an id wins."""
    stems = files.select("path", F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("id")).where("id <> ''")
    return stems.groupBy("id").agg(F.min("path").alias("path"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root`` by Spark's own listing; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")


def membership_by_rows(tables: DataFrame, key: str, least: int = 150) -> DataFrame:
    """``n_rows`` and ``label``: 1 for tables of more than ``least`` rows."""
    return tables.groupBy(key).agg(F.count("*").alias("n_rows")).withColumn("label", F.when(F.col("n_rows") > least, 1).otherwise(0))


def registry(spark: SparkSession, members: dict[str, Sequence], others: dict[str, Sequence]) -> DataFrame:
    """``family, dataset_id, label, ordinal`` of listed members and non-members by family."""
    rows = [(f, str(i), label, n) for label, lists in ((1, members), (0, others)) for f, ids in lists.items() for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "family string, dataset_id string, label int, ordinal int")


def labelled(tables: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``label`` 1 for ids among ``members``."""
    return tables.join(members.select(F.col(key)).distinct().withColumn("_m", F.lit(1)), key, "left").withColumn("label", F.coalesce("_m", F.lit(0))).drop("_m")


_WORDS = r"[^A-Za-z0-9\u00c0-\u024f]+"


def passages(items: DataFrame, docs: DataFrame, item_id: str, doc_id: str, text: str = "text") -> DataFrame:
    """``item_id, doc_id`` of every document whose text contains an item's as it is.

    A word within an item, delimited there, is delimited in any text that holds the item too, so the longest
    such word of each item is a join key, and only documents with that word are looked into. Items without one
    (a single word or two) are a query set that every text is held against.
    """
    own = items.select(F.col(item_id), F.col(text).alias("item")).where("item is not null")
    words = F.split("item", _WORDS)
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.length(w) > 0)
    keyed = own.withColumn("key", F.get(F.array_sort(inner, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(0)))
    held = docs.select(F.col(doc_id), F.col(text).alias("text"))
    wanted = keyed.where("key is not null").select("key").distinct()
    found = held.select(doc_id, F.explode(F.array_distinct(F.split("text", _WORDS))).alias("key")).join(wanted, "key", "left_semi")
    near = found.join(keyed.select("key", item_id), "key").join(held, doc_id).join(own, item_id).where(F.contains("text", "item"))
    short = keyed.where("key is null").join(held, F.contains("text", "item"))
    return near.select(item_id, doc_id).unionByName(short.select(item_id, doc_id))


def results(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of ``successful_results`` of result files, with the file's place; nested fields as they are."""
    files = spark.read.option("multiLine", True).json(list(paths))
    return files.select(F.explode("successful_results").alias("r")).select("r.*")


def latest(spark: SparkSession, files: DataFrame) -> str | None:
    """The last path in order of name."""
    return files.agg(F.max("path").alias("p")).first()["p"]


def signal_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Signal tables of several files, merged by name; failed rows go."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    return df.where(F.col("success")) if "success" in df.columns else df


def suite(registry_: DataFrame, most_features: int = 500, most_rows: int = 10_000, task: str = "classification") -> DataFrame:
    """Datasets of a benchmark suite that are small enough to evaluate on."""
    return registry_.where((F.col("task_type") == task) & (F.col("n_features") <= most_features) & (F.col("n_rows") <= most_rows))


def suite_instances(registry_: DataFrame, folds: DataFrame, fold: int = 0, **limits) -> DataFrame:
    """Rows of ``folds`` (``dataset_id, fold, row_id, split``) of one fold of a suite's datasets."""
    return folds.where(F.col("fold") == fold).join(suite(registry_, **limits).select("dataset_id").distinct(), "dataset_id", "left_semi")
