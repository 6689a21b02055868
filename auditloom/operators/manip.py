"""Perturbations of a dataset's context and query rows, each a DataFrame to a DataFrame.

Frames are ``dataset_id, row_id, role, x, y`` with role context or query. Doses
and draws go by hash order, so results do not depend on partitioning.

A frame may hold many versions of its datasets, told apart by a column ``run``;
doses, counts, places and seeds may then be columns, so one plan makes all doses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import arrays as A
from auditloom.functions import rng
from auditloom.operators import prep

CONTEXT, QUERY = "context", "query"


Value = float | int | Column


def keys(df: DataFrame) -> list[str]:
    return ["dataset_id", "run"] if "run" in df.columns else ["dataset_id"]


def columns(df: DataFrame) -> list[str]:
    """What copies of rows keep besides labels: ``own``, a label from before, only where a frame has it."""
    return [*keys(df), "row_id", "role", "x", *(["own"] if "own" in df.columns else [])]


def dataset(df: DataFrame):
    return Window.partitionBy(*keys(df))


def _value(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def with_roles(obs: DataFrame, share: float = 0.3, seed: int = 42) -> DataFrame:
    """The first ceil(share * n) rows of each dataset in seeded order are the query."""
    order = dataset(obs).orderBy(rng.order_key(seed, "role", "dataset_id", "row_id"), "row_id")
    return obs.withColumn("role", F.when(F.row_number().over(order) <= F.ceil(F.count("*").over(dataset(obs)) * F.lit(share)), QUERY).otherwise(CONTEXT))


def _in(role: str) -> Column:
    return F.col("role") == role


def _context_rank(df: DataFrame, seed: int, tag: str, role: str = CONTEXT) -> DataFrame:
    """``hr``: place of each row among its dataset's rows of the same role, ``n_ctx``: context rows."""
    order = Window.partitionBy(*keys(df), "role").orderBy(rng.order_key(seed, tag, "dataset_id", "row_id"), "row_id")
    return df.withColumn("hr", F.row_number().over(order)).withColumn("n_ctx", F.sum(F.when(_in(CONTEXT), 1).otherwise(0)).over(dataset(df)))


def task_shuffle(df: DataFrame, k: int | Column, bins: int = 10) -> DataFrame:
    """Feature ``k`` becomes the target, binned by edges of the context; the old target becomes the last feature."""
    moved = df.withColumn("all", F.concat("x", F.array(F.col("y").cast("double")))).withColumn("t", F.get("all", _value(k))).withColumn("x", A.without(F.col("all"), _value(k))).drop("all", "y")
    return prep.quantile_bin(moved.where(_in(CONTEXT)), moved, keys(df), "t", bins, "y").drop("t")


TRANSFORMS = {
    "log": lambda v: F.signum(v) * F.log1p(F.abs(v)),
    "sqrt": lambda v: F.signum(v) * F.sqrt(F.abs(v)),
    "square": lambda v: v * v,
    "reciprocal": lambda v: F.signum(v) / (F.lit(1.0) + F.abs(v)),
}


def feature_transform(df: DataFrame, kind: str | Column) -> DataFrame:
    if isinstance(kind, Column):
        return df.withColumn("x", F.coalesce(*[F.when(kind == k, F.transform("x", f)) for k, f in TRANSFORMS.items()]))
    return df.withColumn("x", F.transform("x", TRANSFORMS[kind]))


def row_shuffle(df: DataFrame, seed: int | Column) -> DataFrame:
    """Context rows in a seeded order, query rows in their own: column ``ord`` from 0."""
    order = Window.partitionBy(*keys(df), "role").orderBy(F.when(_in(CONTEXT), rng.order_key(seed, "rows", "dataset_id", "row_id")), "row_id")
    return df.withColumn("ord", F.row_number().over(order) - 1)


def subsample_rows(df: DataFrame, n: int | Column, seed: int = 42) -> DataFrame:
    """The first ``n`` context rows in seeded order; all where there are no more."""
    return _context_rank(df, seed, "sub").where(_in(QUERY) | (F.col("hr") <= n)).drop("hr", "n_ctx")


def subsample_share(df: DataFrame, share: Value, seed: int = 42) -> DataFrame:
    """Like ``subsample_rows`` for floor(n * share) rows, two at least, of each dataset's n rows of either role."""
    n = F.count("*").over(dataset(df))
    most = F.greatest(F.lit(2), F.floor(F.col("_n") * _value(share)))
    return _context_rank(df.withColumn("_n", n), seed, "sub").where(_in(QUERY) | (F.col("hr") <= most)).drop("hr", "n_ctx", "_n")


def query_only(df: DataFrame) -> DataFrame:
    """A context of its first row alone."""
    first = Window.partitionBy(*keys(df), "role").orderBy("row_id")
    return df.withColumn("_r", F.row_number().over(first)).where(_in(QUERY) | (F.col("_r") == 1)).drop("_r")


def kept_columns(d: int, n: int, seed: int) -> list[int]:
    """Seeded choice of ``n`` of ``d`` columns, in order."""
    import hashlib

    order = sorted(range(d), key=lambda j: (hashlib.md5(f"{seed}|cols|{j}".encode()).hexdigest(), j))
    return sorted(order[:n])


def subsample_columns(df: DataFrame, d: int, n: int | Column, seed: int) -> DataFrame:
    listed = lambda m: F.array(*[F.lit(j) for j in kept_columns(d, m, seed)])
    kept = F.coalesce(*[F.when(n == m, listed(m)) for m in range(1, d + 1)]) if isinstance(n, Column) else listed(n)
    return df.withColumn("x", A.project(F.col("x"), kept))


def inject_noise(df: DataFrame, level: Value, seed: int) -> DataFrame:
    """Context features plus ``level`` times their spread times normal draws; a null stays null."""
    long = df.where(_in(CONTEXT)).select(*keys(df), F.posexplode("x").alias("j", "v"))
    spread = long.groupBy(*keys(df), "j").agg((F.stddev_pop("v") + F.lit(A.EPS)).alias("s")).groupBy(*keys(df)).agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("spread"))  # as many as there are features
    z = lambda i: rng.normal(seed, "noise", F.col("dataset_id"), F.col("row_id"), i)
    noisy = F.transform("x", lambda v, i: v + _value(level) * F.get("spread", i)["s"] * z(i))
    return df.join(spread, keys(df)).withColumn("x", F.when(_in(CONTEXT), noisy).otherwise(F.col("x"))).drop("spread")


def labels(df: DataFrame) -> DataFrame:
    """``dataset_id, ls``: sorted distinct context labels."""
    return df.where(_in(CONTEXT)).groupBy(*keys(df)).agg(F.array_sort(F.collect_set("y")).alias("ls"))


def label_permutation(df: DataFrame, seed: int | Column) -> DataFrame:
    """Labels of all rows moved by a seeded permutation of the dataset's label set."""
    levels = df.select(*keys(df), "y", (_value(seed) if isinstance(seed, Column) else F.lit(str(seed))).alias("_seed")).distinct()
    a = levels.withColumn("r", F.row_number().over(dataset(df).orderBy("y"))).drop("_seed")
    b = levels.withColumn("r", F.row_number().over(dataset(df).orderBy(rng.order_key(F.col("_seed"), "perm", "dataset_id", "y"), "y"))).withColumnRenamed("y", "to").drop("_seed")
    return df.join(a.join(b, [*keys(df), "r"]).drop("r"), [*keys(df), "y"]).withColumn("y", F.col("to")).drop("to")


def constant_labels(df: DataFrame) -> DataFrame:
    """All context labels as the commonest one, of equals the one seen first."""
    counts = df.where(_in(CONTEXT)).groupBy(*keys(df), "y").agg(F.count("*").alias("c"), F.min("row_id").alias("first"))
    mode = counts.groupBy(*keys(df)).agg(F.max_by("y", F.struct("c", -F.col("first"))).alias("mode"))
    return df.join(mode, keys(df)).withColumn("y", F.when(_in(CONTEXT), F.col("mode")).otherwise(F.col("y"))).drop("mode")


def other_label(seed: int, tag: str) -> Column:
    """A seeded label of ``ls`` other than ``y``; ``y`` itself where there is none."""
    rest = F.array_except("ls", F.array("y"))
    return F.when(F.size(rest) == 0, F.col("y")).otherwise(F.get(rest, rng.whole(seed, tag, F.size(rest), "dataset_id", "row_id")))


def mislabel_random(df: DataFrame, share: Value, seed: int) -> DataFrame:
    """floor(n * share) context rows get another label."""
    chosen = _in(CONTEXT) & (F.col("hr") <= F.floor(F.col("n_ctx") * _value(share)))
    return _context_rank(df, seed, "mis").join(labels(df), keys(df)).withColumn("y", F.when(chosen, other_label(seed, "to")).otherwise(F.col("y"))).drop("hr", "n_ctx", "ls")


def mislabel_swap(df: DataFrame, share: Value, seed: int) -> DataFrame:
    """Among floor(n * share) context rows, the two commonest labels change places."""
    counts = df.where(_in(CONTEXT)).groupBy(*keys(df), "y").agg(F.count("*").alias("c"))
    order = dataset(df).orderBy(F.desc("c"), "y")
    top = counts.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy(*keys(df)).agg(F.max(F.when(F.col("r") == 1, F.col("y"))).alias("l1"), F.max(F.when(F.col("r") == 2, F.col("y"))).alias("l2"))
    chosen = _in(CONTEXT) & (F.col("hr") <= F.floor(F.col("n_ctx") * _value(share))) & F.col("l2").isNotNull()
    swapped = F.when(F.col("y") == F.col("l1"), F.col("l2")).when(F.col("y") == F.col("l2"), F.col("l1")).otherwise(F.col("y"))
    return _context_rank(df, seed, "mis").join(top, keys(df)).withColumn("y", F.when(chosen, swapped).otherwise(F.col("y"))).drop("hr", "n_ctx", "l1", "l2")


def mislabel_boundary(df: DataFrame, share: Value, seed: int, k: int = 4) -> DataFrame:
    """Another label for the floor(n * share) context rows whose ``k`` nearest neighbours disagree most."""
    from auditloom.operators.predict import neighbours

    ctx = df.where(_in(CONTEXT)).withColumn("_share", _value(share))
    near = neighbours(ctx, ctx, k, exclude_self=True).groupBy(*keys(df), "row_id").agg(F.avg(F.when(F.col("y") != F.col("ny"), 1.0).otherwise(0.0)).alias("disagree"), F.first("_share").alias("_share"))
    order = dataset(df).orderBy(F.desc("disagree"), "row_id")
    placed = near.withColumn("place", F.row_number().over(order)).withColumn("n_near", F.count("*").over(dataset(df)))
    chosen = F.col("place") <= F.floor(F.col("n_near") * F.col("_share"))
    joined = df.join(placed, [*keys(df), "row_id"], "left").join(labels(df), keys(df))
    return joined.withColumn("y", F.when(_in(CONTEXT) & chosen, other_label(seed, "to")).otherwise(F.col("y"))).drop("disagree", "_share", "place", "n_near", "ls")


def _dose(share: Value) -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("n") * _value(share)))


def _drawn(df: DataFrame, share: Value, seed: int, tag: str) -> DataFrame:
    """Context rows drawn with replacement: max(1, floor(n * share)) per dataset."""
    ctx = df.where(_in(CONTEXT)).withColumn("_share", _value(share))
    ranked = ctx.withColumn("_i", F.row_number().over(dataset(df).orderBy("row_id")) - 1)
    n = ctx.groupBy(*keys(df)).agg(F.count("*").alias("n"), F.first("_share").alias("_share"))
    draws = n.withColumn("d", F.explode(F.sequence(F.lit(1), _dose(F.col("_share")).cast("int")))).withColumn("_i", rng.whole(seed, tag, F.col("n"), "dataset_id", "d"))
    return draws.select(*keys(df), "d", "_i").join(ranked, [*keys(df), "_i"])


def row_duplication(df: DataFrame, share: Value, seed: int) -> DataFrame:
    """Drawn context rows once more; copies have ``copy`` from 1 on, originals 0."""
    copies = _drawn(df, share, seed, "dup").select(*columns(df), "y", F.col("d").cast("int").alias("copy"))
    return df.select(*columns(df), "y").withColumn("copy", F.lit(0)).unionByName(copies)


def truth_serum(df: DataFrame, share: Value, seed: int) -> DataFrame:
    """Like ``row_duplication``, each copy with another label."""
    copies = _drawn(df, share, seed, "serum").join(labels(df), keys(df)).withColumn("row_key", F.col("row_id"))
    rest = F.array_except("ls", F.array("y"))
    y = F.when(F.size(rest) == 0, F.col("y")).otherwise(F.get(rest, rng.whole(seed, "to", F.size(rest), "dataset_id", "d")))
    return df.select(*columns(df), "y").withColumn("copy", F.lit(0)).unionByName(copies.select(*columns(df), y.alias("y"), F.col("d").cast("int").alias("copy")))


def _leaked(df: DataFrame, share: Value, seed: int, tag: str, known_only: bool) -> DataFrame:
    n = df.where(_in(CONTEXT)).groupBy(*keys(df)).agg(F.count("*").alias("n"))
    rows = df.where(_in(QUERY)).withColumn("_share", _value(share))
    if known_only:
        rows = rows.join(df.where(_in(CONTEXT)).select(*keys(df), "y").distinct(), [*keys(df), "y"], "left_semi")
    order = dataset(df).orderBy(rng.order_key(seed, tag, "dataset_id", "row_id"), "row_id")
    return rows.withColumn("_r", F.row_number().over(order)).join(n, keys(df)).where(F.col("_r") <= _dose(F.col("_share"))).drop("_r", "n", "_share")


def query_leakage(df: DataFrame, share: Value, seed: int) -> DataFrame:
    """Query rows whose label the context knows, added to the context: the dose is a share of the context."""
    leaked = _leaked(df, share, seed, "leak", True).withColumn("role", F.lit(CONTEXT)).select(*columns(df), "y", F.lit(1).alias("copy"))
    return df.select(*columns(df), "y", F.lit(0).alias("copy")).unionByName(leaked)


def brainwash(df: DataFrame, share: Value, seed: int) -> DataFrame:
    """Query rows with another label, added to the context."""
    leaked = _leaked(df, share, seed, "wash", False).join(labels(df), keys(df)).withColumn("role", F.lit(CONTEXT)).select(*columns(df), other_label(seed, "to").alias("y"), F.lit(1).alias("copy"))
    return df.select(*columns(df), "y", F.lit(0).alias("copy")).unionByName(leaked)


def context_equals_query(df: DataFrame) -> DataFrame:
    ctx = df.where(_in(CONTEXT))
    return ctx.unionByName(ctx.withColumn("role", F.lit(QUERY)))
