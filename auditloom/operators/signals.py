"""Names, families and scopes of signals; long and wide tables; alignment and upserts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.operators.prep import clean
from auditloom.plans import sweeps

#: Family prefixes in the order in which they are tried, columns that are no
#: signals, and names and codes of manipulations, measurements and reductions in reports.
FAMILIES = ("ctxeqq", "nnsplit", "lperm", "ftx", "rowshuf", "tshuffle", "tabdpt_sim", "tserum", "bwash", "mislbl", "qleak", "rowdup", "ctx", "noise", "col", "splitsize", "temp", "base")
META = ("true_label", "is_member", "member", "dataset_id", "dataset_name", "success", "task_type", "grid_version", "iid_split", "did", "n_pool", "n_features", "n_classes", "n_str_cols", "n", "d", "C", "elapsed_s", "dataset_id_str", "label", "y", "target")
MANIPULATION_NAMES = (
    ("base", "Default", "M1"),
    ("splitsize", "SplitFraction", "M1"),
    ("ctxeqq", "QueryEqualsContext", "M2"),
    ("ctx", "RowSampling", "M4"),
    ("rowshuf", "RowShuffle", "M5"),
    ("col", "FeatureSample", "M6"),
    ("noise", "FeatureNoise", "M8"),
    ("ftx", "FeatureTransform", "M9"),
    ("tshuffle", "TaskSwap", "M10"),
    ("lperm", "ClassPermutation", "M11"),
    ("mislbl", "LabelCorruption", "M12"),
    ("rowdup", "RowDuplication", "M14"),
    ("tserum", "TruthSerum", "M15"),
    ("qleak", "QueryLeak", "M16"),
    ("bwash", "Brainwash", "M17"),
    ("nnsplit", "NN", "M18"),
    ("tabdpt_sim", "Retrieval", "M19"),
    ("temp", "Temperature", "M20"),
)
MEASUREMENT_NAMES = (
    ("correct_confidence", "Confidence", "S1"),
    ("max_confidence", "MaxConfidence", "S2"),
    ("prediction_margin", "Margin", "S3"),
    ("accuracy", "Accuracy", "S4"),
    ("loss", "CELoss", "S5"),
    ("chi_squared", "ChiSquared", "S10"),
    ("entropy", "Entropy", "S11"),
    ("kl_divergence", "KLD", "S12"),
    ("kl2clean", "KLDClean", "S12"),
    ("rkl2clean", "ReverseKLD", "S13"),
    ("wasserstein", "Wasserstein", "S14"),
)
REDUCTION_NAMES = (
    ("", "Default", "R1"),
    ("slope", "Slope", "R2"),
    ("auc", "AUC", "R3"),
    ("gain", "Gain", "R4"),
    ("early", "Early", "R5"),
    ("late_gain", "LateGain", "R6"),
    ("mean", "Mean", "R7"),
    ("std", "Std", "R8"),
    ("range", "Range", "R9"),
)


def family(signal: str | Column) -> Column:
    """The first listed prefix that the name begins with, else the text before the first underscore."""
    c = F.col(signal) if isinstance(signal, str) else signal
    first = F.regexp_extract(c, "^(" + "|".join(FAMILIES) + ")(_|$)", 1)
    return F.when(first != "", first).otherwise(F.split(c, "_")[0])


def denied(signal: str | Column) -> Column:
    c = F.col(signal) if isinstance(signal, str) else signal
    out = c.isin(*sweeps.DENIED)
    for p in sweeps.DENIED_PREFIXES:
        out = out | c.startswith(p)
    return out


_SCOPE = re.compile(r"ALL|(?P<no>no:)?(?P<families>.+)", re.S)


def in_scope(scope: str, family_col: str = "family") -> Column:
    """``ALL``, ``a+b`` (these families) or ``no:a+b`` (all but these)."""
    parsed = _SCOPE.fullmatch(scope)
    listed = (parsed["families"] or "").split("+")
    return F.col(family_col).isin(listed) == F.lit(bool(parsed["families"]) and not parsed["no"])


def arms(signals: DataFrame, least: int = 2) -> DataFrame:
    """``arm, n_cols``: ALL, then each family of at least ``least`` signals."""
    per = signals.groupBy(F.col("family").alias("arm")).agg(F.count("*").alias("n_cols")).where(F.col("n_cols") >= least)
    return signals.agg(F.count("*").alias("n_cols")).select(F.lit("ALL").alias("arm"), "n_cols").unionByName(per)


_REDUCTION = "_(" + "|".join(sorted({*sweeps.TRAJECTORY_REDUCTIONS, *sweeps.AGGREGATE_REDUCTIONS}, key=lambda s: (-len(s), s))) + ")$"


def codes(signal: str | Column) -> Column:
    """(sweep, measurement, reduction) of a name: the longest reduction at its end counts."""
    c = F.col(signal) if isinstance(signal, str) else signal
    fam, body = family(c), F.regexp_replace(c, _REDUCTION, "")
    return F.struct(fam.alias("sweep"), F.regexp_replace(F.substr(body, F.length(fam) + 1), "^_(random_)?", "").alias("measurement"), F.regexp_extract(c, _REDUCTION, 1).alias("reduction"))


def described(signal: str | Column) -> Column:
    """Report name ``Manipulation_Measurement_Reduction`` and the three codes; null for an unknown part."""
    c = codes(signal)
    parts = {n: _named(table, c[field]) for n, table, field in (("manipulation", MANIPULATION_NAMES, "sweep"), ("measurement", MEASUREMENT_NAMES, "measurement"), ("reduction", REDUCTION_NAMES, "reduction"))}
    name = F.concat(*[x for p in parts.values() for x in (p["label"], F.lit("_"))][:-1])
    return F.struct(name.alias("feature"), *[p["code"].alias(n) for n, p in parts.items()])


def _named(table: Sequence[tuple[str, str, str]], key: Column) -> Column:
    known = F.create_map(*[x for name, label, code in table for x in (F.lit(name), F.struct(F.lit(label).alias("label"), F.lit(code).alias("code")))])
    return F.try_element_at(known, key)


def signal_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither booleans nor metadata nor denied, in order of name."""
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in META and not sweeps.denied(f.name))


def wide(long: DataFrame, names: Sequence[str], keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """One row per dataset and one column per listed signal."""
    return long.groupBy(*keys).pivot("signal", list(names)).agg(F.first("value"))


def long(table: DataFrame, names: Sequence[str], keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("signal"), clean(n).alias("value")) for n in names])
    return table.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


class Misaligned(ValueError):
    """Target and blind tables do not describe the same datasets."""


def align(target: DataFrame, blind: DataFrame, label: str = "label") -> DataFrame:
    """``dataset_id, y, signal, family, xt, xb`` of successful rows; a dataset that the blind
    table lacks, or labels that differ, are errors."""
    names = sorted(set(signal_columns(target)) & set(signal_columns(blind)))
    ok = lambda df: df.where(F.col("success")) if "success" in df.columns else df
    t, b = ok(target), ok(blind)
    lost = t.join(b, "dataset_id", "left_anti").limit(1).count()
    clash = t.alias("t").join(b.alias("b"), "dataset_id").where(F.col(f"t.{label}") != F.col(f"b.{label}")).limit(1).count()
    if lost or clash:
        raise Misaligned("the blind table lacks a dataset" if lost else "labels differ")
    left = long(t, names, ("dataset_id", label)).withColumnRenamed("value", "xt").withColumnRenamed(label, "y")
    right = long(b, names).withColumnRenamed("value", "xb")
    return left.join(right, ["dataset_id", "signal"]).withColumn("family", family("signal"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Rows of ``existing`` that ``new`` does not replace, and all of ``new``; columns by name, missing ones null.

    Raises ValueError where either table repeats a key.
    """
    for name, rows in (("existing", existing), ("new", new)):
        if rows.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} repeats among the {name} rows")
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def last_wins(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which the row of a key that comes in the latest part stays."""
    tagged = union_by_name([p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    order = Window.partitionBy(key).orderBy(F.desc("_part"))
    return tagged.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_part", "_r")


def compared(ours: DataFrame, reference: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``same`` for every key of either table, null-safe."""
    a, b = ours.select(*keys, F.col(value).alias("ours")), reference.select(*keys, F.col(value).alias("reference"))
    return a.join(b, list(keys), "full_outer").withColumn("same", F.col("ours").eqNullSafe(F.col("reference")))
