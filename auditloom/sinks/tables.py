"""Report tables of audit results: which cells they show, and how they read in Markdown and LaTeX."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERNAL = "pool string, scope string, kind string, K int, target double, target_sd double, blind double, blind_sd double, gap double, gap_sd double, p_gap_le_0 double"
EXTERNAL = "pool string, arm string, scheme string, n_cols int, target_cov double, blind_cov double, target_auc double, target_auc_sd double, blind_auc double, blind_auc_sd double, gap double, gap_sd double, n_selected double, draws int"
SCHEMES = ("noscreen", "screen")


def _fields(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _number(value):
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else value


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    kinds = dict(f.split() for f in schema.split(", "))
    return spark.createDataFrame([tuple(_number(r.get(n)) if k == "double" else r.get(n) for n, k in kinds.items()) for r in rows], schema)


def _parsed(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, object]]:
    """Top-level entries of some result files, by pool; each file is one small document."""
    texts = spark.read.option("wholetext", True).text(list(paths)).collect()
    return [entry for t in texts for entry in json.loads(t["value"]).items()]


def internal_cells(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per pool, scope and classifier of internal result files."""
    rows = []
    for pool, result in _parsed(spark, paths):
        for scope, cell in result["cells"].items():
            rows += [{"pool": pool, "scope": scope, "kind": kind, **values} for kind, values in cell.items() if isinstance(values, dict)]
    return _rows(spark, rows, INTERNAL)


def external_cells(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per pool, arm and scheme of external result files; a scheme without draws has nulls."""
    rows = []
    for pool, arms in _parsed(spark, paths):
        rows += [{**arm, "pool": pool, "scheme": s, **(arm.get(s) or {})} for arm in arms for s in SCHEMES]
    return _rows(spark, rows, EXTERNAL)


def picked(cells: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """The cell of each row of ``wanted`` (``place, label`` and the columns ``on``), in its order; nulls where there is none."""
    return wanted.join(cells, list(on), "left").orderBy("place")


def audit_json(internal: DataFrame, meta: dict) -> DataFrame:
    """One ``value``: internal results (``pool, scope, kind`` and numbers; few rows) as nested JSON, for ``write.text``."""
    out: dict = {}
    for r in internal.orderBy("pool", "scope", "kind").collect():
        head = out.setdefault(r["pool"], {"meta": meta | {"pool": r["pool"]}, "cells": {}})
        head["cells"].setdefault(r["scope"], {})[r["kind"]] = {k: v for k, v in r.asDict().items() if k not in ("pool", "scope", "kind")}
    return internal.sparkSession.createDataFrame([(json.dumps(out),)], "value string")


@dataclass(frozen=True)
class Style:
    """How numbers, missing cells and rows read in a format."""

    dash: str
    minus: str
    plus: str
    spread: str
    cell: str
    end: str

    def number(self, v: float | None, sd: float | None, signed: bool = False) -> str:
        if v is None:
            return self.dash
        return (self.minus if v < 0 else self.plus if signed else "") + f"{abs(v):.3f}" + ("" if sd is None else f" {self.spread} {sd:.3f}")

    def row(self, values: Sequence[str]) -> str:
        return ("| " if self.cell == " | " else "") + self.cell.join(values) + self.end


MARKDOWN = Style("—", "-", "+", "±", " | ", " |")
LATEX = Style("---", "$-$", "$+$", r"$\pm$", " & ", r" \\")


def rendered(rows: DataFrame, heads: Sequence[str], texts: Sequence[str], numbers: Sequence[tuple[str, str, bool]], latex: bool = False) -> str:
    """Few rows as a table: columns of text, then numbers (``value, deviation, signed``); missing ones are dashes."""
    style = LATEX if latex else MARKDOWN
    lines = [style.row([*(style.dash if r[t] is None else str(r[t]) for t in texts), *(style.number(r[v], r[sd], signed) for v, sd, signed in numbers)]) for r in rows.collect()]
    if not latex:
        return "\n".join([style.row(heads), "|" + "---|" * len(heads), *lines])
    return "\n".join([r"\begin{tabular}{" + "l" * len(heads) + "}", r"\toprule", style.row(heads) + r" \midrule", *lines, r"\bottomrule", r"\end{tabular}"])


def internal_table(rows: DataFrame, latex: bool = False) -> str:
    """Model, classifier, K*, target, blind and excess with their deviations."""
    return rendered(rows, ("Target", "Classifier", "K*", "Target AUC", "Blind AUC", "Excess"), ("label", "kind", "K"), (("target", "target_sd", False), ("blind", "blind_sd", False), ("gap", "gap_sd", True)), latex)


def external_table(rows: DataFrame, latex: bool = False) -> str:
    return rendered(rows, ("Target", "Target AUC", "Blind AUC", "Excess"), ("label",), (("target_auc", "target_auc_sd", False), ("blind_auc", "blind_auc_sd", False), ("gap", "gap_sd", True)), latex)


def contribution_table(ranks: DataFrame, n: int = 10, latex: bool = False) -> str:
    """The first ``n`` signals by what they mean to the target, with report names and codes."""
    from auditloom.operators import signals

    named = ranks.where(F.col("target_rank") <= n).orderBy("target_rank").withColumn("d", signals.described("signal"))
    flat = named.select(F.coalesce("d.feature", "signal").alias("feature"), "d.manipulation", "d.measurement", "d.reduction", *[F.format_string("%.4f", c).alias(c) for c in ("target_importance", "blind_importance")])
    shown = flat.withColumn("feature", F.replace("feature", F.lit("_"), F.lit(r"\_"))) if latex else flat
    return rendered(shown, ("Feature", "Manipulation", "Signal", "Reduction", "Target", "Blind"), shown.columns, (), latex)


def bars(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``side, auc, sd`` in long form: target and blind bars next to each other."""
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_auc").alias("auc"), F.col(f"{s}_auc_sd").alias("sd")) for s in ("target", "blind")])).alias("b")
    return cells.select(*keys, side).select(*keys, "b.*")
