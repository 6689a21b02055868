"""Expressions over probability and logit arrays, inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)


def entropy(p: Column, inside: bool = True) -> Column:
    """Shannon entropy; the small number is added within the log, or probabilities are clipped at it."""
    if inside:
        return F.aggregate(p, F.lit(0.0), lambda a, v: a - v * F.log(v + F.lit(EPS)))
    return F.aggregate(p, F.lit(0.0), lambda a, v: a - F.greatest(v, F.lit(EPS)) * F.log(F.greatest(v, F.lit(EPS))))


def margin(p: Column) -> Column:
    """Largest less second largest; null for fewer than two."""
    top = F.sort_array(p, asc=False)
    return F.get(top, F.lit(0)) - F.get(top, F.lit(1))


def argmax(p: Column) -> Column:
    """Index of the largest, the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def norm(xs: Column) -> Column:
    return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, v: a + v * v))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))


def kl(p: Column, q: Column) -> Column:
    """Sum of p ln((p + e) / (q + e)); null where the lengths differ."""
    parts = F.zip_with(p, q, lambda u, v: u * F.log((u + F.lit(EPS)) / (v + F.lit(EPS))))
    return F.when(F.size(p) == F.size(q), total(parts))


def softened(p: Column, temperature: float) -> Column:
    """softmax(log p / T), stabilised by the largest logit."""
    logs = F.transform(p, lambda v: F.log(F.greatest(v, F.lit(1e-30))) / F.lit(temperature))
    raised = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    return F.transform(raised, lambda v: v / total(raised))


def without(xs: Column, k: int) -> Column:
    return F.filter(xs, lambda v, i: i != k)


def project(xs: Column, kept: Column) -> Column:
    """Elements of ``xs`` at the 0-based indexes of ``kept``."""
    return F.transform(kept, lambda i: F.get(xs, i))
