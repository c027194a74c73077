"""Vector arithmetic as column expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_double(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: str | Column) -> Column:
    """v / max(norm, EPS): a zero vector stays zero, so its similarity to all is 0."""
    length = F.greatest(norm(v), F.lit(EPS))
    return F.transform(as_double(v), lambda x: x / length)


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def euclidean_distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _bounded(value: Column, low: float, high: float, what: str, score: Column) -> Column:
    ok = value.between(low - 1e-6, high + 1e-6)
    return F.when(ok, score).when(value.isNull(), None).otherwise(F.raise_error(F.concat(F.lit(f"{what} out of range: "), value.cast("string"))))


def score_from_similarity(s: Column) -> Column:
    """-1, 0, 1 to 0, 50, 100; an error beyond the range by more than 1e-6."""
    return _bounded(s, -1, 1, "cosine similarity", (F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0)) + 1) * 50)


def score_from_distance(d: Column) -> Column:
    """Cosine distance, or Euclidean distance of unit vectors: 0 to 100, 2 to 0."""
    return _bounded(d, 0, 2, "distance", (1 - F.least(F.greatest(d, F.lit(0.0)), F.lit(2.0)) / 2) * 100)


def contrastive_loss(distance: Column, is_negative: Column, margin: float = 1.0) -> Column:
    """(1 - y) d^2 + y max(m - d, 0)^2, where y = 1 marks a negative pair."""
    short = F.greatest(F.lit(margin) - distance, F.lit(0.0))
    return (1 - is_negative) * distance * distance + is_negative * short * short


def cross_entropy(logits: str | Column, label: Column) -> Column:
    """log(sum(exp)) - logit of the label, shifted by the largest logit; labels count from 0."""
    x = as_double(logits)
    top = F.array_max(x)
    return F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))) + top - F.element_at(x, label.cast("int") + 1)


def argmax(logits: str | Column) -> Column:
    x = as_double(logits)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def annealed_rate(rate: float, epoch: Column, epochs: int | Column) -> Column:
    """Cosine annealing to 0."""
    return rate * (1 + F.cos(F.lit(3.141592653589793) * epoch / epochs)) / 2


def is_finite(v: str | Column) -> Column:
    return F.forall(as_double(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def stats(v: str | Column) -> Column:
    """low, high, mean and std of a vector's finite values, and whether it has a NaN or an infinite value."""
    x = as_double(v)
    fine = F.filter(x, lambda a: ~F.isnan(a) & (F.abs(a) < float("inf")))
    mean = F.aggregate(fine, F.lit(0.0), lambda s, a: s + a) / F.nullif(F.size(fine), F.lit(0))
    spread = F.sqrt(F.aggregate(fine, F.lit(0.0), lambda s, a: s + (a - mean) * (a - mean)) / F.nullif(F.size(fine), F.lit(0)))
    return F.struct(F.array_min(fine).alias("low"), F.array_max(fine).alias("high"), mean.alias("mean"), spread.alias("std"), F.exists(x, lambda a: F.isnan(a)).alias("has_nan"), F.exists(x, lambda a: ~F.isnan(a) & (F.abs(a) == float("inf"))).alias("has_inf"))
