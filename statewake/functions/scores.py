"""Risk arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: thresholds of the 1..5 ratings
THRESHOLDS = {"branching": (0, 1, 2, 4, 6), "fan": (0, 2, 4, 7, 11), "unverifiable": (0, 1, 1, 2, 2), "complexity": (0, 5, 11, 21, 51), "size": (0, 20, 50, 100, 200), "repairs": (0, 1, 2, 4, 8)}


def exposure(probability: Column, impact: Column) -> Column:
    """P x I of whole numbers 1..5; null is refused input."""
    return F.when(probability.between(1, 5) & impact.between(1, 5), probability * impact)


def band(score: Column) -> Column:
    return F.when(score.isNull(), "refused").when(score <= 5, "Low").when(score <= 11, "Medium").when(score <= 19, "High").otherwise("Very High")


def rating(value: Column, kind: str) -> Column:
    """How many thresholds a count reaches, 1..5."""
    reached = sum((F.when(value >= t, 1).otherwise(0) for t in THRESHOLDS[kind][1:]), F.lit(1))
    return reached.cast("int")


def pert(o: Column, m: Column, p: Column) -> Column:
    return F.round((o + 4 * m + p) / 6, 4)


def pert_sigma(o: Column, p: Column) -> Column:
    return F.round((p - o) / 6, 4)


def content_id(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def resource_of(route: Column) -> Column:
    """The route up to its first path parameter."""
    cut = F.regexp_replace(F.regexp_replace(route, r"/\{.*$", ""), "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)
