"""Score expressions: similarity, decay, hybrid and fusion weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0
# Decay rates a day by importance, bounds and weights of the scoring rules.
SLOW, MEDIUM, FAST = 0.005, 0.025, 0.10
RECENCY_FLOOR = 0.01
RRF_K, RRF_SCALE = 60.0, 10.0


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def boosted(importance: Column, tier: Column) -> Column:
    return F.least(F.lit(1.0), importance + F.when(tier == "critical", 0.2).when(tier == "personal", 0.1).otherwise(0.0))


def recency(importance: Column, age_seconds: Column) -> Column:
    rate = F.when(importance >= 0.8, SLOW).when(importance >= 0.5, MEDIUM).otherwise(FAST)
    return clamp(F.exp(-rate * age_seconds / DAY), RECENCY_FLOOR)


def memory_score(similarity: Column, recent: Column, importance: Column, emotion: Column) -> Column:
    return 0.60 * similarity + 0.20 * recent + 0.15 * importance + 0.05 * emotion


def lore_score(similarity: Column, keyword: Column, heading: Column, entity_hit: Column) -> Column:
    return 0.80 * similarity + 0.10 * keyword + 0.10 * (0.5 * heading + 0.5 * entity_hit)


def rrf_term(rank: Column, score: Column) -> Column:
    return RRF_SCALE / (RRF_K + rank) + score


def decay_to_baseline(value: Column, baseline: Column, seconds: Column, half_life: float) -> Column:
    return F.round(baseline + (value - baseline) * F.exp(-seconds * F.lit(0.6931471805599453 / half_life)), 4)
