"""Numeric expressions: decay, boosts, similarity, retrieval statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 30.0


def age_days(at: Column, as_of: Column) -> Column:
    """Days from ``at`` to ``as_of``, as a fraction."""
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    return seconds / 86400.0


def decay(age: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return F.when(age <= 0, 1.0).otherwise(F.exp(-math.log(2) * age / half_life))


def access_boost(count: Column) -> Column:
    """A step for every five accesses, up to 0.2."""
    return F.least(F.lit(0.2), F.floor(count / 5) * 0.05)


def effective_confidence(conf: Column, age: Column, count: Column) -> Column:
    return F.least(F.lit(0.95), conf * decay(age) + access_boost(count))


def recency(age: Column) -> Column:
    return 1 / (1 + F.sqrt(F.greatest(age, F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0 or the dimensions differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def capped(c: Column, most: float = 0.95) -> Column:
    return F.least(F.lit(most), c)


def call_chain_confidence(depth: Column) -> Column:
    return F.round(0.45 * F.pow(F.lit(0.7), depth - 1), 4)


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).otherwise(0.0)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / whole, digits))
