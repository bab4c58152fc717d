"""Arithmetic of names, pairs and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, places: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n on doubles."""
    k = float(10**places)
    return F.floor(c * k + 0.5) / k


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def name_key(c: Column) -> Column:
    """Words of a folded name, single-spaced."""
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def char_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty names are not alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - w)."""
    return 1 - F.aggregate(weights, F.lit(1.0), lambda p, w: p * (1 - w))


def contactability(phones: Column, mobiles: Column, sources: Column, days: Column) -> Column:
    """0 to 100 of phones, mobiles, corroborating sources and recency; without a phone 29 at most."""
    parts = (
        F.when(phones > 0, 44.0).otherwise(0.0) + 7.0 * F.least(F.greatest(phones - 1, F.lit(0)), F.lit(2)) + F.when(mobiles > 0, 5.0).otherwise(0.0)
        + 7.0 * clamp((sources - 1) / 2.0) + 4.0 * clamp((365.0 - days) / 335.0)
    )
    return half_up(F.when(phones > 0, F.least(parts, F.lit(100.0))).otherwise(F.least(parts, F.lit(29.0)))).cast("int")
