"""Column functions of the scoring kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BANDS, HIGH_FROM, MEDIUM_FROM

DAY = 86400.0


def decay(latest: Column, time: Column, half_life_days: float) -> Column:
    """Halves with every half-life of age; 1 for ages below zero and for a half-life that is not finite and positive."""
    if not (math.isfinite(half_life_days) and half_life_days > 0):
        return F.lit(1.0)
    return F.exp(F.greatest(latest - time, F.lit(0)) * F.lit(-math.log(2)) / F.lit(DAY) / F.lit(float(half_life_days)))


def pair_weight(weight: Column, n_files: Column) -> Column:
    return weight / F.log2(n_files + 1)


def normalised_score(weight: Column, a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), weight / F.sqrt(a * b)).otherwise(weight)


def confidence(strongest: Column) -> Column:
    return F.when(strongest >= HIGH_FROM, "high").when(strongest >= MEDIUM_FROM, "medium").otherwise("low")


def band_rank(band: Column) -> Column:
    """0 low, 1 medium, 2 high."""
    return F.when(band == BANDS[2], 2).when(band == BANDS[1], 1).otherwise(0)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, 0.0).otherwise(numerator / denominator)
