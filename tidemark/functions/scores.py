"""Votes, confidence and status labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
DISTANCE_LIMIT = 3.0
ENTROPY_LIMIT = 4.0
Z_LIMIT = 2.5
COLD_START_RECORDS = 3
DISTANCE_CAP = 50.0
DISTANCE_WEIGHT = 0.1
ENTROPY_WEIGHT = 0.05
Z_WEIGHT = 0.2
COLD_CONFIDENCE = 0.5
ALERT_CONFIDENCE = 0.8
WARN_FROM = 2.0
CRITICAL_FROM = 3.0


def is_ood(distance: Column, limit: float = DISTANCE_LIMIT) -> Column:
    return distance > limit


def is_stable(entropy: Column, limit: float = ENTROPY_LIMIT) -> Column:
    return entropy <= limit


def is_z_anomalous(z_score: Column, limit: float = Z_LIMIT) -> Column:
    return F.abs(z_score) > limit


def anomaly_vote(*votes: Column, needed: int = 2) -> Column:
    """True when at least ``needed`` of the votes are true; NULL counts as no."""
    count = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(False)).cast("int") for v in votes])
    return count >= needed


def confidence(distance: Column, entropy: Column, z_score: Column) -> Column:
    capped = F.least(distance, F.lit(DISTANCE_CAP))
    return 1.0 / (
        1.0 + DISTANCE_WEIGHT * capped + ENTROPY_WEIGHT * entropy + Z_WEIGHT * F.abs(z_score)
    )


def metric_status(value: Column) -> Column:
    return (
        F.when(value < WARN_FROM, "OK").when(value < CRITICAL_FROM, "WARN").otherwise("CRIT")
    )
