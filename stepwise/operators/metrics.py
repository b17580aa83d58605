"""Evaluation metrics over rows: one item a row, one row of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.functions.geometry import contains, distance

# Fixed value: pixels within which a point counts as hit.
HIT_PX = 50.0


def top_k_accuracy(ranked: Column, gold: Column, k: int = 1) -> Column:
    return F.coalesce(F.avg(F.coalesce(F.array_contains(F.slice(ranked, 1, k), gold), F.lit(False)).cast("double")), F.lit(0.0))


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    place = F.coalesce(F.array_position(ranked, gold), F.lit(0))
    return F.when(place > 0, 1 / place).otherwise(0.0)


def mean_reciprocal_rank(ranked: Column, gold: Column) -> Column:
    return F.coalesce(F.avg(reciprocal_rank(ranked, gold)), F.lit(0.0))


def pairwise_accuracy(chosen: Column, rejected: Column) -> Column:
    return F.coalesce(F.avg((chosen > rejected).cast("double")), F.lit(0.0))


def coordinate_error(pred: Column, target: Column, screen: Column) -> Column:
    """Distance in pixels over the screen's diagonal."""
    return distance(pred, target) / F.sqrt(F.pow(screen["width"].cast("double"), F.lit(2)) + F.pow(screen["height"].cast("double"), F.lit(2)))


def distance_accuracy(pred: Column, target: Column, limit: float = HIT_PX) -> Column:
    return F.coalesce(F.avg((distance(pred, target) <= limit).cast("double")), F.lit(0.0))


def click_accuracy(pred: Column, box: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(contains(box, pred), F.lit(False)).cast("double")), F.lit(0.0))


def zipped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two sides joined by item; a row without its partner raises."""
    out = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full")
    checked = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "items differ between the sides")
    return out.where(checked.isNull()).drop("_l", "_r")
