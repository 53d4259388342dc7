"""Data-driven styles: numeric and discrete mappings, and rules of which the last that matches wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear(value: Column, low: float, high: float, at_low: float, at_high: float) -> Column:
    """A value's place in [low, high] carried over to [at_low, at_high], clamped; null and NaN give null."""
    if not high > low:
        raise ValueError("a range has a positive length")
    t = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.when(value.isNotNull() & ~F.isnan(value), at_low + t * (at_high - at_low))


def colour(value: Column, low: float, high: float, first: tuple[int, int, int], last: tuple[int, int, int]) -> Column:
    """A colour between two as #rrggbb."""
    parts = [F.lower(F.lpad(F.hex(F.round(linear(value, low, high, float(a), float(b))).cast("long")), 2, "0")) for a, b in zip(first, last, strict=True)]
    return F.concat(F.lit("#"), *parts)


def folded(base: Column, *rules: tuple[Column, Column]) -> Column:
    """The value of the last rule (condition, value) that matches with a value, or the base."""
    return F.coalesce(*(F.when(condition, value) for condition, value in reversed(rules)), base)


def palette_slot(df: DataFrame, column: str, colours: int, name: str = "slot") -> DataFrame:
    """A discrete mapping: distinct values in order take the palette's slots in turn. Only the distinct values are ranked."""
    values = df.select(column).distinct()
    ranked = values.withColumn(name, F.pmod(F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1, F.lit(colours)))
    return df.join(ranked, column)
