"""Quantiles from mergeable sketches, kept by key and stretch of time, or exactly on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; ranks of its quantiles are off by at most ``rank_error`` (99 % sure), whatever is merged.
SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Largest error of a normalised rank of a sketch of this size."""
    return 2.296 / size**0.9021


def sketches(df: DataFrame, value: str, by: list[str], size: int = SIZE) -> DataFrame:
    """``by``, n and a sketch of the values of each group: partial aggregates of a few kilobytes, to be kept and merged.  Nulls don't count."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(x, F.lit(size)).alias("sketch"))


def merged(kept: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """Kept sketches of finer groups as one for each of ``by``: only sketches are shuffled."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def at(sketch: Column | str, share: float) -> Column:
    """The value at a share of the sketched values."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def exact(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """``by``, n and the exact quantiles q0, q1, ...: for groups whose distinct values fit a task."""
    x = F.col(value).cast("double")
    known = df.where(x.isNotNull() & ~F.isnan(x))
    return known.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile(x, F.lit(float(s))).alias(f"q{i}") for i, s in enumerate(shares)))


def rank_of(df: DataFrame, value: str, by: list[str], found: DataFrame, column: str) -> DataFrame:
    """``found`` with the shares of values below and up to its ``column``: where an estimate truly stands."""
    x = F.col(value).cast("double")
    known = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("own_value")).join(found.select(*by, column), by)
    shares = known.groupBy(*by).agg(F.avg((F.col("own_value") < F.col(column)).cast("double")).alias("below"), F.avg((F.col("own_value") <= F.col(column)).cast("double")).alias("upto"))
    return found.join(shares, by)
