"""Trend lines through recent pivots, bar by bar, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import ordered

#: Bars each side that a pivot must dominate; bars of the look-back; pivots of a line; fit it needs.
SIDE, LOOKBACK, PIVOTS, LEAST_R2 = 3, 60, (3, 5), 0.5


def pivot(x: str, side: int, lowest: bool) -> Column:
    """Whether a bar's value is the extreme of the full centred frame; ties count, edges don't."""
    frame = ordered().rowsBetween(-side, side)
    extreme = F.min(x) if lowest else F.max(x)
    return (F.count(x).over(frame) == 2 * side + 1) & (F.col(x) == extreme.over(frame))


def fit(points: Column) -> Column:
    """struct<slope, intercept, r2> by least squares of array<struct<x, y>>; a level line fits its points with an r2 of 1.

    Means and deviations are updated point by point, from the last to the first, as SQL's
    aggregates do: an r2 at the limit falls on the same side, and equal values deviate by exactly 0.
    """
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "mx", "my", "xx", "xy", "yy")))

    def add(s, p):
        n, dx, dy = s["n"] + 1, p["x"] - s["mx"], p["y"] - s["my"]
        mx, my = s["mx"] + dx / n, s["my"] + dy / n
        return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), (s["xx"] + (p["x"] - mx) * dx).alias("xx"), (s["xy"] + dx * (p["y"] - my)).alias("xy"), (s["yy"] + (p["y"] - my) * dy).alias("yy"))

    def solve(s):
        slope = (s["xy"] / s["n"]) / F.nullif(s["xx"] / s["n"], F.lit(0.0))
        r = (s["xy"] / s["n"]) / F.nullif(F.sqrt(s["xx"] / s["n"]) * F.sqrt(s["yy"] / s["n"]), F.lit(0.0))
        r2 = F.when((s["yy"] == 0) & (s["xx"] > 0), 1.0).otherwise(r * r)
        return F.struct(slope.alias("slope"), (s["my"] - slope * s["mx"]).alias("intercept"), r2.alias("r2"))

    return F.aggregate(F.reverse(points), zero, add, solve)


def with_trendlines(df: DataFrame) -> DataFrame:
    """Add ``up_line`` (through pivot lows) and ``down_line`` (through pivot highs).

    A bar sees the last three to five pivots of the 60 bars before it, each with its
    full frame in that span; a line needs r2 above 0.5.  Each is a struct of slope,
    intercept, r2 and ``value``, the line one bar ahead; NULL where there is none.
    Computed once for all signals.
    """
    frame = ordered().rowsBetween(-(LOOKBACK - SIDE), -SIDE)
    for name, x, lowest in (("up_line", "low", True), ("down_line", "high", False)):
        df = df.withColumn("pivot", F.when(pivot(x, SIDE, lowest), F.struct(F.col("rn").cast("double").alias("x"), F.col(x).cast("double").alias("y"))))
        df = df.withColumn("seen", F.collect_list("pivot").over(frame))
        few = F.slice("seen", F.greatest(F.size("seen") - (PIVOTS[1] - 1), F.lit(1)), PIVOTS[1])
        df = df.withColumn("seen", F.transform(few, lambda p: F.struct((p["x"] - (F.col("rn") - LOOKBACK) - 1).alias("x"), p["y"].alias("y"))))
        df = df.withColumn("line", F.when((F.col("rn") >= LOOKBACK) & (F.size("seen") >= PIVOTS[0]), fit(F.col("seen"))))
        value = F.col("line.slope") * LOOKBACK + F.col("line.intercept")
        df = df.withColumn(name, F.when(F.col("line.r2") > LEAST_R2, F.struct("line.slope", "line.intercept", "line.r2", value.alias("value"))))
    return df.drop("pivot", "seen", "line")
