"""Interval joins: points within spans, and spans that overlap, key by key.

Spans are dealt by length to levels of bins, each four times as wide as the one before and
at least as wide as its spans, so that a span lies in two bins at most, however long
it is; a point lies in one bin of every level in use (a dozen at most for spans of a second
to a year).  Points and spans meet by (key, level, bin), an equi-join that Spark can split
where it is skewed, and every pair is checked exactly.  The width of the first level comes
from a quantile sketch of the spans' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import as_number

col = F.col
#: Bins of a level are so many times as wide as those of the one below.
STEP = 4


def _level(length: Column, width: float) -> Column:
    """The first level whose bins are at least as wide as the span."""
    wide = F.ceil(F.log(F.greatest(length / F.lit(width), F.lit(1.0))) / F.log(F.lit(float(STEP)))).cast("int")
    # logarithms may round down: one level up is always right
    return F.when(F.lit(width) * F.pow(F.lit(float(STEP)), wide) < length, wide + 1).otherwise(wide)


def _bin(at: Column, level: Column, width: float) -> Column:
    return F.floor(at / (F.lit(width) * F.pow(F.lit(float(STEP)), level)))


def interval_join(points: DataFrame, spans: DataFrame, *, by: list[str], at: str, start: str, end: str, closed: str = "both", width: float | None = None) -> DataFrame:
    """All columns of both for every point and span of one key with the point inside; ``by`` columns once.

    ``closed``: both, left, right or neither, which ends count.  Other columns must differ
    in name.  ``width`` of the first level: by default a quarter of the spans' lengths is
    below it.  Null keys, null times and spans that end before they start match nothing;
    repeated rows match as often as they occur.
    """
    low, high = as_number(spans, start), as_number(spans, end)
    known = spans.where(" and ".join(f"`{c}` is not null" for c in by)).where((high >= low) & low.isNotNull())
    if width is None:
        width = known.agg(F.percentile_approx((high - low).cast("double"), 0.25, 1000)).first()[0]
    width = float(width or 1)
    level = _level((high - low).cast("double"), width)
    dealt = known.withColumn("bin_level", level).withColumns({"bin_low": _bin(low, col("bin_level"), width), "bin_high": _bin(high, col("bin_level"), width)})
    levels = sorted(r[0] for r in dealt.select("bin_level").distinct().collect())  # 40 at most: lengths are 64-bit numbers
    dealt = dealt.withColumn("bin", F.explode(F.sequence("bin_low", "bin_high"))).drop("bin_low", "bin_high")
    here = as_number(points, at)
    levelled = points.where(here.isNotNull()).withColumn("bin_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bin", _bin(here, col("bin_level"), width))
    pairs = levelled.join(dealt, [*by, "bin_level", "bin"])
    p, a, b = (as_number(pairs, c) for c in (at, start, end))
    inside = ((p >= a) if closed in ("both", "left") else (p > a)) & ((p <= b) if closed in ("both", "right") else (p < b))
    return pairs.where(inside).drop("bin_level", "bin")


def overlap_join(left: DataFrame, right: DataFrame, *, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Every pair of closed spans of one key that share a point: one of them starts within the other."""
    names = [*by, *(c for c in left.columns if c not in by), *(c for c in right.columns if c not in by)]
    sound = lambda df, span: df.where(as_number(df, span[0]) <= as_number(df, span[1]))
    one = interval_join(sound(left, left_span), right, by=by, at=left_span[0], start=right_span[0], end=right_span[1])
    # equal starts are found by the first
    two = interval_join(sound(right, right_span), left, by=by, at=right_span[0], start=left_span[0], end=left_span[1], closed="right")
    return one.select(*names).unionByName(two.select(*names))
