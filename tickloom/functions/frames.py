"""Window frames and guarded arithmetic over keyed, ordered bars.

Every frame is keyed by ``ticker`` and ordered by the 0-based bar number ``rn``, so
a chain of operators needs one shuffle.  Missing values are NULL throughout: no
function here makes NaN, and division by zero gives NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



#: Bars of a block of the recursive average; powers within a block stay in range.
EMA_BLOCK = 2048


def ordered():
    """A ticker's bars in order."""
    return Window.partitionBy("ticker").orderBy("rn")


def whole():
    """All bars of a ticker."""
    return Window.partitionBy("ticker")


def running():
    """A ticker's bars up to the current one."""
    return ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)



def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows(n: int):
    """The trailing frame of n bars."""
    return ordered().rowsBetween(-(n - 1), 0)


def div(a, b) -> Column:
    """a / b; NULL where b is 0."""
    return c(a) / F.nullif(c(b), F.lit(0.0))


def gated(value: Column, x, n: int, least: int) -> Column:
    """``value`` where at least ``least`` of the last n bars have an x."""
    return F.when(F.count(c(x)).over(rows(n)) >= least, value)


def mean(x, n: int, least: int = 1) -> Column:
    out = F.avg(c(x)).over(rows(n))
    return out if least == 1 else gated(out, x, n, least)


def std(x, n: int, least: int) -> Column:
    """Sample standard deviation of the trailing frame."""
    return gated(F.stddev_samp(c(x)).over(rows(n)), x, n, least)


def low(x, n: int) -> Column:
    return F.min(c(x)).over(rows(n))


def high(x, n: int) -> Column:
    return F.max(c(x)).over(rows(n))


def lag(x, n: int = 1) -> Column:
    return F.lag(c(x), n).over(ordered())


def change(x, n: int = 1) -> Column:
    return div(c(x), lag(x, n)) - 1


def true(cond: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column, value: int = 1) -> Column:
    return F.when(cond, value).otherwise(0)


def first_match(*cases: tuple[Column, object], default) -> Column:
    """The value of the first case that holds."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def slope(x, n: int, least: int) -> Column:
    """Least-squares slope over the bar number, by the mean of the frame."""
    return gated(div(F.regr_slope(c(x), F.col("rn")).over(rows(n)), F.avg(c(x)).over(rows(n))), x, n, least)


def rank_pct(x, n: int, least: int) -> Column:
    """Average-tie percentile rank of the current value among the non-null values of the frame."""
    values = F.collect_list(c(x)).over(rows(n))
    below, equal = F.size(F.filter(values, lambda v: v < c(x))), F.size(F.filter(values, lambda v: v == c(x)))
    return gated(F.when(c(x).isNotNull(), (below + (equal + 1) / 2) / F.size(values)), x, n, least)


def with_ema(df: DataFrame, **spans: tuple[str, int]) -> DataFrame:
    """Add recursive averages y = a x + (1 - a) y, a = 2 / (span + 1), starting at the first bar.

    Closed form: a cumulative sum of x q^-i inside blocks of EMA_BLOCK bars, so the
    powers can't overflow, plus what the last bar of the earlier blocks still weighs.
    """
    block = Window.partitionBy("ticker", "ema_block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    earlier = ordered().rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("ema_block", F.floor(F.col("rn") / EMA_BLOCK)).withColumn("ema_at", F.col("rn") % EMA_BLOCK)
    parts, depth = {}, {}
    for name, (x, span) in spans.items():
        q = 1 - 2 / (span + 1)
        weight = F.when(F.col("rn") == 0, 1.0).otherwise(2 / (span + 1))
        parts[name] = F.pow(F.lit(q), F.col("ema_at")) * F.sum(weight * c(x) * F.pow(F.lit(q), -F.col("ema_at"))).over(block)
        depth[name] = math.ceil(41 / (-math.log(q) * EMA_BLOCK))
    out = out.withColumns(parts)
    ends = F.col("ema_at") == EMA_BLOCK - 1
    for level in range(1, max(depth.values()) + 1):
        names = [n for n in spans if depth[n] >= level]
        previous = lambda n, k: n if k == 1 else f"{n}_carry{k - 1}"
        out = out.withColumns({f"{n}_carry{level}": F.last(F.when(ends, F.col(previous(n, level))), True).over(earlier) for n in names})
    full = {}
    for name, (_, span) in spans.items():
        q = 1 - 2 / (span + 1)
        total = F.col(name)
        for level in range(1, depth[name] + 1):
            total = total + F.coalesce(F.col(f"{name}_carry{level}") * F.pow(F.lit(q), F.col("ema_at") + 1 + (level - 1) * EMA_BLOCK), F.lit(0.0))
        full[name] = total
    return out.withColumns(full).select(*df.columns, *spans)
