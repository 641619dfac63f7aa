"""Running totals, maxima and recursive averages of series of any length: a two-pass prefix scan.

A series is dealt to blocks of ``block`` bars by (ticker, block).  The first pass works within
blocks and keeps one summary row of each; what the blocks before add is carried over those
rows, and the second pass joins it back by (ticker, block), as the bars are dealt already.  One
ticker with very many bars is thus many tasks, with the same results as one window
over all of its bars (``functions.frames``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

col = F.col
#: Bars of a block; powers of the recursive averages stay in range within it.
BLOCK = 2048


def _within():
    return Window.partitionBy("ticker", "block").orderBy("rn")


def _blocks():
    return Window.partitionBy("ticker").orderBy("block")


def numbered_in_blocks(bars: DataFrame, buckets: int = 4096) -> DataFrame:
    """``bars`` with the 0-based number ``rn`` of each ticker's bars in order of ``ts``.

    Equal stretches of time are counted ticker by ticker and the counts summed up, so no
    task sorts a whole ticker.
    """
    low, high = bars.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = max(((high or 0) - (low or 0)) // buckets + 1, 1)
    dealt = bars.withColumn("stretch", F.floor((F.unix_micros("ts") - (low or 0)) / width))
    counts = dealt.groupBy("ticker", "stretch").count()
    before = Window.partitionBy("ticker").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("ticker", "stretch", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("ticker", "stretch").orderBy("ts"))
    out = dealt.withColumn("place", place).join(counts, ["ticker", "stretch"])
    return out.select(*bars.columns, (col("before") + col("place") - 1).cast("int").alias("rn"))


def with_previous(df: DataFrame, *, block: int = BLOCK, **columns: str) -> DataFrame:
    """Add the value of a column at the ticker's bar before, by its new name."""
    dealt = df.withColumn("block", F.floor(col("rn") / block))
    ends = dealt.groupBy("ticker", (col("block") + 1).alias("block")).agg(*(F.max_by(c, "rn").alias(f"end_{n}") for n, c in columns.items()))
    own = dealt.withColumns({f"own_{n}": F.lag(c).over(_within()) for n, c in columns.items()})
    out = own.withColumn("first", F.row_number().over(_within()) == 1).join(ends, ["ticker", "block"], "left")
    return out.select(*df.columns, *(F.when(col("first"), col(f"end_{n}")).otherwise(col(f"own_{n}")).alias(n) for n in columns))


def scan(df: DataFrame, *, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, emas: dict[str, tuple[Column, int]] | None = None, block: int = BLOCK) -> DataFrame:
    """Add running sums, running maxima and recursive averages (value, span) up to every bar; bars are numbered 0, 1, ...

    Nulls add nothing and are no maximum; before the first value a sum and a maximum are null.
    """
    sums, maxima, emas = sums or {}, maxima or {}, emas or {}
    upto = _within().rowsBetween(Window.unboundedPreceding, 0)
    dealt = df.withColumn("block", F.floor(col("rn") / block)).withColumn("at", col("rn") % block)
    q = {n: 1 - 2 / (span + 1) for n, (_, span) in emas.items()}
    weight = lambda span: F.when(col("rn") == 0, 1.0).otherwise(2 / (span + 1))
    local = {f"own_{n}": F.sum(x).over(upto) for n, x in sums.items()} | {f"own_{n}": F.max(x).over(upto) for n, x in maxima.items()}
    local |= {f"own_{n}": F.pow(F.lit(q[n]), col("at")) * F.sum(weight(span) * x * F.pow(F.lit(q[n]), -col("at"))).over(upto) for n, (x, span) in emas.items()}
    dealt = dealt.withColumns(local)
    ends = dealt.groupBy("ticker", "block").agg(*(F.max_by(c, "rn").alias(c) for c in local))
    earlier = _blocks().rowsBetween(Window.unboundedPreceding, -1)
    carry = {f"before_{n}": F.sum(f"own_{n}").over(earlier) for n in sums} | {f"before_{n}": F.max(f"own_{n}").over(earlier) for n in maxima}
    for n in emas:
        # blocks back until what they weigh is below the precision of a double
        depth = math.ceil(41 / (-math.log(q[n]) * block))
        carry[f"before_{n}"] = sum(F.coalesce(F.lag(f"own_{n}", k).over(_blocks()) * q[n] ** ((k - 1) * block), F.lit(0.0)) for k in range(1, depth + 1))
    before = ends.select("ticker", "block", *(c.alias(n) for n, c in carry.items()))
    out = dealt.join(before, ["ticker", "block"], "left")
    both = lambda n: F.coalesce(col(f"own_{n}") + col(f"before_{n}"), f"own_{n}", f"before_{n}")
    full = {n: both(n) for n in sums} | {n: F.greatest(f"own_{n}", f"before_{n}") for n in maxima}
    full |= {n: col(f"own_{n}") + col(f"before_{n}") * F.pow(F.lit(q[n]), col("at") + 1) for n in emas}
    return out.select(*df.columns, *(c.alias(n) for n, c in full.items()))


def drawdown(df: DataFrame, value: str = "close", block: int = BLOCK) -> DataFrame:
    """ticker and the largest fall of ``value`` below its running maximum, as a share of it."""
    seen = scan(df, maxima={"peak": col(value)}, block=block)
    return seen.groupBy("ticker").agg(F.min((col(value) - col("peak")) / F.nullif(col("peak"), F.lit(0.0))).alias("max_drawdown"))
