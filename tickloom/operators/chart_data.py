"""The data behind charts: trend lines, levels, scaled overlays and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import change, div, whole
from .strategies import long_strategies
from .trendlines import fit, pivot

col = F.col
SPANS, LEAST_R2, APART, MOST = (3, 5, 8, 13), 0.35, 5e-5, 4
RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)


def trend_lines(bars: DataFrame) -> DataFrame:
    """(ticker, side, span, slope, intercept, r2, first_rn): per side and span the first fit above the limit
    through the last three, four or five pivots; at most four lines a side with slopes apart, best fit first."""
    sides = (("up", "low", True), ("down", "high", False))
    hits = [F.when(pivot(x, span, lowest), F.struct(F.lit(side).alias("side"), F.lit(span).alias("span"), col("rn").cast("double").alias("x"), col(x).cast("double").alias("y"))) for side, x, lowest in sides for span in SPANS]
    # all pivots in one pass over the bars, then the last five of each side and span
    seen = bars.withColumn("n", F.max("rn").over(whole()) + 1).withColumn("hits", F.array(*hits))
    flat = seen.select("ticker", "n", F.explode(F.filter("hits", lambda h: h.isNotNull())).alias("h")).where(col("n") >= 4 * col("h.span")).select("ticker", "h.*")
    flat = flat.withColumn("back", F.row_number().over(Window.partitionBy("ticker", "side", "span").orderBy(F.desc("x")))).where("back <= 5")
    points = flat.groupBy("ticker", "side", "span").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p")).where(F.size("p") >= 3)
    tries = F.array(*(F.when(F.size("p") >= k, F.struct(fit(F.slice("p", -k, k)).alias("f"), F.get(F.slice("p", -k, k), F.lit(0))["x"].alias("first_rn"))) for k in (3, 4, 5)))
    good = F.filter(tries, lambda t: t.isNotNull() & (t["f"]["r2"] > LEAST_R2))
    out = points.select("ticker", "side", "span", F.get(good, F.lit(0)).alias("t")).where("t is not null")
    out = out.select("ticker", "side", "span", "t.f.slope", "t.f.intercept", "t.f.r2", col("t.first_rn").cast("int").alias("first_rn"))
    # at most one candidate per side and span: the greedy choice is a fold over four
    line = F.struct(col("r2"), (-col("span")).alias("order"), col("slope"), col("intercept"), col("first_rn"))
    grouped = out.groupBy("ticker", "side").agg(F.sort_array(F.collect_list(line), asc=False).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when((F.size(acc) < MOST) & F.forall(acc, lambda k: F.abs(k["slope"] - x["slope"]) > APART), F.concat(acc, F.array(x))).otherwise(acc))
    return grouped.select("ticker", "side", F.explode(kept).alias("l")).select("ticker", "side", (-col("l.order")).alias("span"), "l.slope", "l.intercept", "l.r2", "l.first_rn")


def fibonacci_levels(bars: DataFrame, lookback: int = 120, within: float = 0.2) -> DataFrame:
    """Retracement levels of the last bars' range that lie near the last close."""
    last = bars.withColumn("newest", F.max("rn").over(whole())).where(col("rn") > col("newest") - lookback)
    span = last.groupBy("ticker").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max_by("close", "rn").alias("close"))
    levels = span.select("ticker", "close", "lo", "hi", F.explode(F.array(*map(F.lit, RATIOS))).alias("ratio"))
    out = levels.withColumn("level", col("lo") + (col("hi") - col("lo")) * col("ratio"))
    return out.where(div(F.abs(col("level") - col("close")), "close") < within).select("ticker", "ratio", "level")


def support_resistance_clusters(bars: DataFrame, side: int = 5, each: int = 3) -> DataFrame:
    """Means of chained clusters of pivot prices: of lows the nearest ``each`` below the last close, of highs above it.

    A pivot joins the cluster of the next lower one if it is nearer than 0.4 times the
    mean range of the last 20 bars (0.02 times the close where there are fewer).
    """
    newest = F.max("rn").over(whole())
    tagged = bars.withColumn("newest", newest).withColumn("is_low", pivot("low", side, True)).withColumn("is_high", pivot("high", side, False))
    span = F.avg(F.when(col("rn") > col("newest") - 20, col("high") - col("low")))
    limits = tagged.groupBy("ticker").agg(span.alias("span"), F.max_by("close", "rn").alias("close"), F.count("*").alias("n"))
    limits = limits.select("ticker", "close", (0.4 * F.when(col("n") >= 20, col("span")).otherwise(0.02 * col("close"))).alias("gap"))
    lows = tagged.where("is_low").select("ticker", F.lit("support").alias("side"), col("low").alias("price"))
    highs = tagged.where("is_high").select("ticker", F.lit("resistance").alias("side"), col("high").alias("price"))
    by_price = Window.partitionBy("ticker", "side").orderBy("price")
    chained = lows.unionByName(highs).join(limits, "ticker").withColumn("fresh", F.when(col("price") - F.lag("price").over(by_price) < col("gap"), 0).otherwise(1))
    chained = chained.withColumn("cluster", F.sum("fresh").over(by_price.rowsBetween(Window.unboundedPreceding, 0)))
    means = chained.groupBy("ticker", "side", "cluster").agg(F.avg("price").alias("level"), F.count("*").alias("touches"), F.first("close").alias("close"))
    means = means.where((col("side") == "support") & (col("level") < col("close")) | (col("side") == "resistance") & (col("level") > col("close")))
    near = Window.partitionBy("ticker", "side").orderBy(F.abs(col("level") - col("close")), "level")
    return means.withColumn("rank", F.row_number().over(near)).where(col("rank") <= each).select("ticker", "side", "rank", "level", "touches")


def scaled_obv(factors: DataFrame) -> DataFrame:
    """Volume balance scaled into the volume axis."""
    lo, hi, top = F.min("obv").over(whole()), F.max("obv").over(whole()), F.max("volume").over(whole())
    return factors.select("ticker", "ts", "rn", (div(col("obv") - lo, hi - lo) * top * 0.8).alias("obv_scaled"))


def signal_markers(df: DataFrame, most: int = 15) -> DataFrame:
    """The last buys and sells of every strategy."""
    fired = long_strategies(df).where("vote <> 0").withColumn("side", F.when(col("vote") > 0, "buy").otherwise("sell"))
    last = Window.partitionBy("ticker", "strategy", "side").orderBy(F.desc("rn"))
    return fired.withColumn("k", F.row_number().over(last)).where(col("k") <= most).select("ticker", "strategy", "side", "k", "ts", "rn")


def last_change(bars: DataFrame) -> DataFrame:
    """The last close and its change in percent."""
    df = bars.withColumn("change_pct", change("close") * 100).withColumn("newest", F.max("rn").over(whole()))
    return df.where("rn = newest").select("ticker", "ts", "close", "change_pct")


