"""Base indicators and the trend report of the last bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import change, div, first_match, high, lag, low, mean, std, whole

MA = (5, 10, 20, 60)

def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))

def add_indicators(bars: DataFrame) -> DataFrame:
    """Moving averages, extrema, candle parts, average true range and Bollinger bands.

    Averages start with the first bar; the true range average needs 14 bars and the
    bands 20.  Prices are ``adj_close`` where the bars have it.
    """
    px = F.col("adj_close") if "adj_close" in bars.columns else F.col("close")
    df = bars.withColumn("px", px).withColumn("tr", true_range())
    df = df.withColumns({f"ma{p}": mean("px", p) for p in MA} | {
        "vol_ma20": mean("volume", 20), "high_20": high("high", 20), "low_20": low("low", 20), "high_60": high("high", 60), "low_60": low("low", 60),
        "daily_ret": change("px"), "atr14": mean("tr", 14, 14), "bb_std": std("px", 20, 20),
    })
    return df.withColumns({
        "vol_ratio": div("volume", "vol_ma20"),
        "body": F.abs(F.col("close") - F.col("open")), "body_dir": F.when(F.col("close") >= F.col("open"), 1).otherwise(-1),
        "lower_shadow": F.least("open", "close") - F.col("low"), "upper_shadow": F.col("high") - F.greatest("open", "close"), "total_range": F.col("high") - F.col("low"),
        "bb_mid": F.col("ma20"), "bb_upper": F.col("ma20") + 2 * F.col("bb_std"), "bb_lower": F.col("ma20") - 2 * F.col("bb_std"),
        "bb_width": div(4 * F.col("bb_std"), "ma20"), "ma_spread": div(F.abs(F.col("ma5") - F.col("ma60")), "ma60"),
    })

def add_ma(bars: DataFrame, periods=MA) -> DataFrame:
    """Averages that need their whole window, as ``sma<p>``."""
    return bars.withColumns({f"sma{p}": mean("close", p, p) for p in periods})

def last_bars(df: DataFrame, n: int) -> DataFrame:
    """The last n bars of each ticker, with ``back`` = 0 for the newest."""
    return df.withColumn("back", F.max("rn").over(whole()) - F.col("rn")).where(F.col("back") < n)

def calc_slope(df: DataFrame, column: str, lookback: int = 5) -> DataFrame:
    """Least-squares slope of the last ``lookback`` non-null values, by their mean; 0 if there are fewer."""
    known = df.where(F.col(column).isNotNull()).withColumn("at", F.row_number().over(whole().orderBy(F.desc("rn")))).where(F.col("at") <= lookback)
    fit = known.groupBy("ticker").agg(F.count("*").alias("n"), F.regr_slope(F.col(column), -F.col("at")).alias("s"), F.avg(column).alias("m"))
    values = fit.select("ticker", F.when((F.col("n") == lookback) & (F.col("m") != 0), F.col("s") / F.nullif("m", F.lit(0.0))).alias("slope"))
    return df.select("ticker").distinct().join(values, "ticker", "left").select("ticker", F.coalesce("slope", F.lit(0.0)).alias("slope"))

def trend_direction(slope: Column, threshold: float = 0.001) -> Column:
    return F.when(slope > threshold, "up").when(slope < -threshold, "down").otherwise("flat")

def slope_summary(bars: DataFrame, periods=MA, lookback: int = 5) -> DataFrame:
    """ticker, ma, slope in percent, direction and last value of each average."""
    df = add_ma(bars, periods)
    names = [f"sma{p}" for p in periods]
    long = df.unpivot(["ticker", "rn"], names, "ma", "value").where("value is not null")
    recent = long.withColumn("at", F.row_number().over(Window.partitionBy("ticker", "ma").orderBy(F.desc("rn")))).where(F.col("at") <= lookback)
    fit = recent.groupBy("ticker", "ma").agg(F.count("*").alias("n"), F.regr_slope(F.col("value"), -F.col("at")).alias("s"), F.avg("value").alias("m"), F.max(F.when(F.col("at") == 1, F.col("value"))).alias("last"))
    slope = F.when((F.col("n") == lookback) & (F.col("m") != 0), F.col("s") / F.nullif("m", F.lit(0.0))).otherwise(0.0)
    return fit.select("ticker", "ma", F.round(slope * 100, 4).alias("slope_pct"), trend_direction(slope).alias("direction"), "last")

def ma_alignment(df: DataFrame, periods=MA) -> DataFrame:
    """bull, bear or tangled: whether the averages of the last bar are strictly ordered."""
    p = [F.col(f"sma{x}") for x in sorted(periods)]
    down = up = F.lit(True)
    for a, b in zip(p, p[1:], strict=False):
        down, up = down & (a > b), up & (a < b)
    return last_bars(df, 1).select("ticker", F.when(down, "bull").when(up, "bear").otherwise("tangled").alias("alignment"))

def find_cross(df: DataFrame, fast: int = 5, slow: int = 20, recent: int = 20) -> DataFrame:
    """Strict crosses of two averages among the last bars, newest first (``back`` ascending)."""
    gap = F.col(f"sma{fast}") - F.col(f"sma{slow}")
    crossed = df.withColumn("gap", gap).withColumn("before", lag("gap"))
    n = F.max("rn").over(whole()) + 1
    crossed = crossed.withColumn("back", n - 1 - F.col("rn")).withColumn("span", F.least(n, F.lit(recent + 5)))
    kind = F.when((F.col("before") < 0) & (F.col("gap") > 0), "golden").when((F.col("before") > 0) & (F.col("gap") < 0), "death")
    return crossed.withColumn("cross", kind).where("cross is not null and back < span - 1").select("ticker", "ts", "back", "cross", "close")

def find_support_resistance(bars: DataFrame, window: int = 20) -> DataFrame:
    """Lowest low and highest high of the last bars and their distance from the last close in percent."""
    last = last_bars(bars, window).groupBy("ticker").agg(F.min("low").alias("support"), F.max("high").alias("resistance"), F.max_by("close", "rn").alias("close"))
    return last.select("ticker", "close", "support", "resistance", F.round(div(F.col("close") - F.col("support"), "support") * 100, 2).alias("support_pct"), F.round(div(F.col("resistance") - F.col("close"), "close") * 100, 2).alias("resistance_pct"))

def trend_analysis(bars: DataFrame, periods=MA) -> DataFrame:
    """One row per ticker: slopes and directions of all averages, alignment, recent crosses, support and resistance, overall direction, last close and date.

    ``slopes``: array<struct<ma, slope_pct, direction, last>> by average; ``crosses``:
    array<struct<back, ts, cross>>, newest first.
    """
    df = add_ma(bars, periods)
    summary = slope_summary(bars, periods)
    slopes = summary.groupBy("ticker").agg(F.max(F.when(F.col("ma") == "sma20", F.col("slope_pct"))).alias("ma20_slope_pct"), F.array_sort(F.collect_list(F.struct("ma", "slope_pct", "direction", "last"))).alias("slopes"))
    crosses = find_cross(df, recent=30).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("back", "ts", "cross"))).alias("crosses"))
    dates = bars.groupBy("ticker").agg(F.max("ts").alias("latest_ts"))
    out = find_support_resistance(bars).join(ma_alignment(df, periods), "ticker", "left").join(slopes, "ticker", "left").join(crosses, "ticker", "left").join(dates, "ticker")
    slope = F.coalesce("ma20_slope_pct", F.lit(0.0))
    overall = first_match((slope > 0.5, "up"), (slope < -0.5, "down"), default="sideways")
    none = F.array().cast("array<struct<back:int,ts:timestamp,cross:string>>")
    return out.withColumn("crosses", F.coalesce("crosses", none)).withColumn("n_crosses", F.size("crosses")).withColumn("latest_cross", F.get("crosses", F.lit(0))["cross"]).withColumn("overall", overall)
