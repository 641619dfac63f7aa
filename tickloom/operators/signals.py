"""Trend-line, slope, curve and candlestick signals, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import div, first_match, flag, lag, ordered, slope, true, whole
from .indicators import add_indicators
from .trendlines import with_trendlines

col = F.col

# Signal keys and directions.
REGISTRY = {
    "trendline_break_up": "bullish", "trendline_break_down": "bearish", "trendline_bounce_up": "bullish", "trendline_bounce_down": "bearish",
    "channel_top_touch": "bearish", "channel_bottom_touch": "bullish",
    "slope_accelerating_up": "bullish", "slope_decelerating_up": "bearish", "slope_accelerating_down": "bearish", "slope_decelerating_down": "bullish",
    "slope_divergence_bullish": "bullish", "slope_divergence_bearish": "bearish",
    "ma_golden_cross": "bullish", "ma_death_cross": "bearish", "ma_convergence": "neutral", "ma_divergence_bullish": "bullish", "ma_divergence_bearish": "bearish",
    "ma_ribbon_bullish": "bullish", "ma_ribbon_bearish": "bearish", "bb_squeeze_long": "bullish", "bb_squeeze_short": "bearish",
    "dark_cloud_cover": "bearish", "piercing_line": "bullish", "morning_star": "bullish", "evening_star": "bearish", "hammer": "bullish", "shooting_star": "bearish",
    "bullish_engulfing": "bullish", "bearish_engulfing": "bearish", "three_white_soldiers": "bullish", "three_black_crows": "bearish",
    "big_bull_breakout": "bullish", "support_bounce": "bullish", "reversal_after_decline": "bullish",
}
KEYS = list(REGISTRY)


def registry(spark) -> DataFrame:
    """Dimension of signals: key, label, direction, place."""
    return spark.createDataFrame([(k, k.replace("_", " "), d, i) for i, (k, d) in enumerate(REGISTRY.items())], "signal string, label string, direction string, place int")


def _no(cond):
    """Not, where NULL counts as not."""
    return ~true(cond)


def detect_all(bars: DataFrame) -> DataFrame:
    """``bars`` with base indicators and a ``signal_<key>`` column (0, 1 or 2) per registry key.

    Comparisons with missing values are false; guards written as "skip if" therefore
    pass while the true range average is still missing.
    """
    df = bars if "ma20" in bars.columns else add_indicators(bars)
    base = df.columns
    df = with_trendlines(df)
    df = df.withColumns({"s10": F.when(col("rn") >= 20, slope("ma20", 10, 5)), "s5": slope("ma5", 5, 3), "s10_5": slope("ma10", 5, 3), "widths": F.collect_list(F.when(col("bb_width").isNotNull(), col("bb_width"))).over(ordered().rowsBetween(-60, 0)), "width_rows": F.count(F.lit(1)).over(ordered().rowsBetween(-60, 0))})
    px, o, h, lo, c = col("px"), col("open"), col("high"), col("low"), col("close")
    rn, body, turn = col("rn"), col("body"), col("body_dir")
    vol = col("volume") > 0.8 * col("vol_ma20")
    atr = F.when(col("atr14").isNull() | (col("atr14") == 0), px * 0.01).otherwise(col("atr14"))
    up, down = col("up_line.value"), col("down_line.value")
    top = up + F.coalesce(3 * col("atr14"), px * 0.05)
    s, s5, s20 = col("s10"), lag("s10", 5), lag("s10", 20)
    late, later = rn >= 30, rn >= 40
    gap, gap1 = col("ma5") - col("ma20"), lag(col("ma5") - col("ma20"))
    ratio = div("ma_spread", lag("ma_spread", 10))
    calm = _no(F.size(F.filter("widths", lambda w: w < col("bb_width"))) / col("width_rows") > 0.8)
    body1, body2, turn1, turn2 = lag("body"), lag("body", 2), lag("body_dir"), lag("body_dir", 2)
    o1, c1, o2, c2 = lag("open"), lag("close"), lag("open", 2), lag("close", 2)
    small1 = _no(body1 < 0.5 * lag("atr14"))
    star = (rn >= 3) & _no(body2 < 0.5 * lag("atr14", 2)) & _no(body1 > 0.5 * body2) & _no(body < 0.5 * col("atr14"))
    long_body = (rn >= 5) & (body != 0) & col("atr14").isNotNull()
    engulfing = (body > body1)
    under = lambda x: (col(x) <= 0.3 * body) & (lag(x) <= 0.3 * body1) & (lag(x, 2) <= 0.3 * body2)
    stepping = lambda x, sign: (sign * (lag(x) - lag(x, 2)) > 0) & (sign * (col(x) - lag(x)) > 0)
    bulls = (c2 > o2) & (c1 > o1) & (c > o)
    bears = (c2 < o2) & (c1 < o1) & (c < o)
    declined = (lag("close", 1) < lag("close", 2)) & (lag("close", 2) < lag("close", 3)) & (lag("close", 3) < lag("close", 4))
    rules = {
        "trendline_break_up": flag((px > down + 0.3 * atr) & (px > lag("px")) & vol & (col("daily_ret") > 0.01), 2),
        "trendline_break_down": flag((px < up - 0.3 * atr) & (px < lag("px")) & vol & (col("daily_ret") < -0.01), 2),
        "trendline_bounce_up": flag((F.abs(lo - up) < 0.5 * atr) & (px > up + 0.5 * atr) & (turn == 1) & (col("lower_shadow") > 0.5 * body) & vol),
        "trendline_bounce_down": flag((F.abs(h - down) < 0.5 * atr) & (px < down - 0.3 * atr) & (turn == -1) & (col("upper_shadow") > 0.5 * body) & vol),
        "channel_top_touch": flag((h >= top - 0.3 * atr) & (turn == -1)),
        "channel_bottom_touch": flag((lo <= up + 0.3 * atr) & (turn == 1)),
        "slope_accelerating_up": flag(late & (s > 0) & (s5 > 0) & (s > 1.3 * s5)),
        "slope_decelerating_up": flag(late & (s > 0) & (s5 > 0) & (s < 0.6 * s5)),
        "slope_accelerating_down": flag(late & (s < 0) & (s5 < 0) & (s < 1.3 * s5)),
        "slope_decelerating_down": flag(late & (s < 0) & (s5 < 0) & (s > 0.6 * s5)),
        "slope_divergence_bullish": flag(later & (px < lag("px", 20)) & (s > s20) & (s < 0) & (s20 < 0)),
        "slope_divergence_bearish": flag(later & (px > lag("px", 20)) & (s < s20) & (s > 0) & (s20 > 0)),
        "ma_golden_cross": flag((rn >= 21) & (gap1 < 0) & (gap > 0)),
        "ma_death_cross": flag((rn >= 21) & (gap1 > 0) & (gap < 0)),
        "ma_convergence": flag(late & (ratio < 0.6)),
        "ma_divergence_bullish": flag(late & (ratio > 1.5) & (px > col("ma60"))),
        "ma_divergence_bearish": flag(late & (ratio > 1.5) & (px < col("ma60"))),
        "ma_ribbon_bullish": flag((rn >= 60) & (col("ma5") > col("ma10")) & (col("ma10") > col("ma20")) & (col("ma20") > col("ma60"))),
        "ma_ribbon_bearish": flag((rn >= 60) & (col("ma5") < col("ma10")) & (col("ma10") < col("ma20")) & (col("ma20") < col("ma60"))),
        "bb_squeeze_long": flag(late & calm & (px > col("bb_mid")) & (lag("px") <= lag("bb_mid")) & vol),
        "bb_squeeze_short": flag(late & calm & (px < col("bb_mid")) & (lag("px") >= lag("bb_mid")) & vol),
        "dark_cloud_cover": flag((rn >= 5) & (col("s10_5") > 0.001) & small1 & (turn1 == 1) & (o > c1) & (turn == -1) & (c < (o1 + c1) / 2)),
        "piercing_line": flag((rn >= 5) & (col("s10_5") < -0.001) & small1 & (turn1 == -1) & (o < c1) & (turn == 1) & (c > (o1 + c1) / 2)),
        "morning_star": flag(star & (turn2 == -1) & (turn == 1) & (c > (o2 + c2) / 2) & vol, 2),
        "evening_star": flag(star & (turn2 == 1) & (turn == -1) & (c < (o2 + c2) / 2) & vol, 2),
        "hammer": flag(long_body & _no(px > lag("px", 5)) & (col("lower_shadow") >= 2 * body) & (col("upper_shadow") <= 0.5 * body) & (turn == 1) & vol),
        "shooting_star": flag(long_body & _no(px < lag("px", 5)) & (col("upper_shadow") >= 2 * body) & (col("lower_shadow") <= 0.5 * body) & (turn == -1) & vol),
        "bullish_engulfing": F.when((turn1 == -1) & (turn == 1) & (o < c1) & (c > o1) & engulfing & (px < col("ma20")), F.when(vol, 2).otherwise(1)).otherwise(0),
        "bearish_engulfing": F.when((turn1 == 1) & (turn == -1) & (o > c1) & (c < o1) & engulfing & (px > col("ma20")), F.when(vol, 2).otherwise(1)).otherwise(0),
        "three_white_soldiers": flag((rn >= 2) & bulls & stepping("close", 1) & stepping("open", 1) & under("upper_shadow")),
        "three_black_crows": flag((rn >= 2) & bears & stepping("close", -1) & stepping("open", -1) & under("lower_shadow")),
        "big_bull_breakout": flag((rn >= 5) & (col("daily_ret") > 0.03) & (c > lag("high_20")) & vol & (col("s5") > 0.001), 2),
        "support_bounce": flag((lo <= 1.02 * lag("low_20")) & (c > o) & vol & (col("lower_shadow") > 0.8 * body)),
        "reversal_after_decline": flag((rn >= 10) & declined & (c > lag("high")) & vol & (lag("s5") < 0) & (col("s5") > -0.0005), 2),
    }
    return df.select(*base, *(rules[k].alias(f"signal_{k}") for k in KEYS))


def long_signals(df: DataFrame) -> DataFrame:
    """(ticker, ts, rn, signal, strength), one row per bar and signal."""
    names = [f"signal_{k}" for k in KEYS]
    out = df.select("ticker", "ts", "rn", *names).unpivot(["ticker", "ts", "rn"], names, "signal", "strength")
    return out.withColumn("signal", F.substring("signal", 8, 100))


def active_signals(df: DataFrame, recent: int = 5) -> DataFrame:
    """Signals that fired in the last bars: latest strength and time, and how often."""
    newest = df.withColumn("newest", F.max("rn").over(whole())).where(col("rn") > col("newest") - recent)
    fired = long_signals(newest).where("strength > 0")
    directions = F.create_map(*[F.lit(x) for pair in REGISTRY.items() for x in pair])
    out = fired.groupBy("ticker", "signal").agg(F.max_by("strength", "rn").alias("strength"), F.max("ts").alias("last_ts"), F.count("*").alias("occurrences"))
    return out.withColumn("direction", F.element_at(directions, col("signal")))


def signal_summary(df: DataFrame, recent: int = 5) -> DataFrame:
    """Counts by direction, net score and verdict of each ticker's recent signals."""
    active = active_signals(df, recent)
    side = F.when(col("direction") == "bullish", 1).when(col("direction") == "bearish", -1).otherwise(0)
    n = lambda d: F.sum(F.when(col("direction") == d, 1).otherwise(0)).alias(f"n_{d}")
    sums = active.groupBy("ticker").agg(n("bullish"), n("bearish"), n("neutral"), F.sum(side * col("strength")).alias("score"))
    out = df.select("ticker").distinct().join(sums, "ticker", "left").na.fill(0)
    verdict = first_match((col("score") >= 3, "strong_bullish"), (col("score") >= 1, "bullish"), (col("score") <= -3, "strong_bearish"), (col("score") <= -1, "bearish"), default="neutral")
    return out.withColumn("verdict", verdict)
