"""Trend, volatility, momentum, volume, structure and adaptive factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import change, div, first_match, high, lag, low, mean, ordered, rank_pct, rows, running, slope, std, true, whole, with_ema
from .indicators import add_indicators

col = F.col


def _moving_sum(x, n):
    return F.sum(x).over(rows(n))


def add_trend(df: DataFrame) -> DataFrame:
    df = with_ema(df, ema12=("close", 12), ema20=("close", 20), ema26=("close", 26), ema50=("close", 50), ema100=("close", 100))
    above = lambda a, b: F.when(col(a) > col(b), 1).otherwise(-1)
    averages = ("ma5", "ma10", "ma20", "ma60")
    return df.withColumns({
        "ma_ribbon_width": F.greatest(*averages) - F.least(*averages),
        "trend_slope_ma20": slope("ma20", 10, 3) * 100,
        "ma_distance": div(col("close") - col("ma20"), "ma20") * 100,
        "ma_ribbon_score": above("ma5", "ma10") + above("ma10", "ma20") + above("ma20", "ma60") + above("ma5", "ma60"),
    }).withColumn("ma_ribbon_width_pct", div("ma_ribbon_width", "ma20"))


def add_volatility(df: DataFrame) -> DataFrame:
    bands = {f"atr_{side}_{m}": col("close") + sign * m / 10 * col("atr14") for m in (10, 15, 20, 25) for side, sign in (("upper", 1), ("lower", -1))}
    df = df.withColumns(bands | {
        "keltner_mid": col("ema20"), "keltner_upper": col("ema20") + 2 * col("atr14"), "keltner_lower": col("ema20") - 2 * col("atr14"),
        "ret": change("close"), "bb_width_pct": col("bb_width") * 100,
    })
    df = df.withColumn("hist_vol_20", std("ret", 20, 20) * F.sqrt(F.lit(252.0)) * 100)
    return df.withColumns({"vol_rank": rank_pct("hist_vol_20", 60, 20), "bb_squeeze_rank": rank_pct("bb_width", 60, 20)}).drop("ret")


def add_momentum(df: DataFrame) -> DataFrame:
    step = col("close") - lag("close")
    df = df.withColumns({"gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))), "tp": (col("high") + col("low") + col("close")) / 3, "macd_line": col("ema12") - col("ema26")})
    rsi = lambda n: 100 - 100 / (1 + div(mean("gain", n), mean("loss", n)))
    h, lo = high("high", 14), low("low", 14)
    df = df.withColumns({
        "rsi_14": rsi(14), "rsi_28": rsi(28), "stochastic_k": div(col("close") - lo, h - lo) * 100, "roc_10": change("close", 10) * 100, "roc_20": change("close", 20) * 100,
        "williams_r": div(h - col("close"), h - lo) * -100, "cci_20": div(col("tp") - mean("tp", 20), 0.015 * F.stddev_samp("tp").over(rows(20))),
    })
    df = with_ema(df, macd_signal=("macd_line", 9))
    return df.withColumns({"stochastic_d": mean("stochastic_k", 3), "macd_hist": col("macd_line") - col("macd_signal")}).drop("gain", "loss", "tp")


def add_volume(df: DataFrame) -> DataFrame:
    traded = F.sum("volume").over(running())
    clv = div((col("close") - col("low")) - (col("high") - col("close")), col("high") - col("low"))
    signed = F.coalesce(F.signum(col("close") - lag("close")), F.lit(0.0)) * col("volume")
    df = df.withColumns({
        "vwap": F.sum(col("volume") * col("close")).over(running()) / F.when(traded == 0, 1).otherwise(traded), "clv": clv, "signed": signed,
        "volume_ratio": col("vol_ratio"), "volume_ma20": col("vol_ma20"), "price_new_high": true(col("close") == high("close", 20)), "volume_high": high("volume", 20),
    })
    df = df.withColumns({"obv": F.sum("signed").over(running()), "ad_line": F.when(col("clv").isNotNull(), F.sum(col("clv") * col("volume")).over(running())), "vol_not_new_high": true(col("volume") < lag("volume_high"))})
    return df.withColumn("volume_divergence_bear", col("price_new_high") & col("vol_not_new_high")).drop("clv", "signed", "volume_high")


def add_structure(df: DataFrame) -> DataFrame:
    middle = lambda n: (high("high", n) + low("low", n)) / 2
    df = df.withColumns({"ichimoku_conv": middle(9), "ichimoku_base": middle(26), "mid52": middle(52), "donchian_high": high("high", 20), "donchian_low": low("low", 20), "pivot_pp": (lag("high") + lag("low") + lag("close")) / 3})
    return df.withColumns({
        "ichimoku_span_a": (lag("ichimoku_conv", 26) + lag("ichimoku_base", 26)) / 2, "ichimoku_span_b": lag("mid52", 26), "ichimoku_lag": F.lead("close", 26).over(ordered()),
        "donchian_mid": (col("donchian_high") + col("donchian_low")) / 2,
        "pivot_r1": 2 * col("pivot_pp") - lag("low"), "pivot_s1": 2 * col("pivot_pp") - lag("high"), "pivot_r2": col("pivot_pp") + (lag("high") - lag("low")), "pivot_s2": col("pivot_pp") - (lag("high") - lag("low")),
    }).drop("mid52")


def add_adaptive(df: DataFrame) -> DataFrame:
    """Directional movement, its index, trend strength and the regime label.

    The exclusion keeps the weaker side's movement, as the analyses this engine
    serves have always done; a missing comparison counts as false.
    """
    up, down = col("high") - lag("high"), lag("low") - col("low")
    df = df.withColumns({"up": F.when(up.isNotNull(), F.greatest(up, F.lit(0.0))), "down": F.when(down.isNotNull(), F.greatest(down, F.lit(0.0)))})
    rising = true(col("up") > col("down"))
    df = df.withColumns({"plus": F.when(rising, 0.0).otherwise(col("up")), "minus": F.when(rising, col("down")).otherwise(0.0)})
    df = df.withColumns({"di_plus": div(100 * _moving_sum("plus", 14), _moving_sum("tr", 14)), "di_minus": div(100 * _moving_sum("minus", 14), _moving_sum("tr", 14))})
    df = df.withColumn("dx", div(100 * F.abs(col("di_plus") - col("di_minus")), col("di_plus") + col("di_minus")))
    df = df.withColumn("adx_14", mean("dx", 14))
    sign = F.when(col("di_plus") > col("di_minus"), 1).otherwise(-1)
    known = col("adx_14").isNotNull() & col("di_plus").isNotNull() & col("di_minus").isNotNull()
    size = first_match((col("adx_14") > 40, 3), (col("adx_14") > 25, 2), (col("adx_14") > 15, 1), default=0)
    regime = first_match(((col("bb_squeeze_rank") < 0.2) & (col("adx_14") < 20), "ranging"), (col("adx_14") > 30, "trending"), (col("vol_rank") > 0.7, "volatile"), default="ranging")
    return df.withColumns({"trend_strength": F.when(known, size * sign).otherwise(0), "market_regime": regime}).drop("up", "down", "plus", "minus", "dx")


def add_all_factors(bars: DataFrame) -> DataFrame:
    """Base indicators where missing, then every factor group; one shuffle by ticker."""
    df = bars if "ma20" in bars.columns else add_indicators(bars)
    for group in (add_trend, add_volatility, add_momentum, add_volume, add_structure, add_adaptive):
        df = group(df)
    return df


#: Factor groups and their columns.
GROUPS = {
    "trend": ["ema12", "ema26", "ema50", "ema100", "ma_ribbon_width", "ma_ribbon_width_pct", "trend_slope_ma20", "ma_distance", "ma_ribbon_score"],
    "volatility": ["keltner_mid", "keltner_upper", "keltner_lower", *(f"atr_{s}_{m}" for m in (10, 15, 20, 25) for s in ("upper", "lower")), "hist_vol_20", "vol_rank", "bb_width_pct", "bb_squeeze_rank"],
    "momentum": ["rsi_14", "rsi_28", "stochastic_k", "stochastic_d", "macd_line", "macd_signal", "macd_hist", "roc_10", "roc_20", "williams_r", "cci_20"],
    "volume": ["vwap", "obv", "volume_ratio", "volume_ma20", "price_new_high", "vol_not_new_high", "volume_divergence_bear", "ad_line"],
    "structure": ["ichimoku_conv", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b", "ichimoku_lag", "donchian_high", "donchian_low", "donchian_mid", "pivot_pp", "pivot_r1", "pivot_s1", "pivot_r2", "pivot_s2"],
    "adaptive": ["di_plus", "di_minus", "adx_14", "trend_strength", "market_regime"],
}


# The panels of a chart and the columns that each shows.
PANELS = {
    "main": [
        "ma5", "ma10", "ma20", "ma60", "ema12", "ema26", "ema50", "bb_upper", "bb_mid", "bb_lower", "keltner_upper", "keltner_mid", "keltner_lower", "atr_upper_20", "atr_lower_20", "vwap",
        "ichimoku_conv", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b", "donchian_high", "donchian_low", "pivot_pp", "pivot_r1", "pivot_s1",
    ],
    "sub_momentum": ["rsi_14", "rsi_28", "stochastic_k", "stochastic_d", "macd_hist", "roc_10", "williams_r"],
    "sub_volatility": ["hist_vol_20", "vol_rank", "bb_width_pct", "bb_squeeze_rank"],
    "sub_volume": ["volume_ratio", "obv", "ad_line"],
    "sub_directional": ["adx_14", "di_plus", "di_minus", "trend_strength"],
}


def factor_registry(spark) -> DataFrame:
    """Dimension of factors: name, label, category, panel of the chart (null if none shows it), place."""
    panel = {name: p for p, names in PANELS.items() for name in names}
    known = [(name, group) for group, names in GROUPS.items() for name in names] + [(name, "base") for name in PANELS["main"] if not any(name in names for names in GROUPS.values())]
    rows = [(name, name.replace("_", " "), group, panel.get(name), i) for i, (name, group) in enumerate(known)]
    return spark.createDataFrame(rows, "factor string, label string, category string, panel string, place int")


def latest_factors(df: DataFrame) -> DataFrame:
    """Long form of the last bar's non-null numeric factors, by ticker."""
    names = [n for g in GROUPS.values() for n in g if n not in ("price_new_high", "vol_not_new_high", "volume_divergence_bear", "market_regime")]
    last = df.withColumn("newest", F.max("rn").over(whole())).where("rn = newest")
    return last.select("ticker", "ts", *(col(n).cast("double").alias(n) for n in names)).unpivot(["ticker", "ts"], names, "factor", "value").where("value is not null")


