"""Rule strategies as Column builders, their consensus, and the registry.

A strategy maps a factor frame to -2..2.  Cases are tried from the highest priority
down; a comparison with a missing value is false.  Where a rule's stronger form is
implied by a later, weaker one it can't be reached and isn't listed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import div, first_match, gated, lag, mean, ordered, rows, true, whole

col = F.col


def _above(a, b):
    """a crosses above b; touching before counts."""
    return (a > b) & (_lagged(a) <= _lagged(b))


def _below(a, b):
    return (a < b) & (_lagged(a) >= _lagged(b))


def _lagged(x: Column) -> Column:
    return F.lag(x, 1).over(ordered())


def _cases(*cases):
    return first_match(*cases, default=0)


def close():
    return col("close")


def rsi():
    return col("rsi_14")


def adx():
    return col("adx_14")


def traded():
    return col("volume_ratio")


def rising():
    """The averages in rising order, shortest on top."""
    return (col("ma5") > col("ma10")) & (col("ma10") > col("ma20")) & (col("ma20") > col("ma60"))


def falling():
    return (col("ma5") < col("ma10")) & (col("ma10") < col("ma20")) & (col("ma20") < col("ma60"))


def ma_ribbon():
    return _cases((falling() | (close() < col("ma60")), -1), (rising() & (close() > col("ma20")) & (rsi() > 50) & (rsi() < 75), 1))


def ema_cross():
    a, b, e = col("ema12"), col("ema26"), col("ema50")
    death = _below(a, b)
    return _cases((death & (close() < e) & (a < e), -2), (true(death) | true((close() < e) & (a < b)), -1), (_above(a, b) & (close() > e), 1))


def trend_breakout():
    out = (close() > col("bb_upper")) & (traded() > 1.5)
    return _cases((out & (adx() > 35), 2), ((close() < col("bb_mid")) & (adx() > 20), -1), (out & (adx() > 25), 1))


def ma_pullback():
    near = div(F.abs(close() - col("ma20")), "ma20") < 0.03
    return _cases((true(close() < col("ma60")) | true(col("ma5") < col("ma60")), -1), (rising() & near & (rsi() > 40) & (rsi() < 55), 1))


def trend_acceleration():
    s, m = col("trend_slope_ma20"), mean("trend_slope_ma20", 5, 5)
    before = F.lag(m, 5).over(ordered())
    return _cases((true(m < before) | true(s < -0.5), -1), ((m > before) & (m > 0) & (s > 0), 1))


def rsi_extreme():
    before = lag("rsi_14")
    return _cases((rsi() > 85, -2), (rsi() < 20, 2), ((rsi() > 75) & (rsi() < before), -1), ((rsi() < 30) & (rsi() > before), 1))


def bb_mean_reversion():
    return _cases((true(_below(close(), col("bb_mid"))) | true((close() > col("bb_upper")) & (rsi() > 70)), -1), ((close() < col("bb_lower")) & (rsi() < 35), 1))


def stochastic_cross():
    k, d = col("stochastic_k"), col("stochastic_d")
    golden, death = _above(k, d), _below(k, d)
    return _cases((death & (k > 85), -2), (golden & (k < 15), 2), (death & (k > 75), -1), (golden & (k < 25), 1))


def macd_divergence():
    """Positions count from the oldest of the 20 bars; a short frame counts as position 0 of nothing."""
    place = lambda x, end: F.array_position(F.collect_list(x).over(rows(20)), end(F.collect_list(x).over(rows(20)))) - 1
    full = (F.count("close").over(rows(20)) == 20) & (F.count("macd_hist").over(rows(20)) == 20)
    top = full & (place("close", F.array_max) == 0) & (place("macd_hist", F.array_max) > 3)
    bottom = full & (place("close", F.array_min) == 0) & (place("macd_hist", F.array_min) > 3)
    return _cases((top, -1), (bottom, 1))


def williams_r_reversal():
    w, before = col("williams_r"), lag("williams_r")
    return _cases(((w > -20) & (w < before), -1), ((w < -80) & (w > before), 1))


def volume_breakout():
    top = F.lag(gated(F.max("close").over(rows(20)), "close", 20, 20), 1).over(ordered())
    bottom = F.lag(gated(F.min("close").over(rows(20)), "close", 20, 20), 1).over(ordered())
    return _cases(((close() < bottom) & (traded() < 0.7), -1), ((close() > top) & (traded() > 1.5), 1))


def obv_divergence():
    """Change of volume balance over ten bars; from a zero base it is infinite, signed as the change."""
    p, base = div(close(), lag("close", 10)) - 1, lag("obv", 10)
    grown = F.when(base == 0, F.when(col("obv") > 0, 1e308).when(col("obv") < 0, -1e308)).otherwise(div(col("obv"), base) - 1)
    return _cases(((p >= -0.01) & (grown < -0.02), -1), ((p <= 0.01) & (grown > 0.02), 1))


def vwap_mean_reversion():
    d = div(close() - col("vwap"), "vwap")
    return _cases((d > 0.08, -2), (d < -0.08, 2), (d > 0.05, -1), ((d < -0.05) & (traded() < 0.8), 1))


def bb_squeeze():
    """Squeezed against the tenth percentile of the whole series, later bars included."""
    tight = col("bb_width") < F.percentile("bb_width", F.lit(0.1)).over(whole())
    return _cases((tight & (close() < col("bb_lower")), -1), (tight & (close() > col("bb_upper")) & (traded() > 1.5), 1))


def keltner_breakout():
    return _cases((close() < col("keltner_lower"), -1), ((close() > col("keltner_upper")) & (adx() > 20), 1))


def atr_band():
    """The bands are drawn around the close itself, so it never leaves them."""
    return _cases((close() > col("atr_upper_20"), -1), (close() < col("atr_lower_20"), 1))


def triple_confirm_long():
    bull, strong = true(rising()), true(rsi() > 50)
    return _cases((bull & strong & (adx() > 30) & (col("di_plus") > col("di_minus")), 2), (~bull & ~strong, -1), (bull & strong & (adx() > 20), 1))


def triple_confirm_short():
    weak = falling() & (rsi() < 50)
    return _cases((weak & (adx() > 30) & (col("di_minus") > col("di_plus")), -2), (weak & (adx() > 20), -1))


def ichimoku_cloud():
    a, b = col("ichimoku_conv"), col("ichimoku_base")
    spans = col("ichimoku_span_a").isNotNull() & col("ichimoku_span_b").isNotNull()
    above = true(close() > F.when(spans, F.greatest("ichimoku_span_a", "ichimoku_span_b")))
    return _cases((_below(a, b), -1), (_above(a, b) & ~above, 1), (_above(a, b) & above, 2))


def full_monty():
    up, hist = true(rsi() > col("rsi_28")), col("macd_hist")
    bear = true(falling()) & ~up & (hist < 0)
    return _cases((bear & (adx() > 25), -2), (bear, -1), (rising() & up & (hist > 0), 1))


class Strategy(NamedTuple):
    id: str
    category: str
    stop_loss: float
    take_profit: float
    rule: Callable[[], Column]
    hold_min: int = 3
    hold_max: int = 30


# Ids, categories, stops and targets, in registry order.
STRATEGIES = [
    Strategy("ma_ribbon", "trend", 0.06, 0.12, ma_ribbon), Strategy("ema_cross", "trend", 0.06, 0.10, ema_cross), Strategy("trend_breakout", "trend", 0.07, 0.15, trend_breakout),
    Strategy("ma_pullback", "trend", 0.05, 0.10, ma_pullback), Strategy("trend_acceleration", "trend", 0.06, 0.12, trend_acceleration),
    Strategy("rsi_extreme", "reversal", 0.06, 0.08, rsi_extreme), Strategy("bb_mean_reversion", "reversal", 0.05, 0.08, bb_mean_reversion), Strategy("stochastic_cross", "reversal", 0.05, 0.08, stochastic_cross),
    Strategy("macd_divergence", "reversal", 0.06, 0.12, macd_divergence), Strategy("williams_r_reversal", "reversal", 0.05, 0.08, williams_r_reversal),
    Strategy("volume_breakout", "volume", 0.07, 0.15, volume_breakout), Strategy("obv_divergence", "volume", 0.05, 0.10, obv_divergence), Strategy("vwap_mean_reversion", "volume", 0.05, 0.08, vwap_mean_reversion),
    Strategy("bb_squeeze", "volatility", 0.08, 0.18, bb_squeeze), Strategy("keltner_breakout", "volatility", 0.07, 0.15, keltner_breakout), Strategy("atr_band", "volatility", 0.06, 0.10, atr_band),
    Strategy("triple_confirm_long", "multi", 0.06, 0.15, triple_confirm_long), Strategy("triple_confirm_short", "multi", 0.06, 0.12, triple_confirm_short), Strategy("ichimoku_cloud", "multi", 0.07, 0.15, ichimoku_cloud), Strategy("full_monty", "multi", 0.07, 0.15, full_monty),
]
IDS = [s.id for s in STRATEGIES]


#: Strategies of users, by id, in the order in which they were registered.
PLUGINS: dict[str, Strategy] = {}


def register(strategy: Strategy) -> Strategy:
    """Make a user's strategy known: consensus, back-tests and screens take its id beside the built-in ones."""
    if strategy.id in IDS or not strategy.id.isidentifier():
        raise ValueError(f"a strategy needs an id of its own: {strategy.id!r}")
    PLUGINS[strategy.id] = strategy
    return strategy


def unregister(strategy_id: str) -> None:
    PLUGINS.pop(strategy_id, None)


def from_sql(strategy_id: str, vote: str, *, category: str = "custom", stop_loss=0.06, take_profit=0.12, hold_min=3, hold_max=30) -> Strategy:
    """A strategy from a SQL expression over the factor columns, -2 to 2; nulls are 0."""
    return Strategy(strategy_id, category, stop_loss, take_profit, lambda: F.coalesce(F.expr(f"cast({vote} as int)"), F.lit(0)), hold_min, hold_max)


def known() -> dict[str, Strategy]:
    """All strategies by id, the built-in ones first."""
    return {s.id: s for s in STRATEGIES} | PLUGINS


def registry(spark) -> DataFrame:
    rows_ = [(s.id, s.category, s.stop_loss, s.take_profit, s.hold_min, s.hold_max, i) for i, s in enumerate(known().values())]
    return spark.createDataFrame(rows_, "strategy string, category string, stop_loss double, take_profit double, hold_min int, hold_max int, place int")


def with_strategies(factors: DataFrame, ids=IDS) -> DataFrame:
    """A ``st_<id>`` column per strategy."""
    unknown = set(ids) - set(known())
    if unknown:
        raise KeyError(f"unknown strategies: {sorted(unknown)}")
    chosen = {f"st_{i}": s.rule().cast("int") for i, s in known().items() if i in set(ids)}
    return factors.withColumns(chosen)


def aggregate_signals(df: DataFrame, ids=IDS) -> DataFrame:
    """Score, share of bullish votes and consensus of every bar.

    The share counts the positive score itself as one more vote over as many strategies as there are.
    """
    votes = [col(f"st_{i}") for i in ids]
    score = sum(votes[1:], votes[0])
    up = sum((F.when(v > 0, 1).otherwise(0) for v in votes), F.lit(0)) + F.when(col("score") > 0, 1).otherwise(0)
    label = first_match((col("score") <= -3, "strong_bearish"), (col("score") <= 0, "bearish"), (col("score") <= 3, "bullish"), default="strong_bullish")
    return df.withColumn("score", score).withColumn("bullish_ratio", up / len(ids)).withColumn("consensus", label)


def long_strategies(df: DataFrame) -> DataFrame:
    """(ticker, ts, rn, strategy, vote), one row per bar and strategy."""
    names = [f"st_{i}" for i in IDS]
    return df.select("ticker", "ts", "rn", *names).unpivot(["ticker", "ts", "rn"], names, "strategy", "vote").withColumn("strategy", F.substring("strategy", 4, 100))


def latest_consensus(df: DataFrame, ids=IDS) -> DataFrame:
    """Score, consensus and the strategies that vote on each ticker's last bar."""
    last = aggregate_signals(df, ids).withColumn("newest", F.max("rn").over(whole())).where("rn = newest")
    active = F.filter(F.array(*(F.struct(F.lit(i).alias("strategy"), col(f"st_{i}").alias("vote")) for i in ids)), lambda s: s["vote"] != 0)
    return last.select("ticker", "ts", "score", "bullish_ratio", "consensus", active.alias("active"))
