"""Every ticker through the whole analysis in one partitioned plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import whole
from ..functions.storage import stored
from ..sources.bars import fetch_data
from . import backtest as bt
from . import portfolio as pf
from .factors import add_all_factors
from .strategies import aggregate_signals, with_strategies

col = F.col

# Points by consensus.
POINTS = {"strong_bullish": 30, "bullish": 15, "bearish": -15, "strong_bearish": -30}


def candidates(bars: DataFrame, n: int = 100, days: int = 180) -> DataFrame:
    """The tickers with the highest last close within the days before the newest bar of all."""
    newest = bars.agg(F.max("ts").alias("newest"))
    recent = bars.join(F.broadcast(newest), F.expr(f"ts >= newest - interval {days} days"))  # one row
    return recent.groupBy("ticker").agg(F.max_by("close", "ts").alias("close")).orderBy(F.desc("close"), "ticker").limit(n)


def analyze(bars: DataFrame, *, period="6mo", profile="medium", worst_case=True, least_bars=50, min_trades=3, top=5, ids=bt.IDS) -> DataFrame:
    """One row per ticker with at least ``least_bars`` bars in the period: consensus, signals, regime, best strategies, portfolio return.

    Bullish and bearish signals are 0 for every ticker: the screen looks for recent
    signals where there are none.  The portfolio blends the votes of the best
    strategies and returns what its final cash says.  The votes are stored, the
    strategies folded once, the blend once.
    """
    some = fetch_data(bars, None, period).withColumn("n_bars", F.count(F.lit(1)).over(whole())).where(col("n_bars") >= least_bars)
    voted = with_strategies(add_all_factors(some), ids)
    df = stored(voted.select("ticker", "ts", "rn", "n_bars", "close", "high", "low", "px", "ma20", "ma60", "ma_ribbon_score", "adx_14", "rsi_14", "bb_width", *(f"st_{i}" for i in ids)), "votes")
    last = aggregate_signals(df, ids).withColumn("newest", F.max("rn").over(whole())).where("rn = newest").select("ticker", "n_bars", "close", "score", "consensus")
    limits = bt._params(ids, profile)
    ranked = bt.rank_strategies(bt.summarise(bt.run_strategies(df, {"all": limits}, worst_case=worst_case, curve=False)).where(col("n_trades") >= min_trades)).where(col("rank") <= top)
    ranked = stored(ranked.select("ticker", "strategy", "rank", "sharpe"), "ranked")
    best = ranked.groupBy("ticker").agg(F.avg("sharpe").alias("avg_sharpe"), F.min_by("strategy", "rank").alias("best_strategy"), F.max("sharpe").alias("best_sharpe"))
    blend = bt.run_backtest(pf.blended_votes(df, ranked, ids), {"portfolio": limits[ids[0]]}, worst_case=worst_case, curve=False)
    returns = bt.summarise(blend).select("ticker", (col("total_return") * 100).alias("pf_return"))
    regime = pf.detect_market_regime(df).select("ticker", "regime", col("score").alias("regime_score"))
    out = last.join(best, "ticker", "left").join(returns, "ticker", "left").join(regime, "ticker", "left")
    two = lambda c: F.round(F.coalesce(col(c), F.lit(0.0)), 2).alias(c)
    zero = lambda c: F.lit(0).alias(c)
    return out.select(
        "ticker", "n_bars", F.round("close", 2).alias("close"), "consensus", "score", zero("signal_bull"), zero("signal_bear"), zero("signal_net"),
        "regime", F.round("regime_score", 0).alias("regime_score"), two("avg_sharpe"), two("pf_return"), "best_strategy", two("best_sharpe"),
    )


def score(rows: DataFrame) -> DataFrame:
    """Total points: consensus, votes, Sharpe, portfolio return, signals, regime."""
    points = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    total = F.coalesce(F.element_at(points, col("consensus")), F.lit(0)) + 2 * col("score") + 10 * col("avg_sharpe") + 0.5 * col("pf_return") + 2 * col("signal_net") + 0.5 * col("regime_score")
    return rows.withColumn("total", F.round(total, 1))


def screen(bars: DataFrame, n: int = 100, show: int = 30, **options) -> DataFrame:
    """The best ``show`` of the ``n`` candidates.  The bars are made once and stored."""
    bars = stored(bars, "bars")
    chosen = bars.join(candidates(bars, n).select("ticker"), "ticker", "left_semi")
    return score(analyze(chosen, **options)).orderBy(F.desc("total"), "ticker").limit(show)


def summary(rows: DataFrame, most: int = 10) -> DataFrame:
    """One row about the rows of a screen: how many are bullish, bearish and neutral, the means, and the first ``most`` bullish tickers."""
    rows = stored(rows, "screened")
    bullish = col("consensus").isin("strong_bullish", "bullish")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    best = rows.where(bullish).orderBy(F.desc("total"), "ticker").limit(most).agg(F.array_sort(F.collect_list(F.struct((-col("total")).alias("order"), "ticker"))).alias("best"))
    out = rows.agg(
        F.count("*").alias("n"), n(bullish).alias("n_bullish"), n(col("consensus").isin("strong_bearish", "bearish")).alias("n_bearish"), n(col("consensus") == "neutral").alias("n_neutral"),
        F.avg("total").alias("mean_total"), F.avg("pf_return").alias("mean_return"), F.avg("avg_sharpe").alias("mean_sharpe"),
    )
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731 - both have a single row
    return one(out).join(one(best.select(F.array_join(F.transform("best", lambda x: x["ticker"]), ", ").alias("best"))), "one").drop("one")
