"""What the routes of a bar service return, as DataFrames over all or some tickers.

Every function takes bars (ticker, ts, rn, open, high, low, close, volume) and an
optional ticker; without one it answers for all tickers in one plan.  Serve rows with
``sources.dimensions.as_json``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import whole
from ..operators import backtest as bt
from ..operators import chart_data, factors, indicators, portfolio, screener, series_search, signals, similarity, stats, strategies
from ..sources import bars as sources

col = F.col


def _of(bars: DataFrame, ticker: str | None, period: str = "max") -> DataFrame:
    return sources.fetch_data(bars, ticker, period)


def tickers(bars: DataFrame, companies: DataFrame, q: str = "") -> DataFrame:
    return sources.ticker_list(bars, companies, q)


def analyze(bars: DataFrame, ticker: str | None = None, period: str = "6mo") -> DataFrame:
    """Trend report and signal summary."""
    some = _of(bars, ticker, period)
    summary = signals.signal_summary(signals.detect_all(some))
    return indicators.trend_analysis(some).join(summary, "ticker")


def signal_summary(bars: DataFrame, ticker: str | None = None, period: str = "6mo") -> DataFrame:
    return signals.signal_summary(signals.detect_all(_of(bars, ticker, period)))


def strategy_registry(spark) -> DataFrame:
    return strategies.registry(spark)


def factor_registry(spark) -> DataFrame:
    return factors.factor_registry(spark)


def signal_registry(spark) -> DataFrame:
    return signals.registry(spark)


def _voted(bars, ticker, period) -> DataFrame:
    return strategies.with_strategies(factors.add_all_factors(_of(bars, ticker, period)))


def backtest(bars: DataFrame, ticker: str | None = None, strategy: str | None = None, period: str = "1y", hold: str | None = "medium", capital: float = 100_000.0, worst_case: bool = True, limit: float = 0.0) -> DataFrame:
    """One strategy with its own limits, or all with a holding profile, ranked."""
    ids = strategies.IDS if strategy is None else [strategy]
    summary = bt.backtest_all(_voted(bars, ticker, period), profile=None if strategy else hold, ids=ids, capital=capital, worst_case=worst_case, limit_pct=limit)
    return bt.rank_strategies(summary)


def consensus(bars: DataFrame, ticker: str | None = None, period: str = "6mo", history: int = 60) -> DataFrame:
    """Score and consensus of the last bars."""
    df = strategies.aggregate_signals(_voted(bars, ticker, period))
    return indicators.last_bars(df, history).select("ticker", "ts", "back", "score", "bullish_ratio", "consensus")


def portfolios(bars: DataFrame, ticker: str | None = None, period: str = "1y", hold: str = "medium", worst_case: bool = True) -> DataFrame:
    return portfolio.analyze_portfolio(_voted(bars, ticker, period), profile=hold, worst_case=worst_case)


def portfolio_choices(bars: DataFrame, ticker: str | None = None, period: str = "1y") -> DataFrame:
    """What the regime run of the portfolios holds, and the regime."""
    return portfolio.regime_choices(_voted(bars, ticker, period))


def strategy_markers(bars: DataFrame, ticker: str | None = None, period: str = "6mo") -> DataFrame:
    return chart_data.signal_markers(_voted(bars, ticker, period))


def pattern_search(bars: DataFrame, ticker: str, window: int = 30, top: int = 5, kind: str = "history") -> DataFrame:
    """Similar windows of the ticker's own past (history, long for series and windows of any length, dtw by time warping), or other tickers' last windows."""
    own = {"history": similarity.search_historical, "long": series_search.search_by_products, "dtw": series_search.search_by_dtw}
    if kind in own:
        return own[kind](_of(bars, ticker, "max"), window=window, top=top)
    target = bars.select("ticker").where(col("ticker") == ticker.strip().upper()).distinct()
    return similarity.search_cross(bars, target, window=window, top=top)


def daily(bars: DataFrame, ticker: str | None = None, limit: int = 100, fields: str = "") -> DataFrame:
    """The last ``limit`` rows with every factor, or the named fields that exist, to four places."""
    df = factors.add_all_factors(_of(bars, ticker))
    wanted = [f.strip() for f in fields.split(",") if f.strip() in df.columns]
    rows = indicators.last_bars(df, limit)
    return portfolio.rounded(rows.select("ticker", "ts", *(c for c in (wanted or df.columns) if c not in ("ticker", "ts"))))


def daily_summary(bars: DataFrame, date: str | None = None, ticker: str | None = None) -> DataFrame:
    """Factors at a date (by default the last), beside the signals and consensus of the latest bar."""
    df = factors.add_all_factors(_of(bars, ticker))
    at = df if date is None else df.where(F.to_date("ts") <= F.lit(date).cast("date"))
    row = at.withColumn("newest", F.max("rn").over(whole())).where("rn = newest").drop("newest")
    latest = strategies.latest_consensus(strategies.with_strategies(df)).select("ticker", "score", "consensus")
    net = signals.signal_summary(signals.detect_all(_of(bars, ticker))).select("ticker", col("score").alias("signal_score"), "verdict")
    return row.join(latest, "ticker").join(net, "ticker")


def market_snapshot(bars: DataFrame, names: dict[str, str]) -> DataFrame:
    return sources.market_snapshot(bars, names)


def intraday(ticks: DataFrame, interval: str = "1 hour") -> DataFrame:
    return sources.fetch_intraday(ticks, interval)


def quotes(bars: DataFrame, wanted: list[str] | None = None, most: int = 20) -> DataFrame:
    """Latest quotes; a batch names at most ``most`` tickers, unknown ones are left out."""
    out = sources.fetch_quote(bars)
    return out if wanted is None else out.where(col("ticker").isin([t.strip().upper() for t in wanted][:most]))


def latest_factors(bars: DataFrame, ticker: str | None = None) -> DataFrame:
    return factors.latest_factors(factors.add_all_factors(_of(bars, ticker)))


def regimes(bars: DataFrame, ticker: str | None = None, period: str = "1y", hold: str = "medium") -> DataFrame:
    """Span of the bars and market regime."""
    return portfolio.regime_info(factors.add_all_factors(_of(bars, ticker, period)), hold)


def best_strategies(bars: DataFrame, ticker: str | None = None, period: str = "1y", hold: str = "medium") -> DataFrame:
    """The strategies that the portfolios choose from."""
    return portfolio.top_strategies(_voted(bars, ticker, period), profile=hold)


def screen_summary(bars: DataFrame, n: int = 100, period: str = "6mo", hold: str = "medium", show: int = 30) -> DataFrame:
    """Counts, means and first bullish tickers of a screen."""
    return screener.summary(screener.screen(bars, n, show, period=period, profile=hold))


def screen(bars: DataFrame, n: int = 100, period: str = "6mo", hold: str = "medium", show: int = 30) -> DataFrame:
    """The best tickers by total points."""
    return screener.screen(bars, n, show, period=period, profile=hold)


def report(bars: DataFrame, ticker: str | None = None, period: str = "2y") -> DataFrame:
    """Markdown reports of signals."""
    return stats.full_report(signals.detect_all(_of(bars, ticker, period)))
