"""Every service function against what it is made of."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import factors, signals, strategies
from tickloom.plans import api
from tickloom.sources import bars as sources


@pytest.fixture(scope="module")
def bars(spark, data):
    from tickloom.functions.storage import stored

    # one bar a day, so that periods in days mean something
    return stored(sources.bars_events(spark, data).withColumn("ticker", F.upper("ticker")).withColumn("ts", F.expr("timestamp'2023-01-01' + make_interval(0, 0, 0, rn)")), "bars")


@pytest.fixture(scope="module")
def tickers(bars):
    return sorted(r.ticker for r in bars.select("ticker").distinct().collect())


def test_lists(spark, bars, tickers):
    companies = spark.createDataFrame([(t, f"{t} corp", "S") for t in tickers], ["symbol", "company", "sector"])
    assert sorted(r.ticker for r in api.tickers(bars, companies).collect()) == tickers
    assert [r.ticker for r in api.tickers(bars, companies, "CLI").collect()] == ["CLICK"]
    assert api.strategy_registry(spark).count() == 20 and api.signal_registry(spark).count() == 34 and api.factor_registry(spark).count() > 30


def test_analysis_of_one_and_of_all(bars, tickers):
    both = api.analyze(bars, None, "1y")
    assert sorted(r.ticker for r in both.collect()) == tickers and {"alignment", "score", "verdict"} <= set(both.columns)
    one = api.analyze(bars, "CLICK", "1y").collect()
    assert len(one) == 1 and one[0] == both.where("ticker = 'CLICK'").first()
    want = {r.ticker: r.score for r in signals.signal_summary(signals.detect_all(sources.fetch_data(bars, None, "1y"))).collect()}
    assert {r.ticker: r.score for r in api.signal_summary(bars, None, "1y").collect()} == want


def test_backtests(bars, tickers):
    ranked = api.backtest(bars, "CLICK", None, "max", hold="short").collect()
    assert ranked and sorted(r["rank"] for r in ranked) == list(range(1, len(ranked) + 1)) and all(r.n_trades > 0 for r in ranked)
    assert sorted(ranked, key=lambda r: r["rank"]) == sorted(ranked, key=lambda r: (-r.sharpe, r["rank"]))
    some = ranked[0].strategy
    assert {r.strategy for r in api.backtest(bars, None, some, "max").collect()} <= {some}


def test_consensus_and_markers(bars, tickers):
    last = api.consensus(bars, None, "max", history=7).collect()
    assert len(last) == 7 * len(tickers) and {r.back for r in last} == set(range(7))
    marks = api.strategy_markers(bars, "CLICK", "max").collect()
    assert {r.side for r in marks} <= {"buy", "sell"} and max(r.k for r in marks) <= 15


def test_portfolios_and_choices(bars, tickers):
    made = api.portfolios(bars, "CLICK", "max", hold="short").collect()
    assert {r.method for r in made} <= {"equal", "sharpe", "regime", "dynamic", "buy_and_hold"} and any(r.method == "buy_and_hold" for r in made)
    chosen = api.portfolio_choices(bars, None, "max").collect()
    known = {s.id: s.category for s in strategies.STRATEGIES}
    assert chosen and all(r["rank"] <= 5 and r.strategy in known and r.description for r in chosen)
    assert all(known[r.strategy] == r.category for r in chosen)
    best = api.best_strategies(bars, "CLICK", "max", hold="short").collect()
    assert [r["rank"] for r in sorted(best, key=lambda r: r["rank"])] == list(range(1, len(best) + 1))


def test_patterns(bars, tickers):
    own = api.pattern_search(bars, "CLICK", window=10, top=3).collect()
    assert len(own) == 3 and {r.ticker for r in own} == {"CLICK"}
    long = api.pattern_search(bars, "CLICK", window=10, top=3, kind="long").collect()
    assert {(r["start"], r["rank"]) for r in long} == {(r["start"], r["rank"]) for r in own}
    assert api.pattern_search(bars, "CLICK", window=10, top=2, kind="dtw").count() == 2
    others = api.pattern_search(bars, " click ", window=10, top=3, kind="cross").collect()
    assert len(others) == 3 and all(r.target == "CLICK" and r.ticker != "CLICK" for r in others)


def test_daily_rows(bars, tickers):
    rows = api.daily(bars, "CLICK", 5, "close, ma5, no_such_field")
    assert rows.columns == ["ticker", "ts", "close", "ma5"] and rows.count() == 5
    assert set(api.daily(bars, "CLICK", 1).columns) >= {"close", "rsi_14", "obv"}
    at = api.daily_summary(bars, "2023-02-10").collect()
    assert sorted(r.ticker for r in at) == tickers and all(r.ts.strftime("%Y-%m-%d") == "2023-02-10" for r in at)
    assert {"score", "consensus", "signal_score", "verdict"} <= set(api.daily_summary(bars).columns)


def test_quotes_snapshot_and_intraday(spark, bars, tickers):
    assert api.market_snapshot(bars, {"CLICK": "Clicks"}).first().name == "Clicks"
    wanted = [f" {t.lower()} " for t in tickers]
    assert api.quotes(bars, [*wanted, "nobody"]).count() == len(tickers) and api.quotes(bars, wanted, most=2).count() == 2 and api.quotes(bars).count() == len(tickers)
    ticks = bars.select("ticker", "ts", F.col("close").alias("price"), F.lit(1).alias("size"), F.col("rn").alias("at"))
    assert api.intraday(ticks).count() == bars.count()


def test_factors_regimes_reports_and_screens(bars, tickers):
    long = api.latest_factors(bars, "CLICK")
    assert long.count() == factors.latest_factors(factors.add_all_factors(bars.where("ticker = 'CLICK'"))).count()
    info = api.regimes(bars, None, "max").collect()
    assert sorted(r.ticker for r in info) == tickers and all(r.regime and r.description and r.first_ts < r.last_ts for r in info)
    assert api.report(bars, "CLICK", "max").first().markdown.startswith("# CLICK")
    rows = api.screen(bars, period="max", hold="short").collect()
    one = api.screen_summary(bars, period="max", hold="short").first()
    assert one.n == len(rows) and one.n == one.n_bullish + one.n_bearish + one.n_neutral
    bullish = [r.ticker for r in rows if r.consensus in ("bullish", "strong_bullish")]
    assert one.best == ", ".join(bullish[:10])
