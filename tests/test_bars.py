"""Micro-fixtures and invariants of the bar operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.frames import EMA_BLOCK, with_ema
from tickloom.operators import backtest as bt
from tickloom.operators import chart_data, factors, indicators, news, portfolio, signals, similarity, strategies
from tickloom.operators.trendlines import fit, with_trendlines
from tickloom.sources import bars as sources
from tickloom.sources import dimensions


def make(spark, close, open=None, high=None, low=None, volume=None, ticker="A"):
    n = len(close)
    open = close if open is None else open
    high = [None if c is None else max(c, o or c) for c, o in zip(close, open)] if high is None else high
    low = [None if c is None else min(c, o or c) for c, o in zip(close, open)] if low is None else low
    ts = pd.date_range("2024-01-01", periods=n)
    f = lambda x: None if x is None else float(x)
    rows = [(ticker, ts[i].to_pydatetime(), f(open[i]), f(high[i]), f(low[i]), f(close[i]), 100 if volume is None else volume[i]) for i in range(n)]
    return sources.numbered(spark.createDataFrame(rows, sources.SCHEMA))


def test_ema_matches_pandas_over_blocks(spark):
    n = EMA_BLOCK * 2 + 300
    df = spark.range(n).select(F.lit("A").alias("ticker"), F.col("id").cast("int").alias("rn"), (F.rand(3) * 100).alias("close"))
    got = with_ema(df, a=("close", 9), b=("close", 100), c=("close", 400)).toPandas().sort_values("rn")
    for name, span in (("a", 9), ("b", 100), ("c", 400)):
        assert np.abs(got[name] - got["close"].ewm(span=span, adjust=False).mean()).max() < 1e-9


@pytest.mark.parametrize("case", ["constant", "single", "zero_volume", "null_close"])
def test_edge_bars_dont_fail(spark, case):
    bars = {
        "constant": lambda: make(spark, [5.0] * 70), "single": lambda: make(spark, [5.0]),
        "zero_volume": lambda: make(spark, list(range(1, 31)), volume=[0] * 30), "null_close": lambda: make(spark, [1.0, None, 3.0] * 10),
    }[case]()
    df = strategies.with_strategies(signals.detect_all(factors.add_all_factors(bars)))
    out = strategies.aggregate_signals(df).toPandas()
    assert len(out) == bars.count()
    floats = out.select_dtypes("float")
    assert not np.isinf(floats.to_numpy()).any()
    if case == "constant":
        assert out["rsi_14"].isna().all() and (out["bb_std"].dropna() == 0).all()
    assert (out["st_atr_band"] == 0).all()


def test_percentile_ranks_and_indices_are_bounded(spark, data):
    out = factors.add_all_factors(sources.bars_events(spark, data)).toPandas()
    assert out["vol_rank"].dropna().between(0, 1).all() and out["bb_squeeze_rank"].dropna().between(0, 1).all()
    assert out["di_plus"].dropna().between(0, 100).all() and out["adx_14"].dropna().between(0, 100 + 1e-9).all()


def test_no_look_ahead(spark, data):
    bars = sources.bars_events(spark, data)
    cut = bars.where("rn < 80")
    cols = [c for g in factors.GROUPS.values() for c in g if c != "ichimoku_lag"]
    a = factors.add_all_factors(bars).where("rn < 80").select("ticker", "rn", *cols).toPandas().sort_values(["ticker", "rn"]).reset_index(drop=True)
    b = factors.add_all_factors(cut).select("ticker", "rn", *cols).toPandas().sort_values(["ticker", "rn"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)


def test_candles(spark):
    falling = [20 - i * 0.5 for i in range(20)]
    close, open = [*falling, 9.0, 11.5], [*[c + 0.4 for c in falling], 10.0, 8.9]
    out = signals.detect_all(make(spark, close, open, volume=[100] * 21 + [500])).toPandas().sort_values("rn")
    assert out["signal_bullish_engulfing"].iloc[-1] == 2 and out["signal_bearish_engulfing"].sum() == 0
    soldiers = signals.detect_all(make(spark, [1, 2, 3, 4, 5], [0.5, 1.5, 2.5, 3.5, 4.5])).toPandas().sort_values("rn")
    assert soldiers["signal_three_white_soldiers"].tolist() == [0, 0, 1, 1, 1]


P = dict(stop=0.08, target=0.15, hold_min=3, hold_max=5, capital=1000.0, commission=0.0, worst_case=False, limit_pct=0.0)


def run(close, votes, high=None, low=None, **changes):
    close = np.array(close, float)
    return bt.fold(close, close if high is None else np.array(high, float), close if low is None else np.array(low, float), votes, **(P | changes))


@pytest.mark.parametrize(
    ("close", "votes", "reason", "exit"),
    [
        ([10, 10, 9], [1, 0, 0], "stop_loss", 2), ([10, 10, 12], [1, 0, 0], "take_profit", 2), ([10] * 8, [1] + [0] * 7, "timeout", 5),
        ([10] * 6, [1, -1, -1, -1, 0, 0], "signal", 3), ([10, 10], [1, 0], "force_close", 1),
    ],
)
def test_exits(close, votes, reason, exit):
    _, trades, _ = run(close, votes)
    assert (trades[0][6], trades[0][1]) == (reason, exit)


def test_fold_options():
    equity, trades, cash = run([10, 12, 10], [1, 0, 1], target=0.0, high=[11, 12, 10], low=[9, 11, 9], worst_case=True)
    assert trades[0][2] == 11.0 and trades[0][3] == 9.0 and equity[-1] == cash
    assert run([10, 20, 20], [0, 1, 0], limit_pct=0.5)[1] == []
    assert run([], [])[1] == []


def test_votes_fold_is_grouped(spark, data):
    voted = strategies.with_strategies(factors.add_all_factors(sources.bars_events(spark, data)))
    out = bt.rank_strategies(bt.backtest_all(voted, profile="short")).toPandas()
    assert (out["win_rate"].between(0, 1)).all() and (out["max_drawdown"] <= 0).all()
    methods = portfolio.analyze_portfolio(voted, profile="short").toPandas().set_index(["ticker", "method"])
    same = [methods.xs(m, level="method")["total_return"] for m in ("equal", "dynamic")]
    assert np.allclose(same[0], same[1])


def test_obv_from_zero_base_is_infinite(spark):
    out = strategies.with_strategies(factors.add_all_factors(make(spark, [10.0, *[9.99 + 0.001 * i for i in range(20)]]))).toPandas().sort_values("rn")
    assert out["obv"].iloc[0] == 0 and out["st_obv_divergence"].isin([-1, 0, 1]).all()


def test_dtw():
    assert similarity.dtw_distance([1, 2, 3], [1, 2, 3]) == 0 and similarity.dtw_distance([0, 0], [1, 1]) == 2


def test_kelly(spark):
    got = spark.createDataFrame([(0.6, 2.0, 1.0), (0.4, 0.0, 1.0), (0.9, 9.0, 1.0), (0.5, 1.0, 0.0)], "w double, a double, b double").select(portfolio.kelly_position(F.col("w"), F.col("a"), F.col("b")).alias("k"))
    assert [round(r.k, 6) for r in got.collect()] == [0.4, 0.0, 0.5, 0.0]


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([("A", "2024-01-02", 1.0, float("nan"))], ["Symbol", " Date ", "Open", "Close"])
    assert sources.normalise_columns(raw).columns == ["ticker", "ts", "open", "close", "adj_close"]
    raw.write.parquet(str(tmp_path / "b"))
    row = sources.read_bars(spark, str(tmp_path / "b")).first()
    assert row.close is None and row.adj_close is None and row.ts.day == 2
    short, long = make(spark, [1.0, 2.0]), make(spark, [1.0, 2.0, 3.0])
    assert sources.with_fallback(short, long, "2y").count() == 3 and sources.with_fallback(short, long, "1y").count() == 2
    names = spark.createDataFrame([("A", "Alpha" * 10, "S")], ["symbol", "company", "sector"])
    assert len(sources.ticker_list(short, names, "alp").first().name) == 30


def test_dimensions(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>BRK.B</td><td><b>X &amp; Y</b></td></tr><tr><th>q</th></tr></table>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in dimensions.html_cells(pages).orderBy("row", "cell").collect()] == [(1, 0, 0, "BRK.B"), (1, 0, 1, "X & Y"), (1, 1, 0, "q")]
    dim = dimensions.companies(spark.createDataFrame([("BRK.B", "x", "nan"), ("BRK.B", "x", "nan"), ("C", "y", "long enough text")], ["Symbol", "Company", "BusinessSummary"]))
    assert dim.count() == 2 and dimensions.missing_summaries(dim).first().symbol == "BRK-B"
    assert {r.symbol: r.summary for r in dimensions.enrich(dim, spark.createDataFrame([("BRK-B", "filled")], ["symbol", "summary"])).collect()} == {"BRK-B": "filled", "C": "long enough text"}


def test_news(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"event_keywords": [{"keywords": ["rate cut", "Fed"], "sector": "F", "etf": "XLF", "direction": "positive", "weight": 1.0}]}')
    words = news.keyword_dimension(dimensions.read_mapping(spark, str(tmp_path / "m.json")))
    texts = spark.createDataFrame([(1, "The FED signals a Rate Cut"), (2, "nothing"), (3, None)], "doc_id long, text string")
    hits = news.match_keywords(texts, words)
    assert hits.count() == 2
    trend = spark.createDataFrame([("XLF", "up")], ["ticker", "trend"])
    scored = news.news_scores(hits, trend)
    assert [tuple(r) for r in scored.select("etf", "score").collect()] == [("XLF", 2)]
    stocks = spark.createDataFrame([("JPM", "XLF", 0.7, 0.01)], ["ticker", "etf", "win_rate", "mean"])
    assert news.three_way(scored, trend, stocks).first().judgement == "strong_bullish"


def test_trend_labels(spark):
    rising = make(spark, [float(i) for i in range(1, 80)])
    out = indicators.trend_analysis(rising).first()
    assert out.alignment == "bull" and out.overall == "up"
    assert indicators.calc_slope(rising, "close").first().slope > 0


@pytest.mark.parametrize(
    ("row", "regime", "score"),
    [
        ((110.0, 100.0, 100.0, 4, 30.0, 70.0), "trend_up", 100.0),  # both 100: the first counts
        ((101.0, 100.0, 100.0, 4, 10.0, 50.0), "range", 45.0),  # 2 * 10 + 50 * 0.5, more than the 30 of clear averages
        ((99.0, 100.0, 100.0, -4, None, 50.0), "trend_down", 30.0),  # no adx: 25 for the range, 30 for the order
        ((99.0, 100.0, 100.0, 0, None, 35.0), "range", 35.0),  # 25 + 10; a bottom has 2 * 5 + 10
        ((90.0, 100.0, 100.0, -2, 15.0, 20.0), "bottom", 100.0),  # 40 + 100, capped
    ],
)
def test_market_regimes_by_hand(spark, row, regime, score):
    schema = "ticker string, ts timestamp, rn int, px double, ma20 double, ma60 double, ma_ribbon_score int, adx_14 double, rsi_14 double, bb_width double"
    df = spark.createDataFrame([("A", pd.Timestamp("2024-01-01").to_pydatetime(), 0, *row, 0.1)], schema)
    got = portfolio.detect_market_regime(df).first()
    assert (got.regime, round(got.score, 6)) == (regime, score)


def test_levels_by_hand(spark):
    close = [10.0] * 25
    low = [9.0] * 25
    low[22] = 8.0
    got = indicators.find_support_resistance(make(spark, close, high=[12.0] * 25, low=low)).first()
    assert (got.support, got.resistance, got.support_pct, got.resistance_pct) == (8.0, 12.0, 25.0, 20.0)
    # a low pivot at 8 and a high pivot at 9, both under the close: only lows make supports
    high = [10.5] * 40
    low = [9.9 + i / 1000 for i in range(40)]
    low[10], high[25] = 8.0, 30.0
    levels = chart_data.support_resistance_clusters(make(spark, [10.0] * 40, high=high, low=low)).collect()
    assert ("support", 8.0) in [(r.side, r.level) for r in levels] and ("resistance", 30.0) in [(r.side, r.level) for r in levels]
    assert all(r.level < 10 for r in levels if r.side == "support") and all(r.level > 10 for r in levels if r.side == "resistance")


def test_patterns_by_hand(spark):
    label = lambda xs: [r.pattern for r in similarity.pattern_features(make(spark, xs)).collect()]
    assert label([100.0, 60.0] * 15) == ["choppy_down"] and label([60.0, 100.0] * 15) == ["choppy_up"]
    assert label([float(i) for i in range(1, 31)]) == ["strong_uptrend"] and label([1.0] * 29) == []


def test_sleeves_run_on_their_own_capital(spark):
    close = [30_000.0, 31_000.0, 33_000.0, 33_000.0]
    df = make(spark, close).withColumns({f"st_{i}": F.when((F.col("rn") == 0) & F.lit(i == "rsi_extreme"), 1).otherwise(0) for i in bt.IDS})
    given = spark.createDataFrame([("A", "small", "rsi_extreme", 20_000.0), ("A", "large", "rsi_extreme", 100_000.0), ("A", "idle", "ema_cross", 50_000.0)], "ticker string, run string, strategy string, capital double")
    got = {r.run: r for r in bt.run_sleeves(df, given, dict.fromkeys(bt.IDS, (0.0, 0.0, 1, 10))).collect()}
    assert got["small"].trades == [] and got["small"].final_cash == 20_000.0 and got["idle"].final_cash == 50_000.0
    assert len(got["large"].trades) == 1 and abs(got["large"].final_cash - (100_000 - 3 * 30_000 * 1.001 + 3 * 33_000 * 0.999)) < 1e-6
    total = portfolio.parallel_portfolio(bt.run_sleeves(df, given.where("run = 'large'"), dict.fromkeys(bt.IDS, (0.0, 0.0, 1, 10)))).first()
    assert total.n_trades == 1 and total.win_rate == 0.5 and total.avg_hold == 3.0


def test_size_scales_entries(spark):
    one = make(spark, [10.0, 10.0, 12.0]).select("ticker", F.lit("x").alias("strategy"), "rn", "close", "high", "low", F.when(F.col("rn") == 0, 1).otherwise(0).alias("vote"))
    cash = [bt.run_backtest(one, {"x": (0.0, 0.0, 1, 9)}, capital=1000.0, commission=0.0, size=s).first().final_cash for s in (1.0, 0.5)]
    assert cash == [1000 + 95 * 2, 1000 + 47 * 2]


def test_volatility_without_risk_takes_the_largest_position(spark):
    got = portfolio.volatility_targeting(make(spark, [5.0] * 30)).orderBy("rn").collect()
    assert got[0].position == 0.5 and got[-1].position == 1.0


def test_csv_sink_resumes(spark, tmp_path):
    rows = lambda n: spark.range(n).select(F.col("id").cast("string").alias("symbol"), F.lit("s").alias("summary"))
    path = str(tmp_path / "out")
    assert dimensions.append_csv(rows(3), path, "symbol") == 3 and dimensions.append_csv(rows(5), path, "symbol") == 2
    assert sorted(r.symbol for r in spark.read.option("header", True).csv(path).collect()) == list("01234")


def test_registries(spark):
    known = {r.factor: r for r in factors.factor_registry(spark).collect()}
    assert known["rsi_14"].panel == "sub_momentum" and known["ma5"].category == "base" and known["cci_20"].panel is None
    assert len(known) == len(factors.factor_registry(spark).collect()) and {n for names in factors.PANELS.values() for n in names} <= set(known)
    assert signals.registry(spark).count() == 34 and strategies.registry(spark).count() == 20


@pytest.mark.parametrize("y", [0.01, 0.1, 1e6 / 3])
def test_level_line_fits_its_points(spark, y):
    points = [(float(x), y) for x in (101, 108, 117, 125, 132)]
    got = spark.createDataFrame([(points,)], "p array<struct<x:double,y:double>>").select(fit(F.col("p")).alias("f")).select("f.*").first()
    assert tuple(got) == (0.0, y, 1.0)


def test_trend_lines_through_equal_lows(spark):
    low = [3.0 if i % 8 == 4 else 5.0 + abs(i % 8 - 4) for i in range(80)]
    bars = make(spark, [x + 1 for x in low], low=low, high=[x + 2 for x in low])
    assert [tuple(r) for r in with_trendlines(bars).where("rn = 79").select("up_line.slope", "up_line.r2", "up_line.value").collect()] == [(0.0, 1.0, 3.0)]
    assert [(r["slope"], r["intercept"], r["r2"]) for r in chart_data.trend_lines(bars).where("side = 'up'").collect()] == [(0.0, 3.0, 1.0)]


def test_display_strings_round_as_printf(spark):
    shown = ("total_return", "annual_return", "max_drawdown", "avg_return", "win_rate", "sharpe", "profit_factor", "avg_hold")
    rows = [(0.00125, -0.00125, -0.5, 1.61644, 0.4125, 0.125, float("inf"), 2.5), (12.345, 0.0, -1e-9, 1234567.0, 0.4375, -0.375, 1.005, 3.5)]
    df = spark.createDataFrame([("A", "s", 80, *r) for r in rows], "ticker string, strategy string, n_trades int, " + ", ".join(f"{c} double" for c in shown))
    said = lambda r: (*(f"{100 * x:.2f}%" for x in r[:4]), f"{100 * r[4]:.1f}%", f"{r[5]:.2f}", "Infinity" if r[6] == float("inf") else f"{r[6]:.2f}", f"{r[7]:.0f}")
    got = bt.formatted(df).select(*shown).collect()
    assert sorted(map(tuple, got)) == sorted(map(said, rows))


def test_keyword_scan_holds_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["steel " + "x" * 10_000] * 2000)], names=["id", "low"])
    tracemalloc.start()
    found = [len(b) for b in news._scan(iter([batch]), ["", "oil", "steel"], "test")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [4000] and peak < 5_000_000


def test_keywords_leave_the_batch_size_of_the_session(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    texts = spark.createDataFrame([(1, "Steel"), (2, None), (3, "oil steel")], "doc_id long, text string")
    keywords = spark.createDataFrame([("steel", "Materials", "XLB", "positive", 1.0)], "keyword string, sector string, etf string, direction string, weight double")
    assert sorted(r["doc_id"] for r in news.match_keywords(texts, keywords).collect()) == [1, 3]
    assert spark.conf.get(name) == before


@pytest.mark.parametrize(("x", "y"), [((56, 50, 44, 38, 32), (0.04, 0.01, 0.01, 0.01, 0.01)), ((56, 50, 44, 38, 32), (426.24, 426.24, 426.24, 426.24, 477.11)), ((30, 20, 10), (0.02, 0.05, 0.01)), ((52, 41, 33), (7.5, 7.5, 7.5))])
def test_fit_at_the_limit_falls_as_in_sql(spark, x, y):
    import duckdb

    # from the last pivot on, as the SQL of the trend lines has them
    values = ", ".join(f"({i}, {j}::DOUBLE)" for i, j in zip(x, y, strict=True))
    want = duckdb.connect().execute(f"SELECT regr_slope(y, x), regr_r2(y, x) > 0.5 FROM (VALUES {values}) AS t(x, y)").fetchone()
    points = [(float(i), j) for i, j in zip(x, y, strict=True)][::-1]
    got = spark.createDataFrame([(points,)], "p array<struct<x:double,y:double>>").select(fit(F.col("p")).alias("f")).select("f.slope", F.col("f.r2") > 0.5).first()
    assert got[0] == pytest.approx(want[0], abs=1e-12) and got[1] == want[1]
