"""Time joins, long series, window search, keyword sets and the event-to-event fold, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import frames, long_series
from tickloom.operators import asof, intervals, news, series_search, similarity
from tickloom.operators import backtest as bt


# ---- as-of
def partner_brute(left, right, direction, exact, tolerance):
    out = Counter()
    for k, t, i in left:
        here = [(rt, tie, v) for rk, rt, tie, v in right if None not in (k, t, rk, rt) and rk == k]
        back = [x for x in here if x[0] < t or (exact and x[0] == t)] if t is not None else []
        ahead = [x for x in here if x[0] > t or (exact and x[0] == t)] if t is not None else []
        b, f = max(back, default=None), min(ahead, default=None)
        if tolerance is not None:
            b, f = (x if x and abs(x[0] - t) <= tolerance else None for x in (b, f))
        one = b if direction == "backward" else f if direction == "forward" else b if b and (not f or t - b[0] <= f[0] - t) else f
        out[k, t, i, *((one[0], one[2]) if one else (None, None))] += 1
    return out


@pytest.mark.parametrize("bucket_rows", [40, 10**6])
@pytest.mark.parametrize(("direction", "exact", "tolerance"), [("backward", True, None), ("backward", False, 9), ("forward", True, 5), ("forward", False, None), ("nearest", True, None), ("nearest", False, 4)])
def test_asof_join(spark, direction, exact, tolerance, bucket_rows):
    draw = random.Random(1)
    key = lambda: draw.choice(["hot", "hot", "hot", "b", "c", None])
    time = lambda: draw.choice([None, *range(0, 400, 3)]) if draw.random() < 0.9 else 100
    left = [(key(), time(), i) for i in range(150)] + [("hot", 33, 1), ("hot", 33, 1), ("left only", 5, 0)]
    right = [(key(), time(), tie, float(tie)) for tie in range(120)]
    l, r = spark.createDataFrame(left, "k string, t long, l int"), spark.createDataFrame(right, "k string, rt long, tie int, v double")
    got = asof.asof_join(l, r, by=["k"], left_on="t", right_on="rt", columns=["v"], direction=direction, exact=exact, tolerance=tolerance, tie="tie", bucket_rows=bucket_rows)
    assert got.columns == ["k", "t", "l", "rt", "v"]
    assert Counter(map(tuple, got.collect())) == partner_brute(left, right, direction, exact, tolerance)
    assert asof.asof_join(l.limit(0), r, by=["k"], left_on="t", right_on="rt", columns=["v"], direction=direction).count() == 0
    assert asof.asof_join(l, r.limit(0), by=["k"], left_on="t", right_on="rt", columns=["v"], direction=direction).where("v is null").count() == len(left)


# ---- intervals
@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
@pytest.mark.parametrize("width", [None, 1.0, 7.0])
def test_interval_join(spark, closed, width):
    draw = random.Random(2)
    spans = []
    for i in range(120):
        a = draw.randrange(-50, 1000)
        spans.append((draw.choice(["a", "b", None]), a if draw.random() < 0.95 else None, a + draw.choice([0, 1, 3, 4, 15, 16, 17, 64, 900, -2]), i))
    points = [(draw.choice(["a", "b", "c", None]), draw.choice([None, *range(-60, 1100)]), i) for i in range(200)] + [("a", 7, 5), ("a", 7, 5)]
    got = intervals.interval_join(spark.createDataFrame(points, "k string, at long, p int"), spark.createDataFrame(spans, "k string, a long, b long, s int"), by=["k"], at="at", start="a", end="b", closed=closed, width=width)
    low = (lambda a, p: a <= p) if closed in ("both", "left") else (lambda a, p: a < p)
    high = (lambda p, b: p <= b) if closed in ("both", "right") else (lambda p, b: p < b)
    want = Counter((k, at, p, a, b, s) for k, at, p in points for k2, a, b, s in spans if k == k2 and None not in (k, at, a) and b >= a and low(a, at) and high(at, b))
    assert Counter((r.k, r["at"], r.p, r.a, r.b, r.s) for r in got.collect()) == want


def test_overlap_join(spark):
    draw = random.Random(3)
    spans = lambda n: [(draw.choice("ab"), a := draw.randrange(300), a + draw.choice([0, 1, 5, 40, 250, -1]), i) for i in range(n)]
    x, y = spans(70), spans(60)
    got = intervals.overlap_join(spark.createDataFrame(x, "k string, a long, b long, i int"), spark.createDataFrame(y, "k string, c long, d long, j int"), by=["k"], left_span=("a", "b"), right_span=("c", "d"))
    want = Counter((k, i, j) for k, a, b, i in x for k2, c, d, j in y if k == k2 and a <= b and c <= d and a <= d and c <= b)
    assert Counter((r.k, r.i, r.j) for r in got.collect()) == want


# ---- long series
def series(spark, n=700, tickers=("A", "B")):
    draw = random.Random(4)
    rows = [(t, i, None if draw.random() < 0.05 else draw.uniform(-5, 9), draw.uniform(1, 3)) for t in tickers for i in range(n if t == "A" else 37)]
    return spark.createDataFrame(rows, "ticker string, rn int, x double, y double")


@pytest.mark.parametrize("block", [16, 100, 2048])
def test_scan_equals_windows(spark, block):
    df = series(spark)
    got = long_series.scan(long_series.with_previous(df, block=block, before="x"), sums={"total": F.col("x")}, maxima={"peak": F.col("x")}, emas={"e5": (F.col("y"), 5), "e50": (F.col("y"), 50)}, block=block)
    want = frames.with_ema(df, w5=("y", 5), w50=("y", 50)).withColumns({"total_w": F.sum("x").over(frames.running()), "peak_w": F.max("x").over(frames.running()), "before_w": F.lag("x").over(frames.ordered())})
    both = got.join(want.drop("x", "y"), ["ticker", "rn"]).collect()
    assert len(both) == df.count()
    close = lambda a, b: (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    assert all(close(r.total, r.total_w) and close(r.peak, r.peak_w) and r.before == r.before_w and close(r.e5, r.w5) and close(r.e50, r.w50) for r in both)


def test_bars_numbered_in_blocks(spark):
    bars = spark.range(500).select(F.when(F.col("id") % 7 == 0, "B").otherwise("A").alias("ticker"), F.timestamp_seconds(F.pmod(F.hash("id"), F.lit(10**8)).cast("long")).alias("ts")).distinct()
    got = long_series.numbered_in_blocks(bars, 9).withColumn("want", F.row_number().over(frames.whole().orderBy("ts")) - 1)
    assert got.count() == bars.count() and got.where("rn <> want").count() == 0
    assert long_series.numbered_in_blocks(bars.limit(0)).count() == 0


def test_drawdown_of_blocks(spark):
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate([1.0, 5.0, 4.0, 2.0, 6.0, 5.9, 3.1, 7.0])], "ticker string, rn int, close double")
    assert abs(long_series.drawdown(df, block=3).first().max_drawdown + 0.6) < 1e-12


# ---- window search
def walk(spark, n=400, flat=False):
    draw = random.Random(5)
    rows = []
    for t in ("A", "B"):
        x = 100.0
        for i in range(n):
            x += draw.gauss(0, 1)
            rows.append((t, i, 7.0 if flat and 40 <= i < 90 else x))
    return spark.createDataFrame(rows, "ticker string, rn int, close double")


@pytest.mark.parametrize(("window", "block", "flat"), [(30, 64, False), (30, 1 << 16, True), (7, 50, True)])
def test_products_find_what_all_windows_give(spark, window, block, flat):
    bars = walk(spark, flat=flat)
    shape = lambda df: {(r.ticker, r["start"], round(r.score, 4), r["rank"]) for r in df.collect()}
    assert shape(series_search.search_by_products(bars, window=window, block=block)) == shape(similarity.search_historical(bars, window=window))


def test_products_skip_windows_with_missing_closes():
    draw = np.random.default_rng(6)
    values = draw.normal(size=300).cumsum() + 1e6
    values[[50, 51, 200]] = np.nan
    query = draw.normal(size=20).cumsum()
    got = series_search.best_by_products(values, query, 281, 5)
    z = series_search.z_scores(query)
    want = []
    for i in range(281):
        w = values[i : i + 20]
        if not np.isnan(w).any():
            s = series_search.z_scores(w)
            want.append((-math.floor(abs(x := s @ z / 20 - np.linalg.norm(s - z) / 10) * 1e4 + 0.5) * (1 if x > 0 else -1), i))
    assert [g[0] for g in got] == [i for _, i in sorted(want)[:5]]
    assert series_search.best_by_products(np.full(60, np.nan), query, 41, 5) == []


@pytest.mark.parametrize("band", [None, 3, 0])
def test_dtw_search_equals_all_costs(spark, band):
    bars = walk(spark, n=220)
    got = {(r.ticker, r["rank"]): (r["start"], r.dtw) for r in series_search.search_by_dtw(bars, window=16, gap=10, top=4, band=band, block=45).collect()}
    for ticker in ("A", "B"):
        x = np.array([r.close for r in bars.where(F.col("ticker") == ticker).orderBy("rn").collect()])
        q = series_search.z_scores(x[-16:])
        costs = []
        for i in range(len(x) - 16 - 10):
            s, best = series_search.z_scores(x[i : i + 16]), {(0, 0): 0.0}
            for a in range(1, 17):
                for b in range(1, 17):
                    if abs(a - b) <= (16 if band is None else band):
                        best[a, b] = abs(s[a - 1] - q[b - 1]) + min(best.get(k, np.inf) for k in ((a - 1, b), (a, b - 1), (a - 1, b - 1)))
            costs.append((best[16, 16], i))
        for place, (cost, i) in enumerate(sorted(costs)[:4], 1):
            assert got[ticker, place] == (i, pytest.approx(cost))


def test_lower_bounds_are_below_costs():
    draw = np.random.default_rng(8)
    shapes, query = series_search.z_scores(draw.normal(size=(200, 25))), series_search.z_scores(draw.normal(size=25))
    for band in (0, 2, 25):
        costs = series_search.warping_costs(shapes, query, band, np.inf)
        assert (series_search.lower_bounds(shapes, query, band) <= costs + 1e-9).all()
        limit = float(np.median(costs))
        early = series_search.warping_costs(shapes, query, band, limit)
        assert (early[costs <= limit] == costs[costs <= limit]).all() and (costs[np.isinf(early)] > limit).all() and np.isinf(early).any()


# ---- the fold from event to event
def fold_bar_by_bar(close, high, low, signal, *, stop, target, hold_min, hold_max, capital, commission, worst_case, limit_pct, size):
    cash, shares, entry, paid, equity, trades = capital, 0, -1, 0.0, [], []
    for i in range(len(close)):
        limited = limit_pct > 0 and i > 0 and close[i - 1] != 0 and abs(close[i] / close[i - 1] - 1) >= limit_pct
        if shares:
            gain = (close[i] - paid) / paid
            why = "signal" if signal[i] < 0 and i - entry >= hold_min else "stop_loss" if stop > 0 and gain <= -stop else "take_profit" if target > 0 and gain >= target else "timeout" if i - entry >= hold_max else None
            if why:
                out = low[i] if worst_case else close[i]
                cash += shares * out * (1 - commission)
                trades.append((entry, i, paid, out, (out - paid) / paid, i - entry, why))
                shares = 0
        elif signal[i] > 0 and not limited:
            price = high[i] if worst_case else close[i]
            bought = int(cash * 0.95 * size / price) if price > 0 else 0
            if bought > 0:
                cash, shares, entry, paid = cash - bought * price * (1 + commission), bought, i, price
        equity.append(cash + shares * close[i])
    if shares:
        out = low[-1] if worst_case else close[-1]
        cash += shares * out * (1 - commission)
        trades.append((entry, len(close) - 1, paid, out, (out - paid) / paid, len(close) - 1 - entry, "force_close"))
    return equity, trades, cash


def test_fold_equals_every_bar():
    draw = np.random.default_rng(9)
    for n in [0, 1, 2, *draw.integers(3, 200, 400).tolist()]:
        close = np.abs(100 + draw.normal(0, 4, n).cumsum()) * (draw.random(n) > 0.02)
        high, low = close + draw.random(n), close - draw.random(n)
        signal = draw.choice([-2, -1, 0, 0, 0, 1, 2], n) if n % 3 else draw.choice([0, 0, 0, 0, 0, 0, 1, -1], n)
        options = {"stop": draw.choice([0.0, 0.02, 0.08]), "target": draw.choice([0.0, 0.03]), "hold_min": int(draw.choice([0, 1, 5])), "hold_max": int(draw.choice([1, 10, 500])), "capital": float(draw.choice([50.0, 1e5])), "commission": 0.001, "worst_case": bool(draw.random() < 0.5), "limit_pct": float(draw.choice([0.0, 0.04])), "size": float(draw.choice([1.0, 0.5]))}
        equity, trades, cash = bt.fold(close, high, low, signal, **options)
        want = fold_bar_by_bar(close.tolist(), high.tolist(), low.tolist(), signal.tolist(), **options)
        assert trades == want[1] and cash == want[2] and equity.tolist() == want[0]


def test_metrics_of_a_curve():
    m = bt.curve_metrics(np.array([100.0, 110.0, 99.0, 120.0]))
    steps = np.array([0.1, -0.1, 120 / 99 - 1])
    assert m["sharpe"] == pytest.approx(steps.mean() / steps.std(ddof=1) * math.sqrt(252)) and m["max_drawdown"] == pytest.approx(-0.1) and m["last_equity"] == 120
    assert bt.curve_metrics(np.array([5.0])) == {"sharpe": 0.0, "max_drawdown": 0.0, "last_equity": 5.0}


# ---- keywords
def test_keywords_over_several_automata(spark):
    words = spark.createDataFrame([(w, "S", "E", "positive", 1.0) for w in ("aa", "bb", "cc", "DD", "ee", "é!", "", None)] + [("aa", "T", "E", "negative", 2.0)], "keyword string, sector string, etf string, direction string, weight double")
    texts = spark.createDataFrame([(1, "AA dd"), (2, "eea É!"), (3, None), (4, "")], "doc_id long, text string")
    for most in (1 << 20, 4):
        got = Counter((r.doc_id, r.keyword, r.sector) for r in news.match_keywords(texts, words, most_bytes=most).collect())
        assert got == Counter([(1, "aa", "S"), (1, "aa", "T"), (1, "DD", "S"), (2, "ee", "S"), (2, "é!", "S"), (1, "", "S"), (2, "", "S"), (4, "", "S")])
    assert news.match_keywords(texts, words.limit(0)).count() == 0


def test_many_keywords_in_one_scan(spark):
    words = spark.range(100_000).select(F.concat(F.lit("w"), F.hex("id"), F.lit("z")).alias("keyword"), F.lit("S").alias("sector"), F.lit("E").alias("etf"), F.lit("positive").alias("direction"), F.lit(1.0).alias("weight"))
    texts = spark.createDataFrame([(i, f"some text W{i:X}Z and more w{i + 7:X}z") for i in range(500)], "doc_id long, text string")
    hits = news.match_keywords(texts, words)
    assert hits.count() == 1000 and hits._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


# ---- streams
def _folder(spark, path, batches, schema):
    import pandas as pd

    for i, rows in enumerate(batches):
        pdf = pd.DataFrame([(*r[:-1], r[-1]) for r in rows], columns=[c.split()[0] for c in schema.split(", ")])
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={i}")


def test_streaming_backtest_puts_late_bars_in_order_and_closes_idle_series(spark, tmp_path):
    import pandas as pd

    from tickloom.streaming import ordered

    schema = "ticker string, strategy string, ts timestamp, close double, high double, low double, vote double"
    bar = lambda t, day, close, vote: (t, "x", pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=day), close, close + 1, close - 1, vote)
    # day 2 comes after day 3, by less than what may be late; B ends with an open position
    batches = [[bar("A", 0, 10.0, 0.0), bar("A", 1, 10.0, 1.0), bar("B", 0, 5.0, 2.0)], [bar("A", 3, 7.0, 0.0)], [bar("A", 2, 10.5, 0.0), bar("A", 4, 7.0, -1.0)], [bar("~", 400, 1.0, 0.0)]]
    _folder(spark, str(tmp_path / "in"), batches, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    made = ordered.streaming_backtest(stream, {"x": (0.2, 0.0, 1, 99)}, late="2 days", idle="30 days", capital=1000.0, commission=0.0)
    made.writeStream.format("memory").queryName("late_trades").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.ticker, r.entry, r.exit, r.reason): round(r.return_pct, 6) for r in spark.table("late_trades").collect()}
    assert got == {("A", 1, 3, "stop_loss"): -0.3, ("B", 0, 0, "force_close"): 0.0}


# ---- plug-ins
def test_plugin_strategies(spark):
    from tickloom.operators import strategies

    draw = random.Random(7)
    rows = [("A", i, draw.uniform(0, 100), 100.0 + i) for i in range(50)]
    bars = spark.createDataFrame(rows, "ticker string, rn int, rsi_14 double, close double")
    mine = strategies.register(strategies.from_sql("mine", "CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 END", stop_loss=0.5))
    try:
        got = [r.st_mine for r in strategies.with_strategies(bars, ["mine"]).orderBy("rn").collect()]
        assert got == [1 if r[2] < 30 else -1 if r[2] > 70 else 0 for r in rows]
        assert bt._params(["mine"], None) == {"mine": (0.5, 0.12, 3, 30)} and strategies.registry(spark).count() == 21
        with pytest.raises(ValueError):
            strategies.register(mine._replace(id="ma_ribbon"))
    finally:
        strategies.unregister("mine")
    with pytest.raises(KeyError):
        strategies.with_strategies(bars, ["mine"])


def test_plugin_detector_keeps_tickers_apart(spark):
    from tickloom.operators import detectors

    bars = spark.createDataFrame([(t, i, c) for t, cs in (("A", [1.0, 2.0, 3.0, 4.0, None, 5.0]), ("B", [3.0, 2.0, 1.0])) for i, c in enumerate(cs)], "ticker string, rn int, close double").repartition(2)
    detectors.register_detector(spark, "streaks_of_two", lambda: detectors.streak(2))
    bars.createOrReplaceTempView("some_bars")
    got = spark.sql("SELECT * FROM streaks_of_two(TABLE(some_bars) PARTITION BY ticker ORDER BY rn)").collect()
    assert sorted(map(tuple, got)) == [("A", 2, "rising", 2), ("A", 3, "rising", 3), ("B", 2, "falling", 2)]


# ---- quantiles
def test_merged_sketches_are_within_their_bound(spark):
    from tickloom.operators import quantiles

    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("k"), (F.col("id") % 50).alias("day"), F.when(F.col("id") % 11 > 0, F.pow(F.rand(3), 4)).alias("x"))
    kept = quantiles.sketches(df, "x", ["k", "day"], 200)
    whole = quantiles.merged(kept, ["k"], 200)
    assert {r.k: r.n for r in whole.collect()} == {r.k: r["count"] for r in df.where("x is not null").groupBy("k").count().collect()}
    for share in (0.1, 0.5, 0.9):
        placed = quantiles.rank_of(df, "x", ["k"], whole.select("k", quantiles.at("sketch", share).alias("v")), "v").collect()
        assert all(r.below - quantiles.rank_error(200) <= share <= r.upto + quantiles.rank_error(200) for r in placed)
    assert quantiles.exact(spark.createDataFrame([("A", 1.0), ("A", 3.0), ("A", None)], "k string, x double"), "x", ["k"], [0.5]).first().q0 == 2.0
    assert quantiles.merged(kept.limit(0), ["k"]).count() == 0


# ---- judgements as they are shown
def test_judgements_use_rounded_figures(spark):
    from tickloom.operators import stats

    rows = [("A", "wins_45_045", 111, 50 / 111, -0.02), ("A", "mean_0_004", 20, 0.7, 0.00004), ("A", "wins_59_96", 2001, 0.59964, 0.01), ("A", "few", 9, 0.9, 0.1)]
    got = {r.signal: r.judgement for r in stats.judge_signals(spark.createDataFrame([(t, s, 5, n, w, m) for t, s, n, w, m in rows], "ticker string, signal string, horizon int, events long, win_rate double, mean double")).collect()}
    assert got == {"wins_45_045": "bearish", "mean_0_004": "neutral", "wins_59_96": "bullish", "few": "insufficient"}


def test_snapshots_are_read_once_over_runs(spark, tmp_path):
    import datetime

    from tickloom.sources import snapshots

    day = lambda n: datetime.datetime(2024, 1, n)
    write = lambda rows: spark.createDataFrame(rows, "ticker string, ts timestamp, close double").coalesce(1).write.mode("append").option("header", True).csv(str(tmp_path / "in"))
    run = lambda: snapshots.refresh(spark, str(tmp_path / "in"), str(tmp_path / "sink"), str(tmp_path / "state"), "ticker string, ts timestamp, close double")
    write([("A", day(1), 1.0), ("B", day(2), 2.0)])
    run()
    run()
    write([("A", day(3), 3.0)])
    run()
    kept = spark.read.parquet(str(tmp_path / "sink"))
    assert sorted((r.ticker, r.close) for r in kept.collect()) == [("A", 1.0), ("A", 3.0), ("B", 2.0)] and kept.select("snapshot").distinct().count() == 2
    assert {r.ticker: r.close for r in snapshots.newest(kept).collect()} == {"A": 3.0, "B": 2.0}
    assert {r.ticker: r.close for r in snapshots.newest(kept, at="2024-01-02 12:00:00").collect()} == {"A": 1.0, "B": 2.0}
    assert {r.ticker for r in snapshots.newest(kept, at="2024-01-03 12:00:00", seconds=86_400).collect()} == {"A"}
