"""Registered queries of time joins, long series, window search and large keyword sets, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import long_series
from ..functions.frames import div
from ..functions.storage import shared_folder
from ..operators import asof, detectors, intervals, news, quantiles, screener, series_search
from ..sources import bars as sources
from ..sources import dimensions, snapshots
from ..streaming import ordered
from . import api
from . import oracle as o
from . import queries as q
from .queries import KEY, register, shown

col = F.col


def _events(s: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet").withColumn("ts", col("ts").cast("timestamp"))
    return events if kind is None else events.where(col("event_type") == kind)


# ---- long series: the same columns as the window form, block by block
#: Bars of a block here: short enough for the test tables to have several.
_BLOCK = 64
_LONG_NAMES = ["ema12", "ema26", "ema50", "ema100", "vwap", "obv", "ad_line"]


def _long_factors(s: SparkSession, d: str) -> DataFrame:
    bars = long_series.numbered_in_blocks(sources.bars_events(s, d).drop("rn"), 16)
    bars = long_series.with_previous(bars, block=_BLOCK, previous="close")
    clv = div((col("close") - col("low")) - (col("high") - col("close")), col("high") - col("low"))
    signed = F.coalesce(F.signum(col("close") - col("previous")), F.lit(0.0)) * col("volume")
    sums = {"money": col("volume") * col("close"), "traded": col("volume").cast("double"), "obv": signed, "spread": clv * col("volume")}
    out = long_series.scan(bars.withColumn("clv", clv), sums=sums, emas={f"ema{n}": (col("close"), n) for n in (12, 26, 50, 100)}, block=_BLOCK)
    out = out.withColumns({"vwap": col("money") / F.when(col("traded") == 0, 1.0).otherwise(col("traded")), "ad_line": F.when(col("clv").isNotNull(), col("spread"))})
    return shown(out, [*KEY, *_LONG_NAMES])


register("long_series_factors", _long_factors, o.query(o.EVENTS, o.IND, o.FACTORS, select=f"SELECT {q._KEY_SQL}, {q._nums(_LONG_NAMES)} FROM fac"))
register(
    "long_series_drawdown",
    lambda s, d: shown(long_series.drawdown(sources.bars_parts(s, d), block=256)),
    o.query(o.PARTS, f"z AS (SELECT *, max(close) {o.CUM} AS peak FROM bars)", select=f"SELECT ticker, {o.num('min((close - peak) / nullif(peak, 0))')} AS max_drawdown FROM z GROUP BY ticker"),
)

# ---- as-of joins
_SIDES = "p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS other_id, arg_max(value, event_id) AS other_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)"


def _asof_users(s: SparkSession, d: str, **options) -> DataFrame:
    views = _events(s, d, "view").select("user_id", col("ts").alias("other_ts"), col("event_id").alias("other_id"), col("value").alias("other_value"))
    purchases = _events(s, d, "purchase").select("event_id", "user_id", "ts")
    out = asof.asof_join(purchases, views, by=["user_id"], left_on="ts", right_on="other_ts", columns=["other_id", "other_value"], tie="other_id", bucket_rows=1000, **options)
    return shown(out, ["event_id", "user_id", "other_id", "other_ts", "other_value"])


_ASOF_SELECT = f"SELECT event_id, user_id, other_id, strftime(other_ts, '%Y-%m-%d %H:%M:%S') AS other_ts, {o.num('other_value')} AS other_value FROM"
_PARTNER = "SELECT p.event_id, p.user_id, v.other_id, v.ts AS other_ts, v.other_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts {} v.ts"
register("asof_last_view", _asof_users, o.query(_SIDES, select=f"{_ASOF_SELECT} ({_PARTNER.format('>=')})"))
register(
    "asof_next_view",
    lambda s, d: _asof_users(s, d, direction="forward", exact=False, tolerance=86_400_000_000),
    o.query(
        _SIDES, f"n AS ({_PARTNER.format('<')})",
        "k AS (SELECT n.* EXCLUDE (other_id, other_ts, other_value), CASE WHEN near THEN other_id END AS other_id, CASE WHEN near THEN other_ts END AS other_ts, CASE WHEN near THEN other_value END AS other_value FROM (SELECT n.*, coalesce(other_ts - p.ts <= INTERVAL 1 DAY, false) AS near FROM n JOIN p USING (event_id)) n)",
        select=f"{_ASOF_SELECT} k",
    ),
)
register(
    "asof_nearest_view",
    lambda s, d: _asof_users(s, d, direction="nearest"),
    o.query(
        _SIDES, f"b AS ({_PARTNER.format('>=')}), f AS ({_PARTNER.format('<=')})",
        "n AS (SELECT p.event_id, p.user_id, CASE WHEN b.other_id IS NOT NULL AND (f.other_id IS NULL OR p.ts - b.other_ts <= f.other_ts - p.ts) THEN b ELSE f END AS x FROM p JOIN b USING (event_id) JOIN f USING (event_id)), k AS (SELECT event_id, user_id, x.other_id, x.other_ts, x.other_value FROM n)",
        select=f"{_ASOF_SELECT} k",
    ),
)


def _asof_bars(s: SparkSession, d: str) -> DataFrame:
    """Every tick with the close of its ticker's last complete bar: five keys hold all rows."""
    done = sources.bars_events(s, d).select("ticker", (col("ts") + F.expr("interval 4 hours")).alias("known_at"), "close")
    ticks = _events(s, d).select("event_id", col("event_type").alias("ticker"), "ts", "value")
    out = asof.asof_join(ticks, done, by=["ticker"], left_on="ts", right_on="known_at", columns=["close"], bucket_rows=2000)
    return shown(out, ["event_id", "ticker", "value", "known_at", "close"])


register(
    "asof_bar_close",
    _asof_bars,
    o.query(
        o.EVENTS,
        "k AS (SELECT ticker, ts + INTERVAL 4 HOUR AS known_at, close FROM bars), x AS (SELECT event_id, event_type, value, k.known_at, k.close FROM events e ASOF LEFT JOIN k ON e.event_type = k.ticker AND e.ts >= k.known_at)",
        select=f"SELECT event_id, event_type AS ticker, {o.num('value')} AS value, strftime(known_at, '%Y-%m-%d %H:%M:%S') AS known_at, {o.num('close')} AS close FROM x",
    ),
)

# ---- interval joins
#: News here are ticks of at least this value.
_NEWS = 40


def _trade_news(s: SparkSession, d: str) -> DataFrame:
    """Every trade with the news of its ticker from its entry to its exit."""
    at = sources.bars_events(s, d).select("ticker", "rn", "ts")
    trades = q.bt.trades(q._results(s, d, curve=False)).select("ticker", "strategy", "entry", "exit")
    spans = trades.join(at.select("ticker", col("rn").alias("entry"), col("ts").alias("opened")), ["ticker", "entry"]).join(at.select("ticker", col("rn").alias("exit"), col("ts").alias("closed")), ["ticker", "exit"])
    hits = _events(s, d).where(col("value") >= _NEWS).select("event_id", col("event_type").alias("ticker"), col("ts").alias("news_at"))
    out = intervals.interval_join(hits, spans, by=["ticker"], at="news_at", start="opened", end="closed")
    return shown(out, ["ticker", "strategy", "entry", "exit", "event_id", "news_at"])


register(
    "trade_news",
    _trade_news,
    o.recursive(
        *q._VOTED, o.votes(q._OWN), o.fold("v", "fold"),
        "sp AS (SELECT t.ticker, t.strategy, t.exit_rn - t.hold_bars AS entry, t.exit_rn AS exit, a.ts AS opened, b.ts AS closed FROM fold_trades t JOIN bars a ON a.ticker = t.ticker AND a.rn = t.exit_rn - t.hold_bars JOIN bars b ON b.ticker = t.ticker AND b.rn = t.exit_rn)",
        select=f"SELECT ticker, strategy, entry, exit, event_id, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS news_at FROM sp JOIN events e ON e.event_type = sp.ticker AND e.value >= {_NEWS} AND e.ts BETWEEN opened AND closed",
    ),
)


def _in_transit(s: SparkSession, d: str) -> DataFrame:
    """Pairs of an order's lines that were in transit on a common day."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", col("l_shipdate").cast("date").alias("sent"), F.date_add(col("l_shipdate").cast("date"), (col("l_quantity") % 29).cast("int")).alias("got"))
    left, right = (lines.select("l_orderkey", col("l_linenumber").alias(f"line_{x}"), col("sent").alias(f"sent_{x}"), col("got").alias(f"got_{x}")) for x in "ab")
    pairs = intervals.overlap_join(left, right, by=["l_orderkey"], left_span=("sent_a", "got_a"), right_span=("sent_b", "got_b")).where("line_a < line_b")
    return shown(pairs, ["l_orderkey", "line_a", "line_b"])


register(
    "lines_in_transit",
    _in_transit,
    o.query(
        "l AS (SELECT l_orderkey, l_linenumber AS line, CAST(l_shipdate AS DATE) AS sent, CAST(l_shipdate AS DATE) + CAST(CAST(l_quantity AS BIGINT) % 29 AS INT) AS got FROM lineitem)",
        select="SELECT a.l_orderkey, CAST(a.line AS BIGINT) AS line_a, CAST(b.line AS BIGINT) AS line_b FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.line < b.line AND a.sent <= b.got AND b.sent <= a.got",
    ),
)

# ---- window search
_W = 120
_LONG_HISTORY = f"""w0 AS (
    SELECT ticker, rn, list(close) OVER ({o.P} ROWS BETWEEN CURRENT ROW AND {_W - 1} FOLLOWING) AS w, count(*) {o.ALL} AS n FROM bars
), w1 AS (
    SELECT ticker, rn, n, list_transform(w, {q._Z}) AS z FROM w0 WHERE len(w) = {_W}
), qu AS (
    SELECT ticker, z AS b FROM w1 WHERE rn = n - {_W} AND n >= {2 * _W + 60}
), c AS (
    SELECT ticker, rn, list_dot_product(z, b) / {_W} AS corr, list_distance(z, b) AS dist FROM w1 JOIN qu USING (ticker) WHERE rn <= n - {_W} - 61
), k AS (
    SELECT *, round(corr - dist / 10, 4) AS score FROM c
), f AS (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, rn) AS rank FROM k
)"""
register(
    "similar_history_long",
    lambda s, d: shown(series_search.search_by_products(sources.bars_orders(s, d), window=_W, block=512), ["ticker", "start", "corr", "dist", "score", "rank"]),
    o.query(o.ORDERS, _LONG_HISTORY, select=f"SELECT ticker, rn AS start, {q._nums(('corr', 'dist', 'score'))}, rank FROM f WHERE rank <= 5"),
)
register(
    "similar_by_dtw",
    lambda s, d: shown(series_search.search_by_dtw(sources.bars_events(s, d), block=50), ["ticker", "start", "dtw", "rank"]),
    o.recursive(
        o.EVENTS, q._HISTORY.replace(" QUALIFY rank <= 5", ""), q._WARP,
        "g AS (SELECT ticker, rn, last[29] AS cost, row_number() OVER (PARTITION BY ticker ORDER BY last[29], rn) AS place FROM d WHERE s = 58)",
        select=f"SELECT ticker, rn AS start, {o.num('cost')} AS dtw, place AS rank FROM g WHERE place <= 5",
    ),
)


# ---- a keyword dimension of any size
def _vocabulary(s: SparkSession, d: str) -> DataFrame:
    """An event-to-sector map of the long words of the benchmark, written as JSON and read back."""
    words = s.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) >= 7").distinct()
    size = F.length("w")
    groups = words.groupBy(F.substring("w", 1, 2).alias("sector"), (size % 3).alias("m"), size.alias("n")).agg(F.sort_array(F.collect_list("w")).alias("keywords"))
    group = F.struct("keywords", "sector", F.concat(F.lit("E"), col("m")).alias("etf"), F.element_at(F.array(*map(F.lit, ("positive", "negative", "mixed"))), col("m") + 1).alias("direction"), (col("n") / 8).alias("weight"))
    path = f"{shared_folder(s)}/mapping-{uuid.uuid4().hex}"
    dimensions.write_json(groups.select(F.array(group).alias("event_keywords")), path)
    return news.keyword_dimension(dimensions.read_mapping(s, path, multi_line=False))


register(
    "news_vocabulary",
    lambda s, d: shown(news.match_keywords(s.read.parquet(f"{d}/documents.parquet"), _vocabulary(s, d))),
    o.query(
        "kw AS (SELECT DISTINCT w AS keyword, substr(w, 1, 2) AS sector, 'E' || length(w) % 3 AS etf, ['positive', 'negative', 'mixed'][length(w) % 3 + 1] AS direction, length(w) / 8 AS weight FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 7)",
        select=f"SELECT doc_id, keyword, sector, etf, direction, {o.num('CAST(weight AS DOUBLE)')} AS weight FROM documents JOIN kw ON contains(lower(text), keyword)",
    ),
)


# ---- streams that end: the same rows as the batch form
def _stream_trades(s: SparkSession, d: str) -> DataFrame:
    at = sources.bars_events(s, d).select("ticker", "rn", "ts")
    votes = q.bt.votes(q._strategies(s, d)).join(at, ["ticker", "rn"]).select("ticker", "strategy", "ts", "close", "high", "low", col("vote").cast("double").alias("vote"))
    limits = q.bt._params(q.strategies.IDS, None)
    found = ordered.replayed(votes, {"ticker": "~", "strategy": q.strategies.IDS[0]}, lambda v: ordered.streaming_backtest(v, limits))
    return shown(found, ["ticker", "strategy", "entry", "exit", "return_pct", "hold_bars", "reason"])


register(
    "streaming_trade_log",
    _stream_trades,
    o.recursive(*q._VOTED, o.votes(q._OWN), o.fold("v", "fold"), select=f"SELECT ticker, strategy, exit_rn - hold_bars AS entry, exit_rn AS exit, {o.num('return_pct')} AS return_pct, hold_bars, reason FROM fold_trades"),
)
_STREAMED = ["ma5", "ma10", "ma20", "ma60", "ema12", "ema26", "ema50", "bb_upper", "bb_lower", "high_20", "low_20", "atr14", "rsi_14", "macd_line", "macd_signal", "daily_ret"]
register(
    "streaming_indicators",
    lambda s, d: shown(ordered.replayed(sources.bars_events(s, d).select("ticker", "ts", "close", "high", "low", "volume"), {"ticker": "~"}, ordered.streaming_indicators), [*KEY, *_STREAMED]),
    o.query(o.EVENTS, o.IND, o.FACTORS, select=f"SELECT {q._KEY_SQL}, {q._nums(_STREAMED)} FROM fac"),
)


# ---- plug-ins
_DIP = "CASE WHEN rsi_14 < 40 AND close > ma5 THEN 1 WHEN rsi_14 < 30 THEN 2 WHEN rsi_14 > 60 THEN -1 END"


def _with_dip(s: SparkSession, d: str) -> DataFrame:
    """Factors with all votes, a user's strategy among them."""
    q.strategies.register(q.strategies.from_sql("dip", _DIP, stop_loss=0.2, take_profit=0.3, hold_min=2, hold_max=12))
    try:
        return q.strategies.with_strategies(q._factors(s, d), [*q.strategies.IDS, "dip"])
    finally:
        q.strategies.unregister("dip")


def _dip_trades(s: SparkSession, d: str) -> DataFrame:
    results = q.bt.run_strategies(_with_dip(s, d), {"all": {"dip": (0.2, 0.3, 2, 12)}}, curve=False)
    return shown(q.bt.trades(results), ["ticker", "strategy", "entry", "exit", "return_pct", "reason"])


register(
    "plugin_trades",
    _dip_trades,
    o.recursive(
        *q._VOTED,
        f"v AS MATERIALIZED (SELECT 'all' AS run, ticker, 'dip' AS strategy, rn, close, high, low, coalesce({_DIP}, 0) AS vote, 0.2 AS stop, 0.3 AS target, 2 AS least_hold, 12 AS most_hold, CAST(100000 AS DOUBLE) AS capital FROM fac)",
        o.fold("v", "fold"),
        select=f"SELECT ticker, strategy, exit_rn - hold_bars AS entry, exit_rn AS exit, {o.num('return_pct')} AS return_pct, reason FROM fold_trades",
    ),
)
register(
    "plugin_consensus",
    lambda s, d: shown(q.strategies.aggregate_signals(_with_dip(s, d), [*q.strategies.IDS, "dip"]), [*KEY, "score"]),
    o.query(*q._VOTED, select=f"SELECT {q._KEY_SQL}, CAST({' + '.join(f'st_{i}' for i in q.strategies.IDS)} + coalesce({_DIP}, 0) AS BIGINT) AS score FROM st"),
)


def _streaks(s: SparkSession, d: str) -> DataFrame:
    detectors.register_detector(s, "close_streaks", detectors.streak)
    return shown(detectors.detect(sources.bars_events(s, d).select("ticker", "rn", "close"), "close_streaks"))


register(
    "plugin_detector",
    _streaks,
    o.query(
        o.EVENTS,
        f"w AS (SELECT ticker, rn, coalesce(sign(close - {o.lag('close')}), 0) AS way FROM bars), g AS (SELECT *, CASE WHEN way = {o.lag('way')} THEN 0 ELSE 1 END AS fresh FROM w), k AS (SELECT *, sum(fresh) {o.CUM} AS part FROM g), n AS (SELECT ticker, rn, way, row_number() OVER (PARTITION BY ticker, part ORDER BY rn) AS strength FROM k)",
        select="SELECT ticker, CAST(rn AS BIGINT) AS rn, CASE WHEN way > 0 THEN 'rising' ELSE 'falling' END AS event, strength FROM n WHERE way <> 0 AND strength >= 3",
    ),
)


# ---- quantiles
def _price_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Median price of every brand, exact, and whether the one from merged daily sketches stands within the error bound."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice")
    brands = s.read.parquet(f"{d}/part.parquet").select(col("p_partkey").alias("l_partkey"), col("p_brand").alias("ticker"))
    ticks = lines.join(brands, "l_partkey").select("ticker", F.trunc("l_shipdate", "month").alias("month"), "l_extendedprice")
    kept = quantiles.sketches(ticks, "l_extendedprice", ["ticker", "month"])
    found = quantiles.merged(kept, ["ticker"]).select("ticker", "n", quantiles.at("sketch", 0.5).alias("about"))
    placed = quantiles.rank_of(ticks, "l_extendedprice", ["ticker"], found, "about")
    error = quantiles.rank_error()
    near = (col("below") <= 0.5 + error) & (col("upto") >= 0.5 - error)
    return shown(placed.join(quantiles.exact(ticks, "l_extendedprice", ["ticker"], [0.5]).drop("n"), "ticker").select("ticker", "n", col("q0").alias("median"), near.alias("near")))


register(
    "price_quantiles",
    _price_quantiles,
    o.query("t AS (SELECT p_brand AS ticker, l_extendedprice AS x FROM lineitem JOIN part ON p_partkey = l_partkey)", select=f"SELECT ticker, count(*) AS n, {o.num('quantile_cont(CAST(x AS DOUBLE), 0.5)')} AS median, true AS near FROM t GROUP BY ticker"),
)

# ---- the screen in one row, and holding profiles
register(
    "screen_summary",
    lambda s, d: shown(screener.summary(screener.screen(sources.bars_parts(s, d), profile="short"))),
    o.recursive(
        o.PARTS.replace("bars AS (", "all_bars AS (", 1), q._RECENT, o.IND, o.FACTORS, o.STRATEGIES, o.votes(q._SHORT), o.fold("v", "fold", worst_case=True), o.summary("fold", "sm"), q._SCORE, q._SCREEN,
        "best30 AS (SELECT * FROM x ORDER BY total DESC, ticker LIMIT 30)",
        select=f"""SELECT count(*) AS n, count(*) FILTER (consensus LIKE '%bullish') AS n_bullish, count(*) FILTER (consensus LIKE '%bearish') AS n_bearish, count(*) FILTER (consensus = 'neutral') AS n_neutral,
            {o.num('avg(total)')} AS mean_total, {o.num('avg(pf_return)')} AS mean_return, {o.num('avg(avg_sharpe)')} AS mean_sharpe,
            coalesce((SELECT string_agg(ticker, ', ' ORDER BY total DESC, ticker) FROM (SELECT * FROM best30 WHERE consensus LIKE '%bullish' ORDER BY total DESC, ticker LIMIT 10)), '') AS best FROM best30""",
    ),
)
for _profile in ("medium", "long"):
    _limits = [(i, *(q.bt.HOLD_PROFILES[_profile][k] for k in (2, 3, 0, 1))) for i in q.strategies.IDS]
    register(
        f"backtest_ranking_{_profile}",
        lambda s, d, p=_profile: shown(q.bt.rank_strategies(q.bt.backtest_all(q._strategies(s, d), profile=p), "total_return" if p == "long" else "sharpe"), ["ticker", "strategy", "n_trades", "rank", *q._SUMMARY]),
        o.recursive(
            *q._VOTED, o.votes(_limits), o.fold("v", "fold"), o.summary("fold", "sm"), q._RANKED.replace("sharpe DESC", f"{'total_return' if _profile == 'long' else 'sharpe'} DESC"),
            select=f"SELECT ticker, strategy, n_trades, rank, {q._nums(q._SUMMARY)} FROM rk",
        ),
    )

# ---- what is shown: chosen fields, formatted and rounded figures, and what the regime run holds
register(
    "daily_rows",
    lambda s, d: shown(api.daily(sources.bars_events(s, d), limit=50, fields="close, ma20, no_such_field, rsi_14")),
    o.query(
        o.EVENTS, o.IND, o.FACTORS, f"n AS (SELECT *, max(rn) {o.ALL} AS newest FROM fac)",
        select=f"SELECT ticker, {q.TS}, {', '.join(o.num(f'round_even({c}, 4)') + f' AS {c}' for c in ('close', 'ma20', 'rsi_14'))} FROM n WHERE rn > newest - 50",
    ),
)
_PCT = ("total_return", "annual_return", "max_drawdown", "avg_return")
register(
    "backtest_formatted",
    # returns of these jumping series have more digits than two engines print alike
    lambda s, d: q.bt.formatted(q.bt.backtest_all(q._strategies(s, d), profile="short")).drop("total_return", "annual_return"),
    o.recursive(
        *q._VOTED, o.votes(q._SHORT), o.fold("v", "fold"), o.summary("fold", "sm"),
        select="SELECT ticker, strategy, CAST(n_trades AS VARCHAR) AS n_trades, " + ", ".join(f"printf('%.2f%%', {c} * 100) AS {c}" for c in _PCT[2:])
        + ", printf('%.1f%%', win_rate * 100) AS win_rate, printf('%.2f', sharpe) AS sharpe, CASE WHEN isinf(profit_factor) THEN 'Infinity' ELSE printf('%.2f', profit_factor) END AS profit_factor, printf('%.0f', avg_hold) AS avg_hold FROM sm WHERE n_trades > 0",
    ),
)
register(
    "backtest_rounded",
    lambda s, d: shown(q.portfolio.result_rows(q.bt.backtest_all(q._strategies(s, d), profile="short")), ["ticker", "strategy", "n_trades", *q._SUMMARY]),
    o.recursive(
        *q._VOTED, o.votes(q._SHORT), o.fold("v", "fold"), o.summary("fold", "sm"),
        select="SELECT ticker, strategy, n_trades, " + ", ".join(o.num(f"round({c} * 100, 2)") + f" AS {c}" for c in _PCT)
        + f", {o.num('round(win_rate * 100, 1)')} AS win_rate, {o.num('round(sharpe, 2)')} AS sharpe, {o.num('round(profit_factor, 2)')} AS profit_factor, {o.num('round(avg_hold, 0)')} AS avg_hold FROM sm WHERE n_trades > 0",
    ),
)
_SAID = ", ".join(f"'{k}': '{v}'" for k, v in q.portfolio.DESCRIPTIONS.items())
register(
    "portfolio_choices",
    lambda s, d: shown(q.portfolio.regime_choices(q._strategies(s, d))),
    o.recursive(
        *q._VOTED, o.votes(q._SHORT), o.fold("v", "fold"), o.summary("fold", "sm"), q._RANKED,
        q._GIVEN.replace("row_number() OVER (PARTITION BY so.ticker", "so.sharpe AS sharpe, row_number() OVER (PARTITION BY so.ticker"),
        select=f"""SELECT rr.ticker, rank, strategy, array_to_string(list_transform(string_split(strategy, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS name, {o.num('round(rr.sharpe, 2)')} AS sharpe,
            reg.regime, reg.category, {o.num('round(reg.score, 0)')} AS score, MAP {{{_SAID}}}[reg.regime] AS description FROM rr JOIN reg USING (ticker) WHERE rank <= 5""",
    ),
)


# ---- snapshots that arrive in two waves
def _snapshot_quotes(s: SparkSession, d: str) -> DataFrame:
    """The newest quote of every user from snapshot files of which the second half comes after the first run."""
    folder = f"{shared_folder(s)}/snapshots-{uuid.uuid4().hex}"
    quotes = _events(s, d).select(col("user_id").cast("string").alias("ticker"), "ts", "value", "event_id")
    for wave in (0, 1, None):  # the third run finds nothing new
        if wave is not None:
            quotes.where(col("event_id") % 2 == wave).write.mode("append").option("header", True).csv(f"{folder}/in")
        snapshots.refresh(s, f"{folder}/in", f"{folder}/sink", f"{folder}/state", quotes.schema)
    kept = s.read.parquet(f"{folder}/sink")
    rows = kept.groupBy("ticker").agg(F.count("*").alias("n"))
    return shown(snapshots.newest(kept).join(rows, "ticker"), ["ticker", "ts", "value", "event_id", "n"])


register(
    "snapshot_quotes",
    _snapshot_quotes,
    o.query("e AS (SELECT * FROM events)", select=f"SELECT CAST(user_id AS VARCHAR) AS ticker, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, {o.num('arg_max(value, ts)')} AS value, arg_max(event_id, ts) AS event_id, count(*) AS n FROM e GROUP BY user_id"),
)
