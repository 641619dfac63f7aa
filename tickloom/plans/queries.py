"""Registered queries over the bar sources, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import whole
from ..functions.storage import shared_folder
from ..operators import backtest as bt
from ..operators import chart_data, factors, indicators, news, portfolio, screener, signals, similarity, stats, strategies
from ..sources import bars as sources
from ..sources import dimensions
from ..streaming import ohlcv
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["ticker", "ts", "rn"]


def shown(df: DataFrame, columns=None, places: int = 6) -> DataFrame:
    """Columns for comparison: doubles nudged off ties and rounded, counts as long."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        if kinds[c] == "double":
            out.append(F.round(F.col(c) + F.lit(1e-9), places).alias(c))
        elif kinds[c] == "int":
            out.append(F.col(c).cast("long").alias(c))
        elif kinds[c] == "timestamp":
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
_KEY_SQL = f"ticker, {TS}, CAST(rn AS BIGINT) AS rn"


def _nums(names) -> str:
    return ", ".join(f"{o.num(n)} AS {n}" for n in names)


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# ---- bars
for _name, _source, _sql in (("bars_events", sources.bars_events, o.EVENTS), ("bars_orders", sources.bars_orders, o.ORDERS), ("bars_parts", sources.bars_parts, o.PARTS)):
    register(
        _name,
        lambda s, d, f=_source: shown(f(s, d), [*KEY, "open", "high", "low", "close", "volume"]),
        o.query(_sql, select=f"SELECT {_KEY_SQL}, {_nums(('open', 'high', 'low', 'close'))}, volume FROM bars"),
    )
register(
    "bars_last_year",
    lambda s, d: shown(sources.fetch_data(sources.bars_orders(s, d)), [*KEY, "close"]),
    o.query(
        o.ORDERS,
        "z AS (SELECT ticker, ts, close FROM (SELECT *, max(ts) OVER (PARTITION BY ticker) AS newest FROM bars) WHERE ts >= CAST(newest "
        "AS DATE) - INTERVAL 365 DAY), y AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS rn FROM z)",
        select=f"SELECT {_KEY_SQL}, {_nums(['close'])} FROM y",
    ),
)
register(
    "quotes",
    lambda s, d: shown(
        sources.fetch_quote(sources.bars_events(s, d)),
        ["ticker", "ts", "close", "prev_close", "change", "change_pct", "high_52w", "low_52w", "avg_volume"],
    ),
    o.query(
        o.EVENTS,
        f"z AS (SELECT *, {o.lag('close')} AS prev_close, max(ts) {o.ALL} AS newest FROM bars)",
        select=(
            f"SELECT ticker, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, {o.num('arg_max(close, ts)')} AS close, {o.num('arg_max(prev_close, ts)')} "
            f"AS prev_close, {o.num('arg_max(close - prev_close, ts)')} AS change, {o.num('arg_max((close - prev_close) / nullif(prev_close, 0) * 100, ts)')} "
            f"AS change_pct, {o.num('max(high) FILTER (ts >= newest - INTERVAL 364 DAY)')} AS high_52w, {o.num('min(low) FILTER (ts >= newest - INTERVAL 364 DAY)')} "
            f"AS low_52w, {o.num('avg(volume)')} AS avg_volume FROM z GROUP BY ticker"
        ),
    ),
)
_INDICES = {"click": "Clicks", "view": "Views", "purchase": "Purchases"}
register(
    "market_snapshot",
    lambda s, d: shown(sources.market_snapshot(sources.bars_events(s, d), _INDICES)),
    o.query(
        o.EVENTS,
        f"z AS (SELECT ticker, rn, close, {o.lag('close')} AS previous, max(rn) {o.ALL} AS newest FROM bars)",
        select=(
            f"SELECT ticker, CASE ticker {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _INDICES.items())} END AS name, {o.num('close')} "
            f"AS price, {o.num('(close - previous) / nullif(previous, 0) * 100')} AS change_pct FROM z WHERE rn = newest AND ticker IN "
            "('click', 'view', 'purchase')"
        ),
    ),
)
register(
    "intraday",
    lambda s, d: shown(
        sources.fetch_intraday(
            s.read.parquet(f"{d}/events.parquet").select(
                F.col("event_type").alias("ticker"),
                F.col("ts").cast("timestamp").alias("ts"),
                F.col("value").alias("price"),
                F.lit(1).alias("size"),
                F.col("event_id").alias("at"),
            ),
        ),
        [*KEY, "open", "close", "volume", "prev_close", "change_pct"],
    ),
    o.query(
        o.EVENTS.replace("INTERVAL 4 HOUR", "INTERVAL 1 HOUR"),
        f"z AS (SELECT *, {o.lag('close')} AS prev_close FROM bars)",
        select=(
            f"SELECT {_KEY_SQL}, {_nums(('open', 'close'))}, volume, {o.num('prev_close')} AS prev_close, {o.num('(close - prev_close) / nullif(prev_close, 0) * 100')} "
            "AS change_pct FROM z"
        ),
    ),
)

# ---- indicators and factors
_IND = ["ma5", "ma10", "ma20", "ma60", "vol_ma20", "vol_ratio", "high_20", "low_20", "high_60", "low_60", "daily_ret", "body", "lower_shadow", "upper_shadow", "total_range", "atr14", "bb_mid", "bb_std", "bb_upper", "bb_lower", "bb_width", "ma_spread"]
for _name, _source, _sql in (("base_indicators", sources.bars_events, o.EVENTS), ("base_indicators_daily", sources.bars_orders, o.ORDERS)):
    register(
        _name,
        lambda s, d, f=_source: shown(indicators.add_indicators(f(s, d)), [*KEY, "body_dir", *_IND]),
        o.query(_sql, o.IND, select=f"SELECT {_KEY_SQL}, CAST(body_dir AS BIGINT) AS body_dir, {_nums(_IND)} FROM ind"),
    )


def _factors(s: SparkSession, d: str) -> DataFrame:
    return factors.add_all_factors(sources.bars_events(s, d))


_WHOLE_NUMBERS = {"ma_ribbon_score", "trend_strength"}
_OTHER = {"price_new_high", "vol_not_new_high", "volume_divergence_bear", "market_regime"}
for _group, _names in factors.GROUPS.items():
    _select = ", ".join(n if n in _OTHER else f"CAST({n} AS BIGINT) AS {n}" if n in _WHOLE_NUMBERS else f"{o.num(n)} AS {n}" for n in _names)
    register(
        f"{_group}_factors",
        lambda s, d, n=_names: shown(_factors(s, d), [*KEY, *n]),
        o.query(o.EVENTS, o.IND, o.FACTORS, select=f"SELECT {_KEY_SQL}, {_select} FROM fac"),
    )


def trend_state(s: SparkSession, d: str) -> DataFrame:
    """The trend state of every ticker's last bar."""
    df = indicators.add_indicators(sources.bars_events(s, d))
    last = df.withColumn("newest", F.max("rn").over(whole())).where("rn = newest")
    label = F.when((F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")), "up").when((F.col("ma5") < F.col("ma10")) & (F.col("ma10") < F.col("ma20")), "down").otherwise("mixed")
    return shown(last.withColumn("trend", label), [*KEY, "close", "ma20", "atr14", "bb_upper", "bb_lower", "trend"])


register(
    "trend_state",
    trend_state,
    o.query(
        o.EVENTS,
        o.IND,
        f"z AS (SELECT *, max(rn) {o.ALL} AS newest FROM ind)",
        select=(
            f"SELECT {_KEY_SQL}, {_nums(('close', 'ma20', 'atr14', 'bb_upper', 'bb_lower'))}, CASE WHEN ma5 > ma10 AND ma10 > ma20 THEN "
            "'up' WHEN ma5 < ma10 AND ma10 < ma20 THEN 'down' ELSE 'mixed' END AS trend FROM z WHERE rn = newest"
        ),
    ),
)
register(
    "support_resistance",
    lambda s, d: shown(indicators.find_support_resistance(sources.bars_events(s, d)), places=4),
    o.query(
        o.EVENTS,
        f"z AS (SELECT *, max(rn) {o.ALL} AS newest FROM bars), y AS (SELECT ticker, arg_max(close, rn) AS close, min(low) AS support, "
        "max(high) AS resistance FROM z WHERE rn > newest - 20 GROUP BY ticker)",
        select=(
            f"SELECT ticker, {o.num('close', 4)} AS close, {o.num('support', 4)} AS support, {o.num('resistance', 4)} AS resistance, "
            f"{o.num('round((close - support) / nullif(support, 0) * 100, 2)', 4)} AS support_pct, {o.num('round((resistance - close) / nullif(close, 0) * 100, 2)', 4)} "
            "AS resistance_pct FROM y"
        ),
    ),
)
register(
    "ma_crosses",
    lambda s, d: shown(indicators.find_cross(indicators.add_ma(sources.bars_events(s, d)))),
    o.query(
        o.EVENTS,
        f"z AS (SELECT *, ({o.avg('close', 5, 5)}) - ({o.avg('close', 20, 20)}) AS gap, max(rn) {o.ALL} AS newest FROM bars), y AS (SELECT "
        f"*, {o.lag('gap')} AS before, newest - rn AS back FROM z)",
        select=(
            f"SELECT ticker, {TS}, CAST(back AS BIGINT) AS back, CASE WHEN gap > 0 THEN 'golden' ELSE 'death' END AS \"cross\", {o.num('close')} "
            "AS close FROM y WHERE ((before < 0 AND gap > 0) OR (before > 0 AND gap < 0)) AND back < least(newest + 1, 25) - 1"
        ),
    ),
)
register(
    "ma_slopes",
    lambda s, d: shown(indicators.slope_summary(sources.bars_events(s, d)), ["ticker", "ma", "slope_pct", "direction", "last"]),
    o.query(
        o.EVENTS,
        (
            "m AS ("
            + " UNION ALL ".join(f"SELECT ticker, rn, 'sma{p}' AS ma, {o.avg('close', p, p)} AS v FROM bars" for p in indicators.MA)
            + ("), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, ma ORDER BY rn DESC) AS back FROM m WHERE v IS NOT NULL), f "
            "AS (SELECT ticker, ma, CASE WHEN count(*) = 5 AND avg(v) <> 0 THEN regr_slope(v, rn) / avg(v) ELSE 0 END AS s, arg_max(v, "
            "rn) AS last FROM k WHERE back <= 5 GROUP BY ticker, ma)")
        ),
        select=(
            f"SELECT ticker, ma, {o.num('round(s * 100, 4)')} AS slope_pct, CASE WHEN s > 0.001 THEN 'up' WHEN s < -0.001 THEN 'down' "
            f"ELSE 'flat' END AS direction, {o.num('last')} AS last FROM f"
        ),
    ),
)


def _trend_analysis(s: SparkSession, d: str) -> DataFrame:
    df = indicators.trend_analysis(sources.bars_events(s, d))
    slopes = F.array_join(F.transform("slopes", lambda x: F.concat_ws(":", x["ma"], x["direction"])), ",")
    crosses = F.array_join(F.transform("crosses", lambda x: F.concat_ws(":", x["back"].cast("string"), x["cross"])), ",")
    return shown(df.withColumns({"slopes": slopes, "crosses": crosses}).drop("latest_cross"), places=4)


_SLOPES = "m AS (" + " UNION ALL ".join(f"SELECT ticker, rn, 'sma{p}' AS ma, {o.avg('close', p, p)} AS v FROM bars" for p in indicators.MA) + """
), k AS (
    SELECT *, row_number() OVER (PARTITION BY ticker, ma ORDER BY rn DESC) AS back FROM m WHERE v IS NOT NULL
), f AS (
    SELECT ticker, ma, CASE WHEN count(*) = 5 AND avg(v) <> 0 THEN regr_slope(v, rn) / avg(v) ELSE 0 END AS s, arg_max(v, rn) AS last FROM k WHERE back <= 5 GROUP BY ticker, ma
)"""
_TREND_REPORT = f"""sl AS (
    SELECT ticker, max(round(s * 100, 4)) FILTER (ma = 'sma20') AS slope20,
        string_agg(ma || ':' || CASE WHEN s > 0.001 THEN 'up' WHEN s < -0.001 THEN 'down' ELSE 'flat' END, ',' ORDER BY ma) AS slopes FROM f GROUP BY ticker
), g1 AS (
    SELECT ticker, rn, ts, {', '.join(f'{o.avg("close", p, p)} AS sma{p}' for p in indicators.MA)}, max(rn) {o.ALL} AS newest FROM bars
), g2 AS (
    SELECT *, sma5 - sma20 AS gap, {o.lag('sma5 - sma20')} AS before FROM g1
), cr AS (
    SELECT ticker, count(*) AS n, string_agg((newest - rn) || ':' || CASE WHEN gap > 0 THEN 'golden' ELSE 'death' END, ',' ORDER BY newest - rn) AS crosses
    FROM g2 WHERE ((before < 0 AND gap > 0) OR (before > 0 AND gap < 0)) AND newest - rn < least(newest + 1, 35) - 1 GROUP BY ticker
), al AS (
    SELECT ticker, ts, CASE WHEN sma5 > sma10 AND sma10 > sma20 AND sma20 > sma60 THEN 'bull' WHEN sma5 < sma10 AND sma10 < sma20 AND sma20 < sma60 THEN 'bear' ELSE 'tangled' END AS alignment
    FROM g1 WHERE rn = newest
), sr AS (
    SELECT b.ticker, arg_max(close, b.rn) AS close, min(low) AS support, max(high) AS resistance FROM bars b JOIN g1 USING (ticker, rn) WHERE b.rn > newest - 20 GROUP BY b.ticker
)"""
register("trend_analysis", _trend_analysis, o.query(o.EVENTS, _SLOPES, _TREND_REPORT, select=f"""
SELECT ticker, {o.num('close', 4)} AS close, {o.num('support', 4)} AS support, {o.num('resistance', 4)} AS resistance,
    {o.num('round((close - support) / nullif(support, 0) * 100, 2)', 4)} AS support_pct, {o.num('round((resistance - close) / nullif(close, 0) * 100, 2)', 4)} AS resistance_pct,
    alignment, {o.num('slope20', 4)} AS ma20_slope_pct, slopes, coalesce(crosses, '') AS crosses, strftime(ts, '%Y-%m-%d %H:%M:%S') AS latest_ts, coalesce(n, 0) AS n_crosses,
    CASE WHEN coalesce(slope20, 0) > 0.5 THEN 'up' WHEN coalesce(slope20, 0) < -0.5 THEN 'down' ELSE 'sideways' END AS overall
FROM sr LEFT JOIN al USING (ticker) LEFT JOIN sl USING (ticker) LEFT JOIN cr USING (ticker)"""))


# ---- signals
def _signals(s: SparkSession, d: str) -> DataFrame:
    return signals.detect_all(sources.bars_events(s, d))


_FAMILIES = {"trendline": signals.KEYS[:6], "slope": signals.KEYS[6:12], "curve": signals.KEYS[12:21], "candle": signals.KEYS[21:31], "classic": signals.KEYS[31:]}
for _family, _names in _FAMILIES.items():
    _cols = [f"signal_{k}" for k in _names]
    register(
        f"signals_{_family}",
        lambda s, d, n=_cols: shown(_signals(s, d), [*KEY, *n]),
        o.query(o.EVENTS, o.IND, o.SIGNALS, select=f"SELECT {_KEY_SQL}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _cols)} FROM sig"),
    )
register(
    "signals_daily",
    lambda s, d: shown(
        signals.long_signals(signals.detect_all(sources.bars_orders(s, d))).groupBy("ticker", "signal").agg(
            F.sum("strength").alias("strength"),
            F.sum(F.when(F.col("strength") > 0, 1).otherwise(0)).alias("events"),
        ),
        ["ticker", "signal", "strength", "events"],
    ),
    o.query(
        o.ORDERS,
        o.IND,
        o.SIGNALS,
        "l AS (" + " UNION ALL ".join(f"SELECT ticker, '{k}' AS signal, signal_{k} AS strength FROM sig" for k in signals.KEYS) + ")",
        select="SELECT ticker, signal, CAST(sum(strength) AS BIGINT) AS strength, count(*) FILTER (strength > 0) AS events FROM l GROUP BY 1, 2",
    ),
)
_LONG = (
    "l AS ("
    + (" UNION ALL ".join(
        (f"SELECT ticker, ts, rn, '{k}' AS signal, '{v}' AS direction, signal_{k} AS strength FROM sig" for k, v in signals.REGISTRY.items()),
    ))
    + ("), n AS (SELECT ticker, max(rn) AS newest FROM bars GROUP BY 1), act AS (SELECT ticker, signal, direction, arg_max(strength, rn) "
    "AS strength, max(ts) AS last_ts, count(*) AS occurrences FROM l JOIN n USING (ticker) WHERE rn > newest - 5 AND strength > 0 GROUP "
    "BY 1, 2, 3)")
)
register(
    "active_signals",
    lambda s, d: shown(signals.active_signals(_signals(s, d)), ["ticker", "signal", "direction", "strength", "last_ts", "occurrences"]),
    o.query(
        o.EVENTS,
        o.IND,
        o.SIGNALS,
        _LONG,
        select=(
            "SELECT ticker, signal, direction, CAST(strength AS BIGINT) AS strength, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, "
            "occurrences FROM act"
        ),
    ),
)
_VERDICT = (
    "CASE WHEN score >= 3 THEN 'strong_bullish' WHEN score >= 1 THEN 'bullish' WHEN score <= -3 THEN 'strong_bearish' WHEN score <= "
    "-1 THEN 'bearish' ELSE 'neutral' END"
)
register(
    "signal_summary",
    lambda s, d: shown(signals.signal_summary(_signals(s, d))),
    o.query(
        o.EVENTS,
        o.IND,
        o.SIGNALS,
        _LONG,
        "z AS (SELECT n.ticker, count(*) FILTER (direction = 'bullish') AS n_bullish, count(*) FILTER (direction = 'bearish') AS n_bearish, "
        "count(*) FILTER (direction = 'neutral') AS n_neutral, coalesce(sum(CASE direction WHEN 'bullish' THEN strength WHEN 'bearish' "
        "THEN -strength ELSE 0 END), 0) AS score FROM n LEFT JOIN act USING (ticker) GROUP BY 1)",
        select=f"SELECT ticker, n_bullish, n_bearish, n_neutral, CAST(score AS BIGINT) AS score, {_VERDICT} AS verdict FROM z",
    ),
)


# ---- strategies
def _strategies(s: SparkSession, d: str) -> DataFrame:
    return strategies.with_strategies(_factors(s, d))


for _category in ("trend", "reversal", "volume", "volatility", "multi"):
    _cols = [f"st_{x.id}" for x in strategies.STRATEGIES if x.category == _category]
    register(
        f"strategies_{_category}",
        lambda s, d, n=_cols: shown(_strategies(s, d), [*KEY, *n]),
        o.query(
            o.EVENTS,
            o.IND,
            o.FACTORS,
            o.STRATEGIES,
            select=f"SELECT {_KEY_SQL}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _cols)} FROM st",
        ),
    )
_SCORE = (
    "sc AS (SELECT *, "
    + " + ".join(f"st_{i}" for i in strategies.IDS)
    + " AS score, "
    + " + ".join(f"CASE WHEN st_{i} > 0 THEN 1 ELSE 0 END" for i in strategies.IDS)
    + " AS ups FROM st)"
)
_LABEL = "CASE WHEN score <= -3 THEN 'strong_bearish' WHEN score <= 0 THEN 'bearish' WHEN score <= 3 THEN 'bullish' ELSE 'strong_bullish' END AS consensus"
register(
    "consensus",
    lambda s, d: shown(strategies.aggregate_signals(_strategies(s, d)), [*KEY, "score", "bullish_ratio", "consensus"]),
    o.query(
        o.EVENTS,
        o.IND,
        o.FACTORS,
        o.STRATEGIES,
        _SCORE,
        select=(
            f"SELECT {_KEY_SQL}, CAST(score AS BIGINT) AS score, {o.num('(ups + CASE WHEN score > 0 THEN 1 ELSE 0 END) / 20.0')} AS bullish_ratio, "
            f"{_LABEL} FROM sc"
        ),
    ),
)
register(
    "latest_consensus",
    lambda s, d: shown(
        strategies.latest_consensus(_strategies(s, d)).withColumn(
            "active",
            F.array_join(F.array_sort(F.transform("active", lambda a: F.concat_ws(":", a["strategy"], a["vote"].cast("string")))), ","),
        ),
    ),
    o.query(
        o.EVENTS,
        o.IND,
        o.FACTORS,
        o.STRATEGIES,
        _SCORE,
        f"z AS (SELECT *, max(rn) {o.ALL} AS newest FROM sc)",
        select=(
            f"SELECT ticker, {TS}, CAST(score AS BIGINT) AS score, {o.num('(ups + CASE WHEN score > 0 THEN 1 ELSE 0 END) / 20.0')} AS "
            f"bullish_ratio, {_LABEL}, array_to_string(list_sort(list_filter([{', '.join(f'''CASE WHEN st_{i} <> 0 THEN '{i}:' || st_{i} END''' for i in strategies.IDS)}], "
            "lambda x: x IS NOT NULL)), ',') AS active FROM z WHERE rn = newest"
        ),
    ),
)
register(
    "signal_markers",
    lambda s, d: shown(chart_data.signal_markers(_strategies(s, d))),
    o.query(
        o.EVENTS,
        o.IND,
        o.FACTORS,
        o.STRATEGIES,
        (
            "l AS ("
            + " UNION ALL ".join(f"SELECT ticker, ts, rn, '{i}' AS strategy, st_{i} AS vote FROM st" for i in strategies.IDS)
            + ("), k AS (SELECT *, CASE WHEN vote > 0 THEN 'buy' ELSE 'sell' END AS side, row_number() OVER (PARTITION BY ticker, strategy, "
            "vote > 0 ORDER BY rn DESC) AS k FROM l WHERE vote <> 0)")
        ),
        select=f"SELECT ticker, strategy, side, CAST(k AS BIGINT) AS k, {TS}, CAST(rn AS BIGINT) AS rn FROM k WHERE k <= 15",
    ),
)

# ---- back-tests
_OWN = [(x.id, x.stop_loss, x.take_profit, x.hold_min, x.hold_max) for x in strategies.STRATEGIES]
_SHORT = [(i, *(bt.HOLD_PROFILES["short"][k] for k in (2, 3, 0, 1))) for i in strategies.IDS]
_VOTED = (o.EVENTS, o.IND, o.FACTORS, o.STRATEGIES)
_SUMMARY = ["total_return", "annual_return", "sharpe", "max_drawdown", "win_rate", "avg_return", "avg_hold", "profit_factor"]


def _results(s: SparkSession, d: str, **options) -> DataFrame:
    return bt.run_strategies(_strategies(s, d), {"all": bt._params(strategies.IDS, None)}, **options)


def _trade_log(s: SparkSession, d: str, **options) -> DataFrame:
    return shown(bt.trades(_results(s, d, **options)).select("ticker", "strategy", F.col("exit").alias("exit_rn"), "return_pct", "hold_bars", "reason"))


_LOG = f"SELECT ticker, strategy, exit_rn, {o.num('return_pct')} AS return_pct, hold_bars, reason FROM fold_trades"
# the trades by entry and exit, and as a log; both have the positions closed after the last bar
register(
    "backtest_trades",
    lambda s, d: _trade_log(s, d).withColumn("entry_rn", F.col("exit_rn") - F.col("hold_bars")).select("ticker", "strategy", "entry_rn", "exit_rn", "return_pct", "reason"),
    o.recursive(
        *_VOTED, o.votes(_OWN), o.fold("v", "fold"),
        select=f"SELECT ticker, strategy, exit_rn - hold_bars AS entry_rn, exit_rn, {o.num('return_pct')} AS return_pct, reason FROM fold_trades",
    ),
)
register("backtest_trade_log", _trade_log, o.recursive(*_VOTED, o.votes(_OWN), o.fold("v", "fold"), select=_LOG))
register(
    "backtest_worst_case",
    lambda s, d: _trade_log(s, d, worst_case=True, limit_pct=0.05),
    o.recursive(*_VOTED, o.votes(_OWN), o.fold("v", "fold", worst_case=True, limit=0.05), select=_LOG),
)
register(
    "backtest_equity", lambda s, d: shown(bt.equity_metrics(bt.equity_curve(_results(s, d)), ["ticker", "strategy"]), places=5),
    o.recursive(*_VOTED, o.votes(_OWN), o.fold("v", "fold"), o.summary("fold", "sm"), select=f"SELECT ticker, strategy, {', '.join(f'{o.num(c, 5)} AS {c}' for c in ('max_drawdown', 'last_equity', 'sharpe'))} FROM sm"),
)
_RANKED = (
    "rk AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sharpe DESC, place) AS rank FROM sm JOIN (SELECT DISTINCT strategy, "
    "place FROM v) USING (strategy) WHERE n_trades > 0)"
)
register(
    "backtest_ranking", lambda s, d: shown(bt.rank_strategies(bt.backtest_all(_strategies(s, d), profile="short")), ["ticker", "strategy", "n_trades", "rank", *_SUMMARY]),
    o.recursive(*_VOTED, o.votes(_SHORT), o.fold("v", "fold"), o.summary("fold", "sm"), _RANKED, select=f"SELECT ticker, strategy, n_trades, rank, {_nums(_SUMMARY)} FROM rk"),
)
_BLENDED = ["rsi_extreme", "stochastic_cross", "williams_r_reversal"]
_BLEND_SQL = f"""bl AS (SELECT *, ({' + '.join(f'st_{i}' for i in _BLENDED)}) / 3.0 AS blend FROM st), v AS MATERIALIZED (
    SELECT 'all' AS run, ticker, 'portfolio' AS strategy, rn, close, high, low, CASE WHEN blend > 0.6 THEN 2 WHEN blend < -0.6 THEN -2 WHEN blend > 0.3 THEN 1 WHEN blend < -0.3 THEN -1 ELSE 0 END AS vote,
        0.07 AS stop, 0.12 AS target, 3 AS least_hold, 30 AS most_hold, CAST(100000 AS DOUBLE) AS capital FROM bl)"""
for _name, _size in (("portfolio_blend", 1.0), ("portfolio_blend_half", 0.5)):
    register(
        _name, lambda s, d, size=_size: shown(portfolio.backtest_portfolio(_strategies(s, d), dict.fromkeys(_BLENDED, 1.0), size=size), ["ticker", "strategy", "n_trades", *_SUMMARY]),
        o.recursive(*_VOTED, _BLEND_SQL, o.fold("v", "fold", size=_size), o.summary("fold", "sm"), select=f"SELECT ticker, strategy, n_trades, {_nums(_SUMMARY)} FROM sm"),
    )

# sleeves: the five best of each way to choose, each on its own capital
_GIVEN = f"""vo AS MATERIALIZED (SELECT * REPLACE ('own' AS run) FROM ({o.votes(_OWN).removeprefix('v AS MATERIALIZED ')})),
{o.fold('vo', 'own')}, {o.summary('own', 'so')}, {o.regime()}, cat AS (SELECT * FROM (VALUES {', '.join(f"('{x.id}', '{x.category}')" for x in strategies.STRATEGIES)}) AS t(strategy, category)),
rr AS (
    SELECT so.ticker, strategy, row_number() OVER (PARTITION BY so.ticker ORDER BY sharpe DESC, place) AS rank
    FROM so JOIN cat USING (strategy) JOIN reg ON reg.ticker = so.ticker AND reg.category = cat.category JOIN (SELECT DISTINCT strategy, place FROM v) USING (strategy)
), gv AS (
    SELECT ticker, 'equal' AS run, strategy, 1.0 AS w FROM rk WHERE rank <= 5 UNION ALL SELECT ticker, 'dynamic', strategy, 0.8 FROM rk WHERE rank <= 5
    UNION ALL SELECT ticker, 'sharpe', strategy, greatest(sharpe, 0) FROM rk WHERE rank <= 5 UNION ALL SELECT ticker, 'regime', strategy, 1.0 FROM rr WHERE rank <= 5
), al AS (
    SELECT ticker, run, strategy, w / nullif(sum(w) OVER (PARTITION BY ticker, run), 0) * 100000 AS capital FROM gv
), vs AS MATERIALIZED (
    SELECT v.* REPLACE (al.run AS run, al.capital AS capital) FROM v JOIN al USING (ticker, strategy) WHERE al.capital IS NOT NULL
)"""
_SLEEVES = f"""cv AS (
    SELECT ticker, run, rn, sum(equity) AS equity FROM slv WHERE rn >= 0 GROUP BY ALL
), st1 AS (
    SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret, max(equity) OVER w AS peak FROM cv WINDOW w AS (PARTITION BY ticker, run ORDER BY rn ROWS UNBOUNDED PRECEDING)
), m AS (
    SELECT ticker, run, arg_max(equity, rn) / 100000 - 1 AS total_return, count(*) AS n, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS sharpe,
        min((equity - peak) / peak) AS max_drawdown FROM st1 GROUP BY ALL
), t AS (
    SELECT ticker, run, count(*) AS n_trades, sum(return_pct) AS gains, sum(hold_bars) AS held FROM slv_trades GROUP BY ALL
), bh AS (
    SELECT ticker, (arg_max(close, rn) - arg_min(close, rn)) / nullif(arg_min(close, rn), 0) AS r, count(*) AS n FROM bars GROUP BY 1
), al2 AS (
    SELECT ticker, run AS method, total_return, power(1 + total_return, 1 / greatest(n / 252.0, 0.01)) - 1 AS annual_return, sharpe, max_drawdown, 0.5 AS win_rate,
        coalesce(n_trades, 0) AS n_trades, coalesce(gains, 0) / greatest(coalesce(n_trades, 0), 1) AS avg_return, coalesce(held, 0) / greatest(coalesce(n_trades, 0), 1) AS avg_hold, 1.0 AS profit_factor
    FROM m LEFT JOIN t USING (ticker, run)
    UNION ALL
    SELECT ticker, 'buy_and_hold', r, r / greatest(n / 252.0, 0.01), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM bh
)"""
register(
    "portfolio_methods", lambda s, d: shown(portfolio.analyze_portfolio(_strategies(s, d), profile="short"), ["ticker", "method", "n_trades", *_SUMMARY]),
    o.recursive(*_VOTED, o.votes(_SHORT), o.fold("v", "fold"), o.summary("fold", "sm"), _RANKED, _GIVEN, o.fold("vs", "slv"), _SLEEVES, select=f"SELECT ticker, method, n_trades, {', '.join(o.num(f'CAST({c} AS DOUBLE)') + f' AS {c}' for c in _SUMMARY)} FROM al2"),
)
register(
    "top_strategies",
    lambda s, d: shown(portfolio.top_strategies(_strategies(s, d), profile="short")),
    o.recursive(
        *_VOTED,
        o.votes(_SHORT),
        o.fold("v", "fold"),
        o.summary("fold", "sm"),
        _RANKED,
        select=(
            f"SELECT ticker, rank, strategy, {o.num('round(sharpe, 2)')} AS sharpe, {o.num('round(total_return * 100, 2)')} AS total_return "
            "FROM rk WHERE rank <= 5"
        ),
    ),
)
register(
    "normalised_equity",
    lambda s, d: shown(portfolio.normalised_equity(bt.equity_curve(_results(s, d)), sources.bars_events(s, d))),
    o.recursive(
        *_VOTED,
        o.votes(_OWN),
        o.fold("v", "fold"),
        select=(
            f"SELECT ticker, strategy, rn, {o.num('f.equity / first_value(f.equity) OVER w')} AS equity, {o.num('v.close / first_value(v.close) OVER w')} "
            "AS benchmark FROM fold f JOIN v USING (ticker, strategy, rn) WINDOW w AS (PARTITION BY ticker, strategy ORDER BY rn)"
        ),
    ),
)
register(
    "kelly_shares",
    lambda s, d: shown(
        bt.trades(_results(s, d)).groupBy("ticker", "strategy").agg(F.avg(F.when(F.col("return_pct") > 0, 1.0).otherwise(0.0)).alias("w"), F.coalesce(F.avg(F.when(F.col("return_pct") > 0, F.col("return_pct"))), F.lit(0.0)).alias("a"), F.coalesce(F.abs(F.avg(F.when(F.col("return_pct") <= 0, F.col("return_pct")))), F.lit(0.0)).alias("b")).select(
            "ticker",
            "strategy",
            portfolio.kelly_position(F.col("w"), F.col("a"), F.col("b")).alias("share"),
        ),
    ),
    o.recursive(
        *_VOTED,
        o.votes(_OWN),
        o.fold("v", "fold"),
        "z AS (SELECT ticker, strategy, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) AS w, coalesce(avg(return_pct) FILTER (return_pct "
        "> 0), 0) AS a, coalesce(abs(avg(return_pct) FILTER (return_pct <= 0)), 0) AS b FROM fold_trades GROUP BY 1, 2)",
        select=(
            f"SELECT ticker, strategy, {o.num('CASE WHEN a > 0 AND b > 0 AND w > 0 AND w < 1 THEN greatest(0, least(0.5, (a / b * w - (1 - w)) / (a / b))) ELSE 0 END')} "
            "AS share FROM z"
        ),
    ),
)
register(
    "combined_votes",
    lambda s, d: shown(
        portfolio.combine_signals(_strategies(s, d), {"rsi_extreme": 2.0, "stochastic_cross": 1.0, "williams_r_reversal": 1.0}),
        [*KEY, "blend", "vote"],
    ),
    o.query(
        o.EVENTS,
        o.IND,
        o.FACTORS,
        o.STRATEGIES,
        "z AS (SELECT *, (2 * st_rsi_extreme + st_stochastic_cross + st_williams_r_reversal) / 4.0 AS blend FROM st)",
        select=(
            f"SELECT {_KEY_SQL}, {o.num('blend')} AS blend, CAST(CASE WHEN blend > 0.6 THEN 2 WHEN blend < -0.6 THEN -2 WHEN blend > "
            "0.3 THEN 1 WHEN blend < -0.3 THEN -1 ELSE 0 END AS BIGINT) AS vote FROM z"
        ),
    ),
)
register(
    "buy_and_hold",
    lambda s, d: shown(portfolio.buy_and_hold(sources.bars_events(s, d))),
    o.query(
        o.EVENTS,
        "z AS (SELECT ticker, (arg_max(close, rn) - arg_min(close, rn)) / nullif(arg_min(close, rn), 0) AS r, count(*) AS n FROM bars GROUP BY 1)",
        select=f"SELECT ticker, {o.num('r')} AS total_return, {o.num('r / greatest(n / 252.0, 0.01)')} AS annual_return FROM z",
    ),
)
register(
    "volatility_targets",
    lambda s, d: shown(portfolio.volatility_targeting(sources.bars_orders(s, d)), [*KEY, "position"]),
    o.query(
        o.ORDERS,
        f"y AS (SELECT *, close / nullif({o.lag('close')}, 0) - 1 AS ret FROM bars), z AS (SELECT *, 0.15 / nullif(({o.std('ret', 20, 20)}) "
        "* sqrt(252), 0) AS raw FROM y), x AS (SELECT *, CASE WHEN raw IS NOT NULL THEN greatest(0.1, least(1, raw)) END AS p FROM z)",
        select=f"SELECT {_KEY_SQL}, {o.num(f'coalesce(last_value(p IGNORE NULLS) {o.CUM}, 0.5)')} AS position FROM x",
    ),
)
register(
    "market_regime",
    lambda s, d: shown(portfolio.detect_market_regime(_factors(s, d)).drop("description")),
    o.query(o.EVENTS, o.IND, o.FACTORS, o.regime(), select=f"SELECT ticker, {TS}, regime, category, {o.num('score')} AS score FROM reg"),
)
register(
    "market_regime_daily", lambda s, d: shown(portfolio.detect_market_regime(factors.add_all_factors(sources.bars_parts(s, d))).drop("description")),
    o.query(o.PARTS, o.IND, o.FACTORS, o.regime(), select=f"SELECT ticker, {TS}, regime, category, {o.num('score')} AS score FROM reg"),
)

# ---- similarity and statistics
_Z = "lambda v: CASE WHEN list_stddev_pop(w) > 0 THEN (v - list_avg(w)) / list_stddev_pop(w) ELSE 0 END"
_COMPARE = "list_dot_product(a, b) / 30 AS corr, list_distance(a, b) AS dist"
register(
    "similar_history",
    lambda s, d: shown(similarity.search_historical(sources.bars_orders(s, d)), ["ticker", "start", "corr", "dist", "score", "rank"]),
    o.query(
        o.ORDERS,
        f"w0 AS (SELECT ticker, rn, list(close) OVER ({o.P} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS w, count(*) {o.ALL} AS n FROM "
        f"bars), w1 AS (SELECT ticker, rn, n, list_transform(w, {_Z}) AS z FROM w0 WHERE len(w) = 30), q AS (SELECT ticker, z AS b FROM "
        "w1 WHERE rn = n - 30 AND n >= 120), m AS (SELECT ticker, rn, z AS a, b FROM w1 JOIN q USING (ticker) WHERE rn <= n - 91), c "
        f"AS (SELECT ticker, rn, {_COMPARE} FROM m), k AS (SELECT *, round(corr - dist / 10, 4) AS score FROM c), f AS (SELECT *, row_number() "
        "OVER (PARTITION BY ticker ORDER BY score DESC, rn) AS rank FROM k)",
        select=f"SELECT ticker, rn AS start, {_nums(('corr', 'dist', 'score'))}, rank FROM f WHERE rank <= 5",
    ),
)
_TARGETS = ["Brand#11", "Brand#23", "Brand#35", "Brand#42", "Brand#54"]
register(
    "similar_tickers",
    lambda s, d: shown(
        similarity.search_cross(sources.bars_parts(s, d), s.createDataFrame([(x,) for x in _TARGETS], "ticker string")),
        ["target", "ticker", "corr", "dist", "score", "rank"],
    ),
    o.query(
        o.PARTS,
        "l AS (SELECT ticker, list(close ORDER BY rn) AS w FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rn DESC) "
        f"AS back FROM bars) WHERE back <= 30 GROUP BY 1 HAVING count(*) = 30), z AS (SELECT ticker, list_transform(w, {_Z}) AS z FROM "
        "l), c AS (SELECT q.ticker AS target, x.ticker, list_dot_product(x.z, q.z) / 30 AS corr, list_distance(x.z, q.z) AS dist FROM "
        f"z x JOIN z q ON x.ticker <> q.ticker WHERE q.ticker IN ({', '.join(map(repr, _TARGETS))})), k AS (SELECT *, round(corr - dist "
        "/ 10, 4) AS score FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, ticker) AS rank FROM "
        "k)",
        select=f"SELECT target, ticker, {_nums(('corr', 'dist', 'score'))}, rank FROM f WHERE rank <= 5",
    ),
)
register(
    "pattern_features",
    lambda s, d: shown(similarity.pattern_features(sources.bars_parts(s, d))),
    o.query(
        o.PARTS,
        f"n AS (SELECT *, max(rn) {o.ALL} AS newest FROM bars), l AS (SELECT * FROM n WHERE rn > newest - 30), r AS (SELECT *, close "
        f"/ nullif({o.lag('close')}, 0) - 1 AS ret, max(close) {o.CUM} AS peak FROM l), a AS (SELECT ticker, count(*) AS bars, count(close) "
        "AS n, (arg_max(close, rn) - arg_min(close, rn)) / nullif(arg_min(close, rn), 0) AS t, stddev_pop(ret) AS dev, avg(ret) AS m, "
        "min((close - peak) / peak) AS max_drawdown, regr_slope(close, rn) AS slope, regr_r2(close, rn) AS r2 FROM r GROUP BY 1)",
        select=(
            f"SELECT ticker, CASE WHEN t > 0 THEN 'up' ELSE 'down' END AS direction, {o.num('t')} AS total_return, {o.num('dev * sqrt(252)')} "
            f"AS volatility, {o.num('max_drawdown')} AS max_drawdown, {o.num('CASE WHEN dev > 0 THEN m / dev * sqrt(252) ELSE 0 END')} "
            f"AS sharpe, {o.num('slope')} AS slope, CASE WHEN n < 10 THEN 'unknown' WHEN r2 > 0.7 AND slope > 0 THEN 'strong_uptrend' "
            "WHEN r2 > 0.7 THEN 'strong_downtrend' WHEN r2 > 0.3 AND slope > 0 THEN 'uptrend' WHEN r2 > 0.3 THEN 'downtrend' WHEN abs(t) "
            "< 0.05 THEN 'sideways' WHEN t > 0 THEN 'choppy_up' ELSE 'choppy_down' END AS pattern FROM a WHERE bars = 30"
        ),
    ),
)
_HISTORY = f"""w0 AS (
    SELECT ticker, rn, list(close) OVER ({o.P} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS w, count(*) {o.ALL} AS n FROM bars
), w1 AS (
    SELECT ticker, rn, n, list_transform(w, {_Z}) AS z FROM w0 WHERE len(w) = 30
), q AS (
    SELECT ticker, z AS b FROM w1 WHERE rn = n - 30 AND n >= 120
), c AS (
    SELECT ticker, rn, z AS a, b, {_COMPARE.replace('(a,', '(z,')} FROM w1 JOIN q USING (ticker) WHERE rn <= n - 91
), k AS (
    SELECT *, round(corr - dist / 10, 4) AS score FROM c
), f AS (
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, rn) AS rank FROM k QUALIFY rank <= 5
)"""
# time warping, anti-diagonal by anti-diagonal: the last two are carried as maps from row to cost
_WARP = """d AS (
    SELECT ticker, rn, rank, score, a, b, 0 AS s, MAP {0: abs(a[1] - b[1])} AS last, CAST(MAP {} AS MAP(INTEGER, DOUBLE)) AS earlier FROM f
    UNION ALL
    SELECT ticker, rn, rank, score, a, b, s + 1,
        map_from_entries(list_transform(range(greatest(0, s - 28), least(s + 1, 29) + 1), lambda i: struct_pack(k := CAST(i AS INTEGER), v := abs(a[i + 1] - b[s + 2 - i]) + list_min([coalesce(last[CAST(i AS INTEGER)], 1e300), coalesce(last[CAST(i - 1 AS INTEGER)], 1e300), coalesce(earlier[CAST(i - 1 AS INTEGER)], 1e300)])))), last
    FROM d WHERE s < 58
)"""
register(
    "similar_history_dtw",
    lambda s, d: shown(similarity.search_historical(sources.bars_events(s, d), dtw=True), ["ticker", "start", "score", "dtw", "rank"]),
    o.recursive(
        o.EVENTS,
        _HISTORY,
        _WARP,
        select=f"SELECT ticker, rn AS start, {_nums(['score'])}, {o.num('last[29]')} AS dtw, rank FROM d WHERE s = 58",
    ),
)
register(
    "forward_returns",
    lambda s, d: shown(stats.forward_returns(indicators.add_indicators(sources.bars_events(s, d))), [*KEY, *(f"fwd_{n}" for n in stats.HORIZONS)]),
    o.query(
        o.EVENTS,
        select=(
            f"SELECT {_KEY_SQL}, {', '.join(o.num(f'lead(close, {n}) OVER ({o.P}) / nullif(close, 0) - 1') + f' AS fwd_{n}' for n in stats.HORIZONS)} "
            "FROM bars"
        ),
    ),
)
_EVENTS_SQL = (
    f"fr AS (SELECT ticker, rn, {', '.join(f'lead(close, {n}) OVER ({o.P}) / nullif(close, 0) - 1 AS f{n}' for n in stats.HORIZONS)} "
    f"FROM bars), ev AS (SELECT l.ticker, l.signal, l.rn, h, CASE h {' '.join(f'WHEN {n} THEN f{n}' for n in stats.HORIZONS)} END AS "
    f"ret FROM l JOIN fr USING (ticker, rn), unnest([{', '.join(map(str, stats.HORIZONS))}]) AS u(h) WHERE strength = 1 AND {' AND '.join(f'f{n} IS NOT NULL' for n in stats.HORIZONS)}), "
    "wl AS (SELECT *, exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) OVER w) AS wealth FROM ev WINDOW w AS (PARTITION BY ticker, signal, "
    "h ORDER BY rn ROWS UNBOUNDED PRECEDING)), pk AS (SELECT *, max(wealth) OVER (PARTITION BY ticker, signal, h ORDER BY rn ROWS UNBOUNDED "
    "PRECEDING) AS peak FROM wl)"
)
register(
    "signal_statistics",
    lambda s, d: shown(stats.signal_stats(_signals(s, d))),
    o.query(
        o.EVENTS,
        o.IND,
        o.SIGNALS,
        _LONG,
        _EVENTS_SQL,
        select=(
            f"SELECT ticker, signal, CAST(h AS BIGINT) AS horizon, count(*) AS events, {o.num('avg(ret)')} AS mean, {o.num('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')} "
            f"AS win_rate, {o.num('max(ret)')} AS best, {o.num('min(ret)')} AS worst, {o.num('quantile_cont(ret, 0.5)')} AS median, {o.num('min((wealth - peak) / nullif(peak, 0))')} "
            "AS max_drawdown FROM pk GROUP BY 1, 2, 3 HAVING count(*) >= 3"
        ),
    ),
)
register(
    "signal_judgements",
    lambda s, d: shown(stats.judge_signals(stats.signal_stats(_signals(s, d)))),
    o.query(
        o.EVENTS,
        o.IND,
        o.SIGNALS,
        _LONG,
        _EVENTS_SQL,
        select=(
            "SELECT ticker, signal, n AS events, CASE WHEN n < 10 THEN 'insufficient' WHEN win >= 60 AND m > 0 THEN 'bullish' "
            "WHEN win <= 45 AND m < 0 THEN 'bearish' ELSE 'neutral' END AS judgement FROM (SELECT ticker, signal, count(*) AS n, "
            "round(avg(CASE WHEN ret > 0 THEN 100.0 ELSE 0 END) + 1e-9, 1) AS win, round(avg(ret) * 100 + 1e-9, 2) AS m FROM pk WHERE h = 5 GROUP BY 1, 2 HAVING count(*) >= 3)"
        ),
    ),
)
_SIGNAL_SQL = (o.EVENTS, o.IND, o.SIGNALS, _LONG, _EVENTS_SQL)
register("overall_judgements", lambda s, d: shown(stats.overall_judgement(stats.judge_signals(stats.signal_stats(_signals(s, d), least=1)))), o.query(*_SIGNAL_SQL, """j AS (
    SELECT ticker, signal, count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 100.0 ELSE 0 END) + 1e-9, 1) AS win, round(avg(ret) * 100 + 1e-9, 2) AS m FROM pk WHERE h = 5 GROUP BY 1, 2
), t AS (
    SELECT ticker, count(*) FILTER (n >= 10 AND win >= 60 AND m > 0) AS n_bullish, count(*) FILTER (n >= 10 AND win <= 45 AND m < 0) AS n_bearish, CAST(sum(n) AS BIGINT) AS samples FROM j GROUP BY 1
)""", select="SELECT *, CASE WHEN n_bullish > n_bearish THEN 'bullish' WHEN n_bearish > n_bullish THEN 'bearish' ELSE 'neutral' END AS overall FROM t"))
register("signal_report", lambda s, d: stats.report(stats.signal_stats(_signals(s, d))), o.query(*_SIGNAL_SQL, """j AS (
    SELECT ticker, signal, h, count(*) AS n, avg(ret) AS m, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win FROM pk GROUP BY 1, 2, 3 HAVING count(*) >= 3
)""", select="SELECT ticker, '# ' || ticker || chr(10) || chr(10) || '| signal | horizon | events | mean | win rate |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg(printf('| %s | %d | %d | %.2f%% | %.1f%% |', signal, h, n, round(m * 100 + 1e-9, 2), round(win * 100 + 1e-9, 1)), chr(10) ORDER BY signal, h) AS markdown FROM j GROUP BY ticker"))
register("full_report", lambda s, d: stats.full_report(_signals(s, d)), o.query(*_SIGNAL_SQL, """j AS (
    SELECT ticker, signal, h, count(*) AS n, avg(ret) AS m, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win FROM pk GROUP BY 1, 2, 3
), tb AS (
    SELECT ticker, '| signal | horizon | events | mean | win rate |' || chr(10) || '|---|---|---|---|---|' || chr(10) || string_agg(printf('| %s | %d | %d | %.2f%% | %.1f%% |', signal, h, n, round(m * 100 + 1e-9, 2), round(win * 100 + 1e-9, 1)), chr(10) ORDER BY signal, h) AS t
    FROM j WHERE n >= 3 GROUP BY 1
), t AS (
    SELECT ticker, count(*) FILTER (n >= 10 AND round(win * 100 + 1e-9, 1) >= 60 AND round(m * 100 + 1e-9, 2) > 0) AS up, count(*) FILTER (n >= 10 AND round(win * 100 + 1e-9, 1) <= 45 AND round(m * 100 + 1e-9, 2) < 0) AS down, CAST(sum(n) AS BIGINT) AS samples FROM j WHERE h = 5 GROUP BY 1
), a AS (
    SELECT ticker, string_agg(printf('- %s (%s, %d)', signal, direction, occurrences), chr(10) ORDER BY printf('- %s (%s, %d)', signal, direction, occurrences)) AS l FROM act GROUP BY 1
)""", select="""
SELECT n.ticker, '# ' || n.ticker || chr(10) || chr(10) || '## Active signals' || chr(10) || chr(10) || coalesce(l, 'none') || chr(10) || chr(10) || '## Statistics' || chr(10) || chr(10) || coalesce(tb.t, 'too few events')
    || chr(10) || chr(10) || '## Verdict' || chr(10) || chr(10) || CASE WHEN t.ticker IS NULL THEN 'no events'
    ELSE printf('%s: %d bullish and %d bearish signals, %d samples', CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END, up, down, samples) END AS markdown
FROM n LEFT JOIN a ON a.ticker = n.ticker LEFT JOIN tb ON tb.ticker = n.ticker LEFT JOIN t ON t.ticker = n.ticker"""))

# ---- chart data
# 0.2 and 0.18 are the limits of the single and the multiple chart; levels of daily order prices lie further apart
for _name, _source, _sql, _within in (("fibonacci_levels", sources.bars_orders, o.ORDERS, 0.9), ("fibonacci_levels_near", sources.bars_parts, o.PARTS, 0.2), ("fibonacci_levels_multi", sources.bars_parts, o.PARTS, 0.18)):
    register(
        _name,
        lambda s, d, f=_source, w=_within: shown(chart_data.fibonacci_levels(f(s, d), within=w)),
        o.query(
            _sql,
            f"z AS (SELECT *, max(rn) {o.ALL} AS newest FROM bars), y AS (SELECT ticker, min(low) AS lo, max(high) AS hi, arg_max(close, "
            "rn) AS close FROM z WHERE rn > newest - 120 GROUP BY 1), x AS (SELECT ticker, close, ratio, lo + (hi - lo) * ratio AS level "
            "FROM y, unnest([0.236, 0.382, 0.5, 0.618, 0.786]) AS u(ratio))",
            select=(
                f"SELECT ticker, {o.num('CAST(ratio AS DOUBLE)')} AS ratio, {o.num('level')} AS level FROM x WHERE abs(level - close) / nullif(close, "
                f"0) < {_within}"
            ),
        ),
    )


def _pivots(x: str, extreme: str) -> str:
    return f"SELECT ticker, {x} AS price FROM (SELECT *, count(*) OVER w AS n, {extreme}({x}) OVER w AS e FROM bars WINDOW w AS ({o.P} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE n = 11 AND {x} = e"


register("support_clusters", lambda s, d: shown(chart_data.support_resistance_clusters(sources.bars_orders(s, d))), o.query(o.ORDERS, f"""pv AS (
    SELECT 'support' AS side, * FROM ({_pivots('low', 'min')}) UNION ALL SELECT 'resistance', * FROM ({_pivots('high', 'max')})
), lim AS (
    SELECT ticker, 0.4 * CASE WHEN count(*) >= 20 THEN avg(high - low) FILTER (rn > newest - 20) ELSE 0.02 * arg_max(close, rn) END AS gap, arg_max(close, rn) AS close
    FROM (SELECT *, max(rn) {o.ALL} AS newest FROM bars) GROUP BY ticker
), f AS (
    SELECT pv.*, close, CASE WHEN price - lag(price) OVER (PARTITION BY ticker, side ORDER BY price) < gap THEN 0 ELSE 1 END AS fresh FROM pv JOIN lim USING (ticker)
), c AS (
    SELECT *, sum(fresh) OVER (PARTITION BY ticker, side ORDER BY price ROWS UNBOUNDED PRECEDING) AS k FROM f
), m AS (
    SELECT ticker, side, avg(price) AS level, count(*) AS touches, any_value(close) AS close FROM c GROUP BY ticker, side, k
), t AS (
    SELECT *, row_number() OVER (PARTITION BY ticker, side ORDER BY abs(level - close), level) AS rank FROM m WHERE CASE side WHEN 'support' THEN level < close ELSE level > close END
)""", select=f"SELECT ticker, side, rank, {o.num('level')} AS level, touches FROM t WHERE rank <= 3"))
register(
    "scaled_obv",
    lambda s, d: shown(chart_data.scaled_obv(_factors(s, d))),
    o.query(
        o.EVENTS,
        o.IND,
        o.FACTORS,
        select=(
            f"SELECT {_KEY_SQL}, {o.num(f'(obv - min(obv) {o.ALL}) / nullif(max(obv) {o.ALL} - min(obv) {o.ALL}, 0) * (max(volume) {o.ALL}) * 0.8')} "
            "AS obv_scaled FROM fac"
        ),
    ),
)
register(
    "last_change",
    lambda s, d: shown(chart_data.last_change(sources.bars_events(s, d))),
    o.query(
        o.EVENTS,
        f"z AS (SELECT *, {o.lag('close')} AS c1, max(rn) {o.ALL} AS newest FROM bars)",
        select=f"SELECT ticker, {TS}, {o.num('close')} AS close, {o.num('(close / nullif(c1, 0) - 1) * 100')} AS change_pct FROM z WHERE rn = newest",
    ),
)


def _chart_lines(side: str, x: str, extreme: str, span: int) -> str:
    """Pivots of one side and span, newest first, as (ticker, side, span, rn, y, back)."""
    frame = f"{o.P} ROWS BETWEEN {span} PRECEDING AND {span} FOLLOWING"
    return f"""SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY rn DESC) AS back FROM (
        SELECT ticker, '{side}' AS side, {span} AS span, rn, {x} AS y, count({x}) OVER ({frame}) AS seen, {extreme}({x}) OVER ({frame}) AS e, count(*) {o.ALL} AS n FROM bars
    ) WHERE seen = {2 * span + 1} AND y = e AND n >= {4 * span}"""


_apart = lambda i, *before: " AND ".join(["r.s[%d] IS NOT NULL" % i, *(f"NOT (k{j} AND abs(s[{i}].slope - s[{j}].slope) <= 5e-5)" for j in before)])
_CHART_LINES = f"""pv AS (
    {' UNION ALL '.join(_chart_lines(side, x, extreme, span) for side, x, extreme in (('up', 'low', 'min'), ('down', 'high', 'max')) for span in chart_data.SPANS)}
), tries AS (
    SELECT ticker, side, span, k, regr_slope(y, rn) AS slope, regr_intercept(y, rn) AS intercept, regr_r2(y, rn) AS r2, min(rn) AS first_rn
    FROM pv, unnest([3, 4, 5]) AS u(k) WHERE back <= k GROUP BY ALL HAVING count(*) = k
), good AS (
    SELECT * FROM tries WHERE r2 > 0.35 QUALIFY row_number() OVER (PARTITION BY ticker, side, span ORDER BY k) = 1
), listed AS (
    SELECT ticker, side, list(struct_pack(span := span, slope := slope, intercept := intercept, r2 := r2, first_rn := first_rn) ORDER BY r2 DESC, span) AS s FROM good GROUP BY ticker, side
), k1 AS (SELECT r.*, true AS k1 FROM listed r), k2 AS (SELECT r.*, {_apart(2, 1)} AS k2 FROM k1 r), k3 AS (SELECT r.*, {_apart(3, 1, 2)} AS k3 FROM k2 r), k4 AS (SELECT r.*, {_apart(4, 1, 2, 3)} AS k4 FROM k3 r)
, kept AS (SELECT ticker, side, unnest(list_filter([{', '.join(f'CASE WHEN k{i} THEN s[{i}] END' for i in (1, 2, 3, 4))}], lambda l: l IS NOT NULL)) AS l FROM k4)"""
register(
    "chart_trend_lines",
    lambda s, d: shown(chart_data.trend_lines(sources.bars_events(s, d))),
    o.query(
        o.EVENTS,
        _CHART_LINES,
        select=(
            f"SELECT ticker, side, CAST(l.span AS BIGINT) AS span, {', '.join(f'{o.num(f"l.{c}")} AS {c}' for c in ('slope', 'intercept', 'r2'))}, "
            "CAST(l.first_rn AS BIGINT) AS first_rn FROM kept"
        ),
    ),
)
_NUMERIC = [n for g in factors.GROUPS.values() for n in g if n not in _OTHER]
register(
    "latest_factors", lambda s, d: shown(factors.latest_factors(_factors(s, d))),
    o.query(o.EVENTS, o.IND, o.FACTORS, f"z AS (SELECT *, max(rn) {o.ALL} AS newest FROM fac), l AS (" + " UNION ALL ".join(f"SELECT ticker, ts, '{n}' AS factor, CAST({n} AS DOUBLE) AS value FROM z WHERE rn = newest" for n in _NUMERIC) + ")", select=f"SELECT ticker, {TS}, factor, {o.num('value')} AS value FROM l WHERE value IS NOT NULL"),
)
register(
    "window_shapes",
    lambda s, d: shown(
        similarity.extract_windows(sources.bars_events(s, d)).select(
            "ticker",
            "rn",
            F.get("shape", F.lit(0)).alias("first"),
            F.get("shape", F.lit(29)).alias("last"),
        ),
    ),
    o.query(
        o.EVENTS,
        f"w0 AS (SELECT ticker, rn, list(close) {o.r(30)} AS w FROM bars), w1 AS (SELECT ticker, rn, list_transform(w, {_Z}) AS z FROM "
        "w0 WHERE len(w) = 30)",
        select=f"SELECT ticker, CAST(rn AS BIGINT) AS rn, {o.num('z[1]')} AS first, {o.num('z[30]')} AS last FROM w1",
    ),
)

# ---- screening and news
register(
    "screen_candidates",
    lambda s, d: shown(screener.candidates(sources.bars_parts(s, d), 10)),
    o.query(
        o.PARTS,
        select=(
            f"SELECT ticker, {o.num('arg_max(close, ts)')} AS close FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 180 DAY "
            "GROUP BY 1 ORDER BY arg_max(close, ts) DESC, ticker LIMIT 10"
        ),
    ),
)
_RECENT = f"""near AS (
    SELECT * FROM (SELECT ticker, ts, open, high, low, close, volume, max(ts) {o.ALL} AS last, max(ts) OVER () AS newest FROM all_bars) WHERE ts >= CAST(last AS DATE) - INTERVAL 180 DAY
), chosen AS (
    SELECT ticker, arg_max(close, ts) AS close FROM near WHERE ts >= newest - INTERVAL 180 DAY GROUP BY 1 HAVING count(*) > 0 ORDER BY 2 DESC, 1 LIMIT 100
), bars AS (
    SELECT n.* EXCLUDE (last, newest), row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS rn, count(*) {o.ALL} AS n_bars FROM near n SEMI JOIN chosen USING (ticker) QUALIFY n_bars >= 50
)"""
_SCREEN = f"""top AS (
    SELECT ticker, strategy, sharpe, row_number() OVER (PARTITION BY ticker ORDER BY sharpe DESC, place) AS rank
    FROM sm JOIN (SELECT DISTINCT strategy, place FROM v) USING (strategy) WHERE n_trades >= 3 QUALIFY rank <= 5
), bl AS (
    SELECT v.ticker, rn, any_value(close) AS close, any_value(high) AS high, any_value(low) AS low, avg(vote) AS blend FROM v SEMI JOIN top USING (ticker, strategy) GROUP BY v.ticker, rn
), bv AS MATERIALIZED (
    SELECT 'all' AS run, ticker, 'portfolio' AS strategy, rn, close, high, low, CASE WHEN blend > 0.6 THEN 2 WHEN blend < -0.6 THEN -2 WHEN blend > 0.3 THEN 1 WHEN blend < -0.3 THEN -1 ELSE 0 END AS vote,
        0.04 AS stop, 0.08 AS target, 1 AS least_hold, 15 AS most_hold, CAST(100000 AS DOUBLE) AS capital FROM bl
), {o.fold('bv', 'bf', worst_case=True)}, {o.summary('bf', 'bs')}, {o.regime()}, best AS (
    SELECT ticker, avg(sharpe) AS avg_sharpe, arg_min(strategy, rank) AS best_strategy, max(sharpe) AS best_sharpe FROM top GROUP BY 1
), z AS (
    SELECT *, max(rn) {o.ALL} AS newest FROM sc
), y AS (
    SELECT z.ticker, CAST(n_bars AS BIGINT) AS n_bars, round(z.close, 2) AS close, {_LABEL.replace('score', 'z.score')}, CAST(z.score AS BIGINT) AS score, reg.regime, round(reg.score, 0) AS regime_score,
        round(coalesce(avg_sharpe, 0), 2) AS avg_sharpe, round(coalesce(bs.total_return * 100, 0), 2) AS pf_return, best_strategy, round(coalesce(best_sharpe, 0), 2) AS best_sharpe
    FROM z LEFT JOIN best USING (ticker) LEFT JOIN bs USING (ticker) LEFT JOIN reg USING (ticker) WHERE rn = newest
), x AS (
    SELECT *, round(CASE consensus WHEN 'strong_bullish' THEN 30 WHEN 'bullish' THEN 15 WHEN 'bearish' THEN -15 WHEN 'strong_bearish' THEN -30 ELSE 0 END + 2 * score + 10 * avg_sharpe + 0.5 * pf_return + 0.5 * regime_score, 1) AS total FROM y
)"""
register(
    "screen", lambda s, d: shown(screener.screen(sources.bars_parts(s, d), profile="short"), places=4),
    o.recursive(o.PARTS.replace("bars AS (", "all_bars AS (", 1), _RECENT, o.IND, o.FACTORS, o.STRATEGIES, o.votes(_SHORT), o.fold("v", "fold", worst_case=True), o.summary("fold", "sm"), _SCORE, _SCREEN, select=f"""
SELECT ticker, n_bars, {o.num('close', 4)} AS close, consensus, score, CAST(0 AS BIGINT) AS signal_bull, CAST(0 AS BIGINT) AS signal_bear, CAST(0 AS BIGINT) AS signal_net, regime, {o.num('regime_score', 4)} AS regime_score,
    {o.num('avg_sharpe', 4)} AS avg_sharpe, {o.num('pf_return', 4)} AS pf_return, best_strategy, {o.num('best_sharpe', 4)} AS best_sharpe, {o.num('total', 4)} AS total FROM x ORDER BY total DESC, ticker LIMIT 30"""),
)
_KEYWORDS = [("under", "Technology", "XLK", "positive", 1.5), ("license", "Industrials", "XLI", "negative", 1.2), ("token", "Financials", "XLF", "mixed", 1.0), ("Idiot", None, "SPY", "negative", 1.5)]


def _keywords(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_KEYWORDS, "keyword string, sector string, etf string, direction string, weight double")


_K = (
    "kw AS (SELECT * FROM (VALUES "
    + ", ".join(f"({', '.join('NULL' if v is None else repr(v) for v in k)})" for k in _KEYWORDS)
    + ") AS t(keyword, sector, etf, direction, weight)), hit AS (SELECT doc_id, kw.* FROM documents JOIN kw ON contains(lower(text), lower(keyword)))"
)
register(
    "news_matches",
    lambda s, d: shown(news.match_keywords(s.read.parquet(f"{d}/documents.parquet"), _keywords(s))),
    o.query(_K, select="SELECT doc_id, keyword, sector, etf, direction, CAST(weight AS DOUBLE) AS weight FROM hit"),
)
_ETF = {"XLK": "click", "XLI": "view", "SPY": "error"}


def _etf_bars(s: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for e, t in _ETF.items() for x in (t, e)])
    return sources.bars_events(s, d).withColumn("ticker", F.coalesce(F.element_at(names, F.col("ticker")), F.col("ticker")))


_TREND = (
    f"nm AS (SELECT * REPLACE (CASE ticker {' '.join(f'''WHEN '{t}' THEN '{e}' ''' for e, t in _ETF.items())} ELSE ticker END AS ticker) "
    f"FROM bars), av AS (SELECT *, {o.avg('close', 20)} AS a, {o.avg('close', 60)} AS b, max(rn) {o.ALL} AS newest FROM nm), tr AS (SELECT "
    "ticker, CASE WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'flat' END AS trend FROM av WHERE rn = newest)"
)
register("etf_trends", lambda s, d: news.etf_trend(_etf_bars(s, d)), o.query(o.EVENTS, _TREND, select="SELECT ticker, trend FROM tr"))
register(
    "news_scores",
    lambda s, d: shown(news.news_scores(news.match_keywords(s.read.parquet(f"{d}/documents.parquet"), _keywords(s)), news.etf_trend(_etf_bars(s, d)))),
    o.query(
        o.EVENTS,
        _TREND,
        _K,
        "g AS (SELECT doc_id, etf, count(*) AS hits, CAST(sum(CASE direction WHEN 'positive' THEN weight WHEN 'negative' THEN -weight "
        "ELSE 0 END) AS DOUBLE) AS lean FROM hit WHERE etf IS NOT NULL GROUP BY 1, 2)",
        select=(
            f"SELECT doc_id, etf, hits, {o.num('lean')} AS lean, CAST(CASE WHEN lean > 0 AND trend = 'up' THEN 2 WHEN lean > 0 THEN 1 "
            "WHEN lean < 0 AND trend = 'down' THEN -2 WHEN lean < 0 THEN -1 ELSE 0 END AS BIGINT) AS score FROM g LEFT JOIN tr ON tr.ticker "
            "= g.etf"
        ),
    ),
)
register(
    "sector_rotation",
    lambda s, d: shown(news.sector_rotation(sources.bars_parts(s, d))),
    o.query(
        o.PARTS,
        f"z AS (SELECT *, close / nullif({o.lag('close', 20)}, 0) - 1 AS ret, max(rn) {o.ALL} AS newest FROM bars), y AS (SELECT ticker, "
        "ret, row_number() OVER (ORDER BY ret DESC, ticker) AS best, row_number() OVER (ORDER BY ret, ticker DESC) AS worst FROM z WHERE "
        "rn = newest)",
        select=(
            f"SELECT ticker, {o.num('ret')} AS ret, CASE WHEN best <= 5 THEN best WHEN worst <= 3 THEN worst END AS rank, CASE WHEN best "
            "<= 5 THEN 'keep' WHEN worst <= 3 THEN 'avoid' ELSE 'hold' END AS action FROM y"
        ),
    ),
)
register(
    "long_lower_shadows",
    lambda s, d: shown(news.long_lower_shadow(sources.bars_events(s, d)), [*KEY, "long_lower_shadow"]),
    o.query(
        o.EVENTS,
        select=(
            f"SELECT {_KEY_SQL}, CAST(CASE WHEN least(open, close) - low > 2 * abs(close - open) AND least(open, close) - low > high "
            "- greatest(open, close) AND close > open THEN 1 ELSE 0 END AS BIGINT) AS long_lower_shadow FROM bars"
        ),
    ),
)

# ---- dimensions
register("html_links", lambda s, d: shown(dimensions.html_links(s.read.parquet(f"{d}/pages.parquet"))), """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>', 0, 'is') AS l FROM pages), e AS (SELECT page_id, k - 1 AS place, l[k] AS a FROM a, unnest(range(1, len(l) + 1)) AS t(k))
SELECT page_id, place, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')) AS text FROM e""")


def _region_tables(s: SparkSession, d: str) -> DataFrame:
    """A page for every region with a table of its nations."""
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td>\n<TD class='x'><b>"), "n_name", F.lit("</b> &amp; co </TD></tr>"))
    nations = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("page_id"), "n_nationkey", row.alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]), "")  # a few dozen nations
    return nations.groupBy("page_id").agg(F.concat(F.lit("<p>x</p><table><tr><th>key</th><th>name</th></tr>"), body, F.lit("</table>")).alias("html"))


register("html_cells", lambda s, d: shown(dimensions.html_cells(_region_tables(s, d))), """
WITH n AS (
    SELECT CAST(n_regionkey AS BIGINT) AS page_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row, CAST(n_nationkey AS VARCHAR) AS a, n_name || ' & co' AS b FROM nation
), h AS (
    SELECT page_id, row, a, b FROM n UNION ALL SELECT DISTINCT page_id, 0, 'key', 'name' FROM n
)
SELECT page_id, row, CAST(0 AS BIGINT) AS cell, a AS text FROM h UNION ALL SELECT page_id, row, 1, b FROM h""")


def _companies(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as companies; every third has no summary."""
    supplier = s.read.parquet(f"{d}/supplier.parquet")
    summary = F.when(F.col("s_suppkey") % 3 == 0, F.lit("nan")).otherwise(F.concat(F.lit("A supplier of nation "), F.col("s_nationkey").cast("string")))
    raw = supplier.select(F.regexp_replace("s_name", "#", ".").alias("Symbol"), F.col("s_name").alias("Security"), F.col("s_nationkey").cast("string").alias("GICS Sector"), summary.alias("BusinessSummary"))
    return dimensions.companies(raw)


register("company_enrichment", lambda s, d: dimensions.enrich(_companies(s, d), dimensions.missing_summaries(_companies(s, d)).select("symbol", F.concat(F.lit("Found for "), "symbol").alias("summary"))), """
SELECT replace(replace(s_name, '#', '.'), '.', '-') AS symbol, s_name AS company, CAST(s_nationkey AS VARCHAR) AS sector,
    CASE WHEN s_suppkey % 3 = 0 THEN 'Found for ' || replace(replace(s_name, '#', '.'), '.', '-') ELSE 'A supplier of nation ' || s_nationkey END AS summary FROM supplier""")
register(
    "ticker_list",
    lambda s, d: sources.ticker_list(
        sources.bars_parts(s, d),
        s.read.parquet(f"{d}/part.parquet").select(
            F.col("p_brand").alias("symbol"),
            F.col("p_brand").alias("company"),
            F.lit("Parts").alias("sector"),
        ),
        "#1",
    ),
    "SELECT DISTINCT p_brand AS ticker, substr(p_brand, 1, 30) AS name, 'Parts' AS sector FROM lineitem JOIN part ON l_partkey = p_partkey "
    "WHERE contains(p_brand, '#1')",
)
register(
    "bars_with_fallback",
    lambda s, d: shown(
        sources.with_fallback(sources.bars_orders(s, d).where("rn < 400 or ticker > '3'"), sources.bars_orders(s, d), "2y").groupBy("ticker").agg(
            F.count("*").alias("n"),
            F.max("ts").alias("ts"),
        ),
    ),
    o.query(
        o.ORDERS,
        "c AS (SELECT ticker, count(*) AS n, count(*) FILTER (rn < 400 OR ticker > '3') AS short, max(ts) AS ts, max(ts) FILTER (rn "
        "< 400 OR ticker > '3') AS short_ts FROM bars GROUP BY 1)",
        select=(
            "SELECT ticker, CASE WHEN short < 292 AND n > short THEN n ELSE short END AS n, strftime(CASE WHEN short < 292 AND n > short "
            "THEN ts ELSE short_ts END, '%Y-%m-%d %H:%M:%S') AS ts FROM c"
        ),
    ),
)


def _normalised(s: SparkSession, d: str) -> DataFrame:
    raw = sources.bars_orders(s, d).select(F.col("ticker").alias("Symbol"), F.col("ts").alias(" Date "), F.col("open").alias("OPEN"), F.col("close").alias("Close"), F.when(F.col("rn") % 2 == 0, F.col("close") / 2).alias("Adj Close"))
    return shown(sources.normalise_columns(raw))


register(
    "normalised_columns",
    _normalised,
    o.query(
        o.ORDERS,
        select=f"SELECT ticker, {TS}, {_nums(('open', 'close'))}, {o.num('CASE WHEN rn % 2 = 0 THEN close / 2 ELSE close END')} AS adj_close FROM bars",
    ),
)


def _three_way(s: SparkSession, d: str) -> DataFrame:
    """Every brand judged with the news and trend of one of the sectors and its own daily returns."""
    bars = sources.bars_parts(s, d)
    etf = F.get(F.array(*map(F.lit, _ETF)), F.expr("cast(substr(ticker, 7, 1) as int) % 3"))
    own = indicators.add_indicators(bars).groupBy("ticker").agg(F.avg(F.when(F.col("daily_ret") > 0, 1.0).when(F.col("daily_ret").isNotNull(), 0.0)).alias("win_rate"), F.avg("daily_ret").alias("mean")).withColumn("etf", etf)
    trends = news.etf_trend(_etf_bars(s, d))
    scored = news.news_scores(news.match_keywords(s.read.parquet(f"{d}/documents.parquet"), _keywords(s)), trends)
    return shown(news.three_way(scored, trends, own))


_BRANDS = o.PARTS.replace("bars AS (", "brand_bars AS (", 1).replace("b0 AS", "b1 AS", 1).replace("FROM b0", "FROM b1", 1)
register("three_way", _three_way, o.query(o.EVENTS, _TREND, _K, _BRANDS, f"""g AS (
    SELECT doc_id, etf, CAST(sum(CASE direction WHEN 'positive' THEN weight WHEN 'negative' THEN -weight ELSE 0 END) AS DOUBLE) AS lean FROM hit WHERE etf IS NOT NULL GROUP BY 1, 2
), nw AS (
    SELECT etf, sign(sum(CASE WHEN lean > 0 AND trend = 'up' THEN 2 WHEN lean > 0 THEN 1 WHEN lean < 0 AND trend = 'down' THEN -2 WHEN lean < 0 THEN -1 ELSE 0 END)) AS a FROM g LEFT JOIN tr ON tr.ticker = g.etf GROUP BY 1
), r AS (
    SELECT ticker, close / nullif({o.lag('close')}, 0) - 1 AS ret FROM brand_bars
), ow AS (
    SELECT ticker, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0 END) AS w, avg(ret) AS m, ['XLK', 'XLI', 'SPY'][CAST(substr(ticker, 7, 1) AS INTEGER) % 3 + 1] AS etf FROM r GROUP BY 1
), z AS (
    SELECT ow.ticker, ow.etf, CAST(coalesce(a, 0) AS BIGINT) AS news_score, CAST(CASE trend WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END AS BIGINT) AS trend_score,
        CAST(CASE WHEN w > 0.6 AND m > 0 THEN 1 WHEN w < 0.45 THEN -1 ELSE 0 END AS BIGINT) AS stock_score
    FROM ow LEFT JOIN nw USING (etf) LEFT JOIN tr ON tr.ticker = ow.etf
), y AS (
    SELECT *, news_score + trend_score + stock_score AS total FROM z
)""", select="SELECT *, CASE WHEN total >= 2 THEN 'strong_bullish' WHEN total = 1 THEN 'bullish' WHEN total = 0 THEN 'neutral' WHEN total = -1 THEN 'bearish' ELSE 'strong_bearish' END AS judgement FROM y"))


# ---- streaming
def streaming_bars(s: SparkSession, d: str) -> DataFrame:
    """The event bars, built by a stream over the events file.

    Updated bars are appended with their batch, so that state older than the watermark
    can go; the newest version of a bar counts.
    """
    out = f"{_folder(s)}/streaming-{uuid.uuid4().hex}"
    schema = s.read.parquet(f"{d}/events.parquet").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ticks = events.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1).alias("size"), F.col("event_id").alias("at"))
    bars = ohlcv.streaming_bars(ticks)
    keep = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{out}/bars")
    query = bars.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    newest = s.read.parquet(f"{out}/bars").groupBy("ticker", "ts").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "batch").alias("b"))
    return shown(newest.select("ticker", "ts", "b.*"), ["ticker", "ts", "open", "high", "low", "close", "volume"])


def _folder(s: SparkSession) -> str:
    """The folder that driver and executors share; a local one where none is set."""
    return shared_folder(s)


register(
    "streaming_bars",
    streaming_bars,
    o.query(o.EVENTS, select=f"SELECT ticker, {TS}, {_nums(('open', 'high', 'low', 'close'))}, volume FROM bars"),
)
