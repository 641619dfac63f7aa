"""SQL for an independent engine, built from common table expressions.

Written from the definitions, not from the DataFrame code: windows are spelled out,
signals and strategies are CASE chains.
"""

from __future__ import annotations

P = "PARTITION BY ticker ORDER BY rn"


def r(n: int) -> str:
    return f"OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


CUM = f"OVER ({P} ROWS UNBOUNDED PRECEDING)"
ALL = "OVER (PARTITION BY ticker)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({P})"


def avg(x: str, n: int, least: int = 1) -> str:
    return f"avg({x}) {r(n)}" if least == 1 else f"CASE WHEN count({x}) {r(n)} >= {least} THEN avg({x}) {r(n)} END"


def std(x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {r(n)} >= {least} THEN stddev_samp({x}) {r(n)} END"


def slope(x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {r(n)} >= {least} THEN regr_slope({x}, rn) {r(n)} / nullif(avg({x}) {r(n)}, 0) END"


def ema(x: str, span: int) -> str:
    q = 1 - 2 / (span + 1)
    return f"power({q!r}, rn) * sum(CASE WHEN rn = 0 THEN 1.0 ELSE {2 / (span + 1)!r} END * {x} * power({q!r}, -rn)) {CUM}"


def rank_pct(x: str, n: int, least: int) -> str:
    values = f"list({x}) FILTER ({x} IS NOT NULL) {r(n)}"
    return f"CASE WHEN count({x}) {r(n)} >= {least} AND {x} IS NOT NULL THEN (len(list_filter({values}, lambda v: v < {x})) + (len(list_filter({values}, lambda v: v = {x})) + 1) / 2.0) / count({x}) {r(n)} END"


def bars(select: str) -> str:
    return f"b0 AS ({select}), bars AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS rn FROM b0)"


EVENTS = bars("SELECT event_type AS ticker, time_bucket(INTERVAL 4 HOUR, e.ts) AS ts, arg_min(value, (e.ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (e.ts, event_id)) AS close, count(*) AS volume FROM events e WHERE event_type IS NOT NULL GROUP BY 1, 2")
ORDERS = bars("SELECT o_orderpriority AS ticker, date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2")
PARTS = bars("SELECT p_brand AS ticker, date_trunc('day', l_shipdate) AS ts, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")

IND = f"""i0 AS (
    SELECT *, close AS px, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars
), i1 AS (
    SELECT *, {avg('px', 5)} AS ma5, {avg('px', 10)} AS ma10, {avg('px', 20)} AS ma20, {avg('px', 60)} AS ma60, {avg('volume', 20)} AS vol_ma20,
        max(high) {r(20)} AS high_20, min(low) {r(20)} AS low_20, max(high) {r(60)} AS high_60, min(low) {r(60)} AS low_60,
        px / nullif({lag('px')}, 0) - 1 AS daily_ret, {avg('tr', 14, 14)} AS atr14, {std('px', 20, 20)} AS bb_std FROM i0
), ind AS (
    SELECT *, volume / nullif(vol_ma20, 0) AS vol_ratio, abs(close - open) AS body, CASE WHEN close >= open THEN 1 ELSE -1 END AS body_dir,
        least(open, close) - low AS lower_shadow, high - greatest(open, close) AS upper_shadow, high - low AS total_range,
        ma20 AS bb_mid, ma20 + 2 * bb_std AS bb_upper, ma20 - 2 * bb_std AS bb_lower, 4 * bb_std / nullif(ma20, 0) AS bb_width, abs(ma5 - ma60) / nullif(ma60, 0) AS ma_spread FROM i1
)"""

FACTORS = f"""f1 AS (
    SELECT *, {ema('close', 12)} AS ema12, {ema('close', 20)} AS ema20, {ema('close', 26)} AS ema26, {ema('close', 50)} AS ema50, {ema('close', 100)} AS ema100,
        greatest(ma5, ma10, ma20, ma60) - least(ma5, ma10, ma20, ma60) AS ma_ribbon_width, ({slope('ma20', 10, 3)}) * 100 AS trend_slope_ma20, (close - ma20) / nullif(ma20, 0) * 100 AS ma_distance,
        CASE WHEN ma5 > ma10 THEN 1 ELSE -1 END + CASE WHEN ma10 > ma20 THEN 1 ELSE -1 END + CASE WHEN ma20 > ma60 THEN 1 ELSE -1 END + CASE WHEN ma5 > ma60 THEN 1 ELSE -1 END AS ma_ribbon_score,
        close / nullif({lag('close')}, 0) - 1 AS ret, close - {lag('close')} AS step, (high + low + close) / 3 AS tp, max(high) {r(14)} AS hh, min(low) {r(14)} AS ll, sum(tr) {r(14)} AS tr14,
        (max(high) {r(9)} + min(low) {r(9)}) / 2 AS ichimoku_conv, (max(high) {r(26)} + min(low) {r(26)}) / 2 AS ichimoku_base, (max(high) {r(52)} + min(low) {r(52)}) / 2 AS mid52,
        max(high) {r(20)} AS donchian_high, min(low) {r(20)} AS donchian_low, ({lag('high')} + {lag('low')} + {lag('close')}) / 3 AS pivot_pp, {lag('high')} AS h1, {lag('low')} AS l1, max(volume) {r(20)} AS vmax,
        CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) END AS clv FROM ind
), f2 AS (
    SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS gain, CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END AS loss, ema12 - ema26 AS macd_line, ({std('ret', 20, 20)}) * sqrt(252) * 100 AS hist_vol_20,
        (close - ll) / nullif(hh - ll, 0) * 100 AS stochastic_k, coalesce(sign(step), 0) * volume AS signed, CASE WHEN h1 IS NOT NULL THEN greatest(high - h1, 0) END AS up, CASE WHEN l1 IS NOT NULL THEN greatest(l1 - low, 0) END AS down FROM f1
), f3 AS (
    SELECT *, {ema('macd_line', 9)} AS macd_signal, {rank_pct('hist_vol_20', 60, 20)} AS vol_rank, {rank_pct('bb_width', 60, 20)} AS bb_squeeze_rank, {avg('gain', 14)} AS g14, {avg('loss', 14)} AS l14, {avg('gain', 28)} AS g28, {avg('loss', 28)} AS l28,
        {avg('stochastic_k', 3)} AS stochastic_d, sum(signed) {CUM} AS obv, CASE WHEN coalesce(up > down, false) THEN 0 ELSE up END AS plus, CASE WHEN coalesce(up > down, false) THEN down ELSE 0 END AS minus FROM f2
), f4 AS (
    SELECT *, 100 * (sum(plus) {r(14)}) / nullif(tr14, 0) AS di_plus, 100 * (sum(minus) {r(14)}) / nullif(tr14, 0) AS di_minus FROM f3
), f5 AS (
    SELECT *, 100 * abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0) AS dx FROM f4
), f6 AS (
    SELECT *, {avg('dx', 14)} AS adx_14 FROM f5
), fac AS (
    SELECT *, ma_ribbon_width / nullif(ma20, 0) AS ma_ribbon_width_pct, ema20 AS keltner_mid, ema20 + 2 * atr14 AS keltner_upper, ema20 - 2 * atr14 AS keltner_lower,
        {', '.join(f"close + {m / 10} * atr14 AS atr_upper_{m}, close - {m / 10} * atr14 AS atr_lower_{m}" for m in (10, 15, 20, 25))}, bb_width * 100 AS bb_width_pct,
        100 - 100 / (1 + g14 / nullif(l14, 0)) AS rsi_14, 100 - 100 / (1 + g28 / nullif(l28, 0)) AS rsi_28, macd_line - macd_signal AS macd_hist,
        (close / nullif({lag('close', 10)}, 0) - 1) * 100 AS roc_10, (close / nullif({lag('close', 20)}, 0) - 1) * 100 AS roc_20, (hh - close) / nullif(hh - ll, 0) * -100 AS williams_r, (tp - {avg('tp', 20)}) / nullif(0.015 * (stddev_samp(tp) {r(20)}), 0) AS cci_20,
        (sum(volume * close) {CUM}) / CASE WHEN sum(volume) {CUM} = 0 THEN 1 ELSE sum(volume) {CUM} END AS vwap, vol_ratio AS volume_ratio, vol_ma20 AS volume_ma20, coalesce(close = max(close) {r(20)}, false) AS price_new_high, coalesce(volume < {lag('vmax')}, false) AS vol_not_new_high,
        coalesce(close = max(close) {r(20)}, false) AND coalesce(volume < {lag('vmax')}, false) AS volume_divergence_bear, CASE WHEN clv IS NOT NULL THEN sum(clv * volume) {CUM} END AS ad_line,
        ({lag('ichimoku_conv', 26)} + {lag('ichimoku_base', 26)}) / 2 AS ichimoku_span_a, {lag('mid52', 26)} AS ichimoku_span_b, lead(close, 26) OVER ({P}) AS ichimoku_lag, (donchian_high + donchian_low) / 2 AS donchian_mid,
        2 * pivot_pp - l1 AS pivot_r1, 2 * pivot_pp - h1 AS pivot_s1, pivot_pp + (h1 - l1) AS pivot_r2, pivot_pp - (h1 - l1) AS pivot_s2,
        CASE WHEN adx_14 IS NULL OR di_plus IS NULL OR di_minus IS NULL THEN 0 ELSE CASE WHEN adx_14 > 40 THEN 3 WHEN adx_14 > 25 THEN 2 WHEN adx_14 > 15 THEN 1 ELSE 0 END * CASE WHEN di_plus > di_minus THEN 1 ELSE -1 END END AS trend_strength,
        CASE WHEN bb_squeeze_rank < 0.2 AND adx_14 < 20 THEN 'ranging' WHEN adx_14 > 30 THEN 'trending' WHEN vol_rank > 0.7 THEN 'volatile' ELSE 'ranging' END AS market_regime FROM f6
)"""


def _line(side: str, x: str) -> str:
    extreme = "min" if side == "up" else "max"
    return f"""p_{side} AS (
    SELECT ticker, rn, {x} AS y FROM (SELECT *, count(*) OVER w AS n, {extreme}({x}) OVER w AS e FROM bars WINDOW w AS ({P} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE n = 7 AND {x} = e
), q_{side} AS (
    SELECT b.ticker, b.rn, p.rn - (b.rn - 60) - 1 AS x, p.y, row_number() OVER (PARTITION BY b.ticker, b.rn ORDER BY p.rn DESC) AS k FROM bars b JOIN p_{side} p ON p.ticker = b.ticker AND p.rn BETWEEN b.rn - 57 AND b.rn - 3 WHERE b.rn >= 60
), line_{side} AS (
    SELECT ticker, rn, regr_slope(y, x) * 60 + regr_intercept(y, x) AS {side}_line FROM q_{side} WHERE k <= 5 GROUP BY ticker, rn HAVING count(*) >= 3 AND regr_r2(y, x) > 0.5
)"""


TRENDLINES = _line("up", "low") + ", " + _line("down", "high")


def _sig(name: str, cond: str, value: int = 1) -> str:
    return f"CASE WHEN {cond} THEN {value} ELSE 0 END AS signal_{name}"


_STAR = "rn >= 3 AND NOT coalesce(b2 < 0.5 * a2, false) AND NOT coalesce(b1 > 0.5 * b2, false) AND NOT coalesce(body < 0.5 * atr14, false)"
SIGNALS = f"""{TRENDLINES}, g1 AS (
    SELECT ind.*, up_line, down_line, CASE WHEN rn >= 20 THEN {slope('ma20', 10, 5)} END AS s10, {slope('ma5', 5, 3)} AS s5, {slope('ma10', 5, 3)} AS m5, volume > 0.8 * vol_ma20 AS vol, CASE WHEN atr14 IS NULL OR atr14 = 0 THEN px * 0.01 ELSE atr14 END AS atr,
        {lag('px')} AS px1, {lag('bb_mid')} AS mid1, {lag('ma5 - ma20')} AS gap1, ma_spread / nullif({lag('ma_spread', 10)}, 0) AS ratio, {lag('body')} AS b1, {lag('body', 2)} AS b2, {lag('body_dir')} AS t1, {lag('body_dir', 2)} AS t2, {lag('atr14')} AS a1, {lag('atr14', 2)} AS a2,
        {lag('open')} AS o1, {lag('open', 2)} AS o2, {lag('close')} AS c1, {lag('close', 2)} AS c2, {lag('close', 3)} AS c3, {lag('close', 4)} AS c4, {lag('high')} AS hi1, {lag('upper_shadow')} AS us1, {lag('upper_shadow', 2)} AS us2, {lag('lower_shadow')} AS ls1, {lag('lower_shadow', 2)} AS ls2,
        {lag('high_20')} AS top1, {lag('low_20')} AS bot1, {lag('px', 5)} AS px5, {lag('px', 20)} AS px20, len(list_filter(list(bb_width) FILTER (bb_width IS NOT NULL) {r(61)}, lambda v: v < bb_width)) / CAST(count(*) {r(61)} AS DOUBLE) AS pct
    FROM ind LEFT JOIN line_up USING (ticker, rn) LEFT JOIN line_down USING (ticker, rn)
), g2 AS (
    SELECT *, {lag('s10', 5)} AS sp, {lag('s10', 20)} AS sq, {lag('s5')} AS s51, up_line + coalesce(3 * atr14, px * 0.05) AS top FROM g1
), sig AS (
    SELECT *, {', '.join([
        _sig('trendline_break_up', 'px > down_line + 0.3 * atr AND px > px1 AND vol AND daily_ret > 0.01', 2), _sig('trendline_break_down', 'px < up_line - 0.3 * atr AND px < px1 AND vol AND daily_ret < -0.01', 2),
        _sig('trendline_bounce_up', 'abs(low - up_line) < 0.5 * atr AND px > up_line + 0.5 * atr AND body_dir = 1 AND lower_shadow > 0.5 * body AND vol'), _sig('trendline_bounce_down', 'abs(high - down_line) < 0.5 * atr AND px < down_line - 0.3 * atr AND body_dir = -1 AND upper_shadow > 0.5 * body AND vol'),
        _sig('channel_top_touch', 'high >= top - 0.3 * atr AND body_dir = -1'), _sig('channel_bottom_touch', 'low <= up_line + 0.3 * atr AND body_dir = 1'),
        _sig('slope_accelerating_up', 'rn >= 30 AND s10 > 0 AND sp > 0 AND s10 > 1.3 * sp'), _sig('slope_decelerating_up', 'rn >= 30 AND s10 > 0 AND sp > 0 AND s10 < 0.6 * sp'), _sig('slope_accelerating_down', 'rn >= 30 AND s10 < 0 AND sp < 0 AND s10 < 1.3 * sp'), _sig('slope_decelerating_down', 'rn >= 30 AND s10 < 0 AND sp < 0 AND s10 > 0.6 * sp'),
        _sig('slope_divergence_bullish', 'rn >= 40 AND px < px20 AND s10 > sq AND s10 < 0 AND sq < 0'), _sig('slope_divergence_bearish', 'rn >= 40 AND px > px20 AND s10 < sq AND s10 > 0 AND sq > 0'),
        _sig('ma_golden_cross', 'rn >= 21 AND gap1 < 0 AND ma5 - ma20 > 0'), _sig('ma_death_cross', 'rn >= 21 AND gap1 > 0 AND ma5 - ma20 < 0'), _sig('ma_convergence', 'rn >= 30 AND ratio < 0.6'), _sig('ma_divergence_bullish', 'rn >= 30 AND ratio > 1.5 AND px > ma60'), _sig('ma_divergence_bearish', 'rn >= 30 AND ratio > 1.5 AND px < ma60'),
        _sig('ma_ribbon_bullish', 'rn >= 60 AND ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60'), _sig('ma_ribbon_bearish', 'rn >= 60 AND ma5 < ma10 AND ma10 < ma20 AND ma20 < ma60'),
        _sig('bb_squeeze_long', 'rn >= 30 AND NOT coalesce(pct > 0.8, false) AND px > bb_mid AND px1 <= mid1 AND vol'), _sig('bb_squeeze_short', 'rn >= 30 AND NOT coalesce(pct > 0.8, false) AND px < bb_mid AND px1 >= mid1 AND vol'),
        _sig('dark_cloud_cover', 'rn >= 5 AND m5 > 0.001 AND NOT coalesce(b1 < 0.5 * a1, false) AND t1 = 1 AND open > c1 AND body_dir = -1 AND close < (o1 + c1) / 2'), _sig('piercing_line', 'rn >= 5 AND m5 < -0.001 AND NOT coalesce(b1 < 0.5 * a1, false) AND t1 = -1 AND open < c1 AND body_dir = 1 AND close > (o1 + c1) / 2'),
        _sig('morning_star', f'{_STAR} AND t2 = -1 AND body_dir = 1 AND close > (o2 + c2) / 2 AND vol', 2), _sig('evening_star', f'{_STAR} AND t2 = 1 AND body_dir = -1 AND close < (o2 + c2) / 2 AND vol', 2),
        _sig('hammer', 'rn >= 5 AND body <> 0 AND atr14 IS NOT NULL AND NOT coalesce(px > px5, false) AND lower_shadow >= 2 * body AND upper_shadow <= 0.5 * body AND body_dir = 1 AND vol'), _sig('shooting_star', 'rn >= 5 AND body <> 0 AND atr14 IS NOT NULL AND NOT coalesce(px < px5, false) AND upper_shadow >= 2 * body AND lower_shadow <= 0.5 * body AND body_dir = -1 AND vol'),
        "CASE WHEN t1 = -1 AND body_dir = 1 AND open < c1 AND close > o1 AND body > b1 AND px < ma20 THEN CASE WHEN vol THEN 2 ELSE 1 END ELSE 0 END AS signal_bullish_engulfing", "CASE WHEN t1 = 1 AND body_dir = -1 AND open > c1 AND close < o1 AND body > b1 AND px > ma20 THEN CASE WHEN vol THEN 2 ELSE 1 END ELSE 0 END AS signal_bearish_engulfing",
        _sig('three_white_soldiers', 'rn >= 2 AND c2 > o2 AND c1 > o1 AND close > open AND c1 > c2 AND close > c1 AND o1 > o2 AND open > o1 AND upper_shadow <= 0.3 * body AND us1 <= 0.3 * b1 AND us2 <= 0.3 * b2'), _sig('three_black_crows', 'rn >= 2 AND c2 < o2 AND c1 < o1 AND close < open AND c1 < c2 AND close < c1 AND o1 < o2 AND open < o1 AND lower_shadow <= 0.3 * body AND ls1 <= 0.3 * b1 AND ls2 <= 0.3 * b2'),
        _sig('big_bull_breakout', 'rn >= 5 AND daily_ret > 0.03 AND close > top1 AND vol AND s5 > 0.001', 2), _sig('support_bounce', 'low <= 1.02 * bot1 AND close > open AND vol AND lower_shadow > 0.8 * body'), _sig('reversal_after_decline', 'rn >= 10 AND c1 < c2 AND c2 < c3 AND c3 < c4 AND close > hi1 AND vol AND s51 < 0 AND s5 > -0.0005', 2),
    ])} FROM g2
)"""


def _st(name: str, *cases: tuple[str, int]) -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in cases)} ELSE 0 END AS st_{name}"


_BULL, _BEAR = "(ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60)", "(ma5 < ma10 AND ma10 < ma20 AND ma20 < ma60)"
_T = lambda x: f"coalesce({x}, false)"
STRATEGIES = f"""t1 AS (
    SELECT *, {lag('ema12')} AS e12, {lag('ema26')} AS e26, {avg('trend_slope_ma20', 5, 5)} AS m, {lag('rsi_14')} AS rsi1, {lag('close')} AS c1, {lag('bb_mid')} AS mid1, {lag('stochastic_k')} AS k1, {lag('stochastic_d')} AS d1, {lag('williams_r')} AS w1, {lag('close', 10)} AS c10, {lag('obv', 10)} AS obv10,
        count(close) {r(20)} = 20 AND count(macd_hist) {r(20)} = 20 AS whole, list(close) {r(20)} AS lc, list(macd_hist) {r(20)} AS lh, CASE WHEN count(close) {r(20)} = 20 THEN max(close) {r(20)} END AS cmax, CASE WHEN count(close) {r(20)} = 20 THEN min(close) {r(20)} END AS cmin,
        quantile_cont(bb_width, 0.1) {ALL} AS q10, {lag('ichimoku_conv')} AS ic1, {lag('ichimoku_base')} AS ib1, (close - vwap) / nullif(vwap, 0) AS dv, CASE WHEN ichimoku_span_a IS NOT NULL AND ichimoku_span_b IS NOT NULL THEN greatest(ichimoku_span_a, ichimoku_span_b) END AS cloud FROM fac
), t2 AS (
    SELECT *, {lag('m', 5)} AS m1, {lag('cmax')} AS cmax1, {lag('cmin')} AS cmin1, close / nullif(c10, 0) - 1 AS p10, CASE WHEN obv10 = 0 THEN CASE WHEN obv > 0 THEN 1e308 WHEN obv < 0 THEN -1e308 END ELSE obv / obv10 - 1 END AS o10 FROM t1
), st AS (
    SELECT *, {', '.join([
        _st('ma_ribbon', (f'{_BEAR} OR close < ma60', -1), (f'{_BULL} AND close > ma20 AND rsi_14 > 50 AND rsi_14 < 75', 1)),
        _st('ema_cross', ('ema12 < ema26 AND e12 >= e26 AND close < ema50 AND ema12 < ema50', -2), ('(ema12 < ema26 AND e12 >= e26) OR (close < ema50 AND ema12 < ema26)', -1), ('ema12 > ema26 AND e12 <= e26 AND close > ema50', 1)),
        _st('trend_breakout', ('close > bb_upper AND volume_ratio > 1.5 AND adx_14 > 35', 2), ('close < bb_mid AND adx_14 > 20', -1), ('close > bb_upper AND volume_ratio > 1.5 AND adx_14 > 25', 1)),
        _st('ma_pullback', ('close < ma60 OR ma5 < ma60', -1), (f'{_BULL} AND abs(close - ma20) / nullif(ma20, 0) < 0.03 AND rsi_14 > 40 AND rsi_14 < 55', 1)),
        _st('trend_acceleration', ('m < m1 OR trend_slope_ma20 < -0.5', -1), ('m > m1 AND m > 0 AND trend_slope_ma20 > 0', 1)),
        _st('rsi_extreme', ('rsi_14 > 85', -2), ('rsi_14 < 20', 2), ('rsi_14 > 75 AND rsi_14 < rsi1', -1), ('rsi_14 < 30 AND rsi_14 > rsi1', 1)),
        _st('bb_mean_reversion', ('(close < bb_mid AND c1 >= mid1) OR (close > bb_upper AND rsi_14 > 70)', -1), ('close < bb_lower AND rsi_14 < 35', 1)),
        _st('stochastic_cross', ('stochastic_k < stochastic_d AND k1 >= d1 AND stochastic_k > 85', -2), ('stochastic_k > stochastic_d AND k1 <= d1 AND stochastic_k < 15', 2), ('stochastic_k < stochastic_d AND k1 >= d1 AND stochastic_k > 75', -1), ('stochastic_k > stochastic_d AND k1 <= d1 AND stochastic_k < 25', 1)),
        _st('macd_divergence', ('whole AND list_position(lc, list_max(lc)) = 1 AND list_position(lh, list_max(lh)) > 4', -1), ('whole AND list_position(lc, list_min(lc)) = 1 AND list_position(lh, list_min(lh)) > 4', 1)),
        _st('williams_r_reversal', ('williams_r > -20 AND williams_r < w1', -1), ('williams_r < -80 AND williams_r > w1', 1)),
        _st('volume_breakout', ('close < cmin1 AND volume_ratio < 0.7', -1), ('close > cmax1 AND volume_ratio > 1.5', 1)),
        _st('obv_divergence', ('p10 >= -0.01 AND o10 < -0.02', -1), ('p10 <= 0.01 AND o10 > 0.02', 1)),
        _st('vwap_mean_reversion', ('dv > 0.08', -2), ('dv < -0.08', 2), ('dv > 0.05', -1), ('dv < -0.05 AND volume_ratio < 0.8', 1)),
        _st('bb_squeeze', ('bb_width < q10 AND close < bb_lower', -1), ('bb_width < q10 AND close > bb_upper AND volume_ratio > 1.5', 1)),
        _st('keltner_breakout', ('close < keltner_lower', -1), ('close > keltner_upper AND adx_14 > 20', 1)),
        _st('atr_band', ('close > atr_upper_20', -1), ('close < atr_lower_20', 1)),
        _st('triple_confirm_long', (f'{_BULL} AND rsi_14 > 50 AND adx_14 > 30 AND di_plus > di_minus', 2), (f'NOT {_T(_BULL)} AND NOT {_T("rsi_14 > 50")}', -1), (f'{_BULL} AND rsi_14 > 50 AND adx_14 > 20', 1)),
        _st('triple_confirm_short', (f'{_BEAR} AND rsi_14 < 50 AND adx_14 > 30 AND di_minus > di_plus', -2), (f'{_BEAR} AND rsi_14 < 50 AND adx_14 > 20', -1)),
        _st('ichimoku_cloud', ('ichimoku_conv < ichimoku_base AND ic1 >= ib1', -1), ('ichimoku_conv > ichimoku_base AND ic1 <= ib1 AND NOT coalesce(close > cloud, false)', 1), ('ichimoku_conv > ichimoku_base AND ic1 <= ib1 AND close > cloud', 2)),
        _st('full_monty', (f'{_BEAR} AND NOT {_T("rsi_14 > rsi_28")} AND macd_hist < 0 AND adx_14 > 25', -2), (f'{_BEAR} AND NOT {_T("rsi_14 > rsi_28")} AND macd_hist < 0', -1), (f'{_BULL} AND rsi_14 > rsi_28 AND macd_hist > 0', 1)),
    ])} FROM t2
)"""


def limits(rows) -> str:
    """VALUES of (strategy, stop, target, least_hold, most_hold, place)."""
    return "(VALUES " + ", ".join(f"('{i}', {stop}, {target}, {least}, {most}, {k})" for k, (i, stop, target, least, most) in enumerate(rows)) + ") AS p(strategy, stop, target, least_hold, most_hold, place)"


def votes(rows, table: str = "st") -> str:
    """CTE v: the votes of every strategy in long form with its limits and capital, for ``fold``."""
    long = " UNION ALL ".join(f"SELECT ticker, rn, close, high, low, '{i}' AS strategy, st_{i} AS vote FROM {table}" for i, *_ in rows)
    return f"v AS MATERIALIZED (SELECT 'all' AS run, l.*, stop, target, least_hold, most_hold, place, CAST(100000 AS DOUBLE) AS capital FROM ({long}) l JOIN {limits(rows)} USING (strategy))"


def fold(source: str, name: str, *, worst_case: bool = False, limit: float = 0.0, size: float = 1.0) -> str:
    """CTEs ``<name>`` (state after every bar) and ``<name>_trades`` of the long-only back-test.

    Entries spend 0.95 of the cash on whole shares, both ways cost 0.001.
    """
    buy, sell = ("high", "low") if worst_case else ("close", "close")
    limited = f"abs(v.close / nullif(v.before, 0) - 1) >= {limit}" if limit else "false"
    keys = "ticker, run, strategy"
    return f"""{name}_in AS MATERIALIZED (
    SELECT *, lag(close) OVER (PARTITION BY {keys} ORDER BY rn) AS before FROM {source}
), {name} AS (
    SELECT {keys}, CAST(-1 AS BIGINT) AS rn, any_value(capital) AS cash, CAST(0 AS DOUBLE) AS shares, CAST(-1 AS BIGINT) AS entry, CAST(0 AS DOUBLE) AS paid,
        CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS gain, CAST(NULL AS BIGINT) AS held, any_value(capital) AS equity
    FROM {name}_in GROUP BY {keys}
    UNION ALL
    SELECT {keys}, rn, cash2, shares2, CASE WHEN shares2 > 0 AND shares = 0 THEN rn WHEN shares2 = 0 THEN -1 ELSE entry END,
        CASE WHEN shares2 > 0 AND shares = 0 THEN {buy} WHEN shares2 = 0 THEN 0 ELSE paid END, why, CASE WHEN why IS NOT NULL THEN ({sell} - paid) / paid END,
        CASE WHEN why IS NOT NULL THEN rn - entry END, cash2 + shares2 * close
    FROM (
        SELECT *, CASE WHEN why IS NOT NULL THEN cash + shares * {sell} * 0.999 WHEN enter THEN cash - bought * {buy} * 1.001 ELSE cash END AS cash2,
            CASE WHEN why IS NOT NULL THEN 0 WHEN enter THEN bought ELSE shares END AS shares2
        FROM (
            SELECT v.ticker, v.run, v.strategy, v.rn, v.close, v.high, v.low, f.cash, f.shares, f.entry, f.paid, floor(f.cash * 0.95 * {size} / v.{buy}) AS bought,
                f.shares = 0 AND v.vote > 0 AND NOT coalesce({limited}, false) AS enter,
                CASE WHEN f.shares > 0 THEN CASE
                    WHEN v.vote < 0 AND v.rn - f.entry >= least_hold THEN 'signal'
                    WHEN stop > 0 AND (v.close - f.paid) / f.paid <= -stop THEN 'stop_loss'
                    WHEN target > 0 AND (v.close - f.paid) / f.paid >= target THEN 'take_profit'
                    WHEN v.rn - f.entry >= most_hold THEN 'timeout' END END AS why
            FROM {name} f JOIN {name}_in v ON v.ticker = f.ticker AND v.run = f.run AND v.strategy = f.strategy AND v.rn = f.rn + 1
        )
    )
), {name}_last AS (
    SELECT {keys}, rn, f.* EXCLUDE ({keys}, rn), v.close, v.{sell} AS out_price FROM {name} f JOIN {name}_in v USING ({keys}, rn)
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY rn DESC) = 1
), {name}_trades AS (
    SELECT {keys}, rn AS exit_rn, gain AS return_pct, held AS hold_bars, reason FROM {name} WHERE reason IS NOT NULL
    UNION ALL
    SELECT {keys}, rn, (out_price - paid) / paid, rn - entry, 'force_close' FROM {name}_last WHERE shares > 0
)"""


def summary(fold: str, name: str) -> str:
    """CTE ``<name>``: returns, risk and trade statistics of every (ticker, run, strategy) of a fold."""
    keys = "ticker, run, strategy"
    return f"""{name}_steps AS (
    SELECT {keys}, rn, equity, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret, max(equity) OVER w AS peak FROM {fold} WHERE rn >= 0
    WINDOW w AS (PARTITION BY {keys} ORDER BY rn ROWS UNBOUNDED PRECEDING)
), {name}_risk AS (
    SELECT {keys}, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END AS sharpe, min((equity - peak) / nullif(peak, 0)) AS max_drawdown,
        arg_max(equity, rn) AS last_equity, count(*) AS n FROM {name}_steps GROUP BY {keys}
), {name}_closed AS (
    SELECT {keys}, count(*) AS n_trades, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(return_pct) AS avg_return, avg(hold_bars) AS avg_hold,
        coalesce(avg(return_pct) FILTER (return_pct > 0), 0) AS won, coalesce(abs(avg(return_pct) FILTER (return_pct <= 0)), 1) AS lost FROM {fold}_trades GROUP BY {keys}
), {name} AS (
    SELECT {keys}, coalesce(n_trades, 0) AS n_trades, (f.cash + f.shares * f.out_price * 0.999) / f.start - 1 AS total_return, k.sharpe, k.max_drawdown, k.last_equity, k.n,
        power((f.cash + f.shares * f.out_price * 0.999) / f.start, 1 / greatest(k.n / 252.0, 0.01)) - 1 AS annual_return, coalesce(win_rate, 0) AS win_rate,
        coalesce(avg_return, 0) AS avg_return, coalesce(avg_hold, 0) AS avg_hold, CASE WHEN coalesce(lost, 1) = 0 THEN CAST('inf' AS DOUBLE) ELSE coalesce(won, 0) / coalesce(lost, 1) END AS profit_factor
    FROM (SELECT l.*, s.capital AS start FROM {fold}_last l JOIN (SELECT DISTINCT {keys}, capital FROM {fold}_in) s USING ({keys})) f JOIN {name}_risk k USING ({keys}) LEFT JOIN {name}_closed c USING ({keys})
)"""


def regime(table: str = "fac") -> str:
    """CTE reg: the market regime of every ticker's last bar."""
    return f"""rg1 AS (
    SELECT *, 1 - coalesce((bb_width - min(bb_width) {ALL}) / nullif(max(bb_width) {ALL} - min(bb_width) {ALL}, 0), 0.5) AS narrow, ma_ribbon_score AS t,
        coalesce(abs((px - ma20) / nullif(ma20, 0)), 0) AS d20, coalesce(abs((px - ma60) / nullif(ma60, 0)), 0) AS d60, max(rn) {ALL} AS newest FROM {table}
), rg2 AS (
    SELECT ticker, ts, [
        greatest(CASE WHEN t > 0 AND adx_14 > 20 AND px > ma20 THEN least(100, 50 + 0.8 * adx_14 + 10 * t + 500 * d60) ELSE 0 END, CASE WHEN t >= 3 THEN 30 ELSE 0 END),
        greatest(CASE WHEN t < 0 AND adx_14 > 20 AND px < ma20 THEN least(100, 50 + 0.8 * adx_14 + 10 * abs(t) + 500 * d60) ELSE 0 END, CASE WHEN t <= -3 THEN 30 ELSE 0 END),
        least(100, CASE WHEN adx_14 < 20 THEN 2 * (20 - adx_14) ELSE 0 END + 50 * narrow + CASE WHEN abs(t) <= 1 THEN 10 ELSE 0 END),
        CASE WHEN rsi_14 > 65 AND px > ma20 THEN least(100, 1.5 * (rsi_14 - 50) + 1000 * d20) ELSE 0 END,
        CASE WHEN rsi_14 < 40 AND px < ma20 THEN least(100, 2 * (40 - rsi_14) + 1000 * d20) ELSE 0 END] AS s
    FROM rg1 WHERE rn = newest
), rg3 AS (
    SELECT *, CASE WHEN list_max(s) < 5 THEN 3 ELSE list_position(s, list_max(s)) END AS k FROM rg2
), reg AS (
    SELECT ticker, ts, ['trend_up', 'trend_down', 'range', 'top', 'bottom'][k] AS regime, ['trend', 'trend', 'reversal', 'reversal', 'reversal'][k] AS category,
        CASE WHEN list_max(s) < 5 THEN 5 ELSE list_max(s) END AS score FROM rg3
)"""


def num(x: str, places: int = 6) -> str:
    """A double for comparison: nudged off ties, then rounded."""
    return f"round({x} + 1e-9, {places})"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


def recursive(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + select
