"""Streaming back-tests and indicators: bars in time order, with state of a fixed size for every key.

Bars wait in a list state until the watermark has passed them, so late ones take their place in
the order; timers at their times wake keys that get no further bars.  What is kept of
a series is one small value and the bars that still wait.  A key without a bar for
``idle`` is closed and its state dropped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.storage import shared_folder
from ..operators.backtest import SHARE

#: State stores that list states and timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OrderedBars(StatefulProcessor):
    """Calls ``on_bar(key, state, bar)`` for every bar in the order of time; ``state`` is a dictionary that lasts.

    ``bars``: names of the double columns of a bar; ``out``: names of what comes out.
    """

    bars: tuple[str, ...] = ()
    out: tuple[str, ...] = ()

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, " + ", ".join(f"{b} double" for b in self.bars))
        self.kept = handle.getValueState("kept", "json string")

    def on_bar(self, key: tuple, state: dict, us: int, bar: dict) -> list[tuple]:
        raise NotImplementedError

    def on_end(self, key: tuple, state: dict) -> list[tuple]:
        return []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            new += list(zip(us.tolist(), *(pdf[b].astype(float).tolist() for b in self.bars), strict=True))
        self.waiting.appendList(new)
        # one timer for the last of them wakes the key for all that wait until then
        self.handle.registerTimer(max(r[0] for r in new) // 1000 + 1)
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs())

    def _ready(self, key: tuple, mark: int) -> Iterator[pd.DataFrame]:
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else {}
        now, later = [w for w in waiting if w[0] < 1000 * mark], [w for w in waiting if w[0] >= 1000 * mark]
        rows = []
        for us, *values in now:
            rows += self.on_bar(key, state, us, dict(zip(self.bars, values, strict=True)))
            state["last_ms"] = us // 1000
        over = self.idle_ms is not None and not later and state and state.get("last_ms", mark) + self.idle_ms < mark
        if over:
            rows += self.on_end(key, state)
            self.kept.clear()
            self.waiting.clear()
        elif now:
            self.kept.update((json.dumps(state),))
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            if self.idle_ms is not None and not later:
                self.handle.registerTimer(state["last_ms"] + self.idle_ms + 1)
        if rows:
            yield pd.DataFrame(rows, columns=list(self.out))

    def close(self) -> None:
        pass


TRADES = "ticker string, strategy string, entry long, exit long, entry_price double, exit_price double, return_pct double, hold_bars long, reason string"


class Backtest(OrderedBars):
    """The long-only fold of ``operators.backtest`` one bar at a time; trades come out when they end."""

    bars = ("close", "high", "low", "vote")
    out = tuple(x.split()[0] for x in TRADES.split(", "))

    def __init__(self, limits: dict, idle_ms: int, capital: float, commission: float, worst_case: bool, limit_pct: float):
        super().__init__(idle_ms)
        self.limits, self.capital, self.commission, self.worst_case, self.limit_pct = limits, capital, commission, worst_case, limit_pct

    def _leave(self, key, s: dict, price: float, at: int, reason: str) -> tuple:
        s["cash"] += s["shares"] * price * (1 - self.commission)
        s["shares"] = 0
        return (*key, s["entry"], at, s["paid"], price, (price - s["paid"]) / s["paid"], at - s["entry"], reason)

    def on_bar(self, key, state, us, bar):
        s = state
        if "cash" not in s:
            s.update(cash=self.capital, shares=0, entry=-1, paid=0.0, n=0, before=None)
        stop, target, least, most = self.limits[key[1]]
        close, at, rows = bar["close"], s["n"], []
        limited = self.limit_pct > 0 and s["before"] and abs(close / s["before"] - 1) >= self.limit_pct
        if s["shares"]:
            gain, held = (close - s["paid"]) / s["paid"], at - s["entry"]
            reason = (
                "signal" if bar["vote"] < 0 and held >= least
                else "stop_loss" if stop > 0 and gain <= -stop
                else "take_profit" if target > 0 and gain >= target
                else "timeout" if held >= most
                else None
            )
            if reason:
                rows.append(self._leave(key, s, bar["low"] if self.worst_case else close, at, reason))
        elif bar["vote"] > 0 and not limited:
            price = bar["high"] if self.worst_case else close
            bought = int(s["cash"] * SHARE / price) if price > 0 else 0
            if bought > 0:
                s.update(cash=s["cash"] - bought * price * (1 + self.commission), shares=bought, entry=at, paid=price)
        s.update(n=at + 1, before=close, out=bar["low"] if self.worst_case else close)
        return rows

    def on_end(self, key, state):
        return [self._leave(key, state, state["out"], state["n"] - 1, "force_close")] if state.get("shares") else []


def _started(spark: SparkSession) -> None:
    spark.conf.set(*PROVIDER)


def streaming_backtest(votes: DataFrame, limits: dict, *, late: str = "1 day", idle: str = "30 days", capital=100_000.0, commission=0.001, worst_case=False, limit_pct=0.0) -> DataFrame:
    """Trades of a stream of (ticker, strategy, ts, close, high, low, vote) with each strategy's (stop, target, least, most bars).

    Bars up to ``late`` out of order are put in order.  A series without a bar for
    ``idle`` is over: its open position is closed at its last bar, its state forgotten.
    """
    _started(votes.sparkSession)
    processor = Backtest(limits, int(pd.Timedelta(idle).total_seconds() * 1000), capital, commission, worst_case, limit_pct)
    keyed = votes.select("ticker", "strategy", "ts", "close", "high", "low", F.coalesce("vote", F.lit(0)).alias("vote")).withWatermark("ts", late)
    return keyed.groupBy("ticker", "strategy").transformWithStateInPandas(processor, TRADES, "append", "EventTime")


_AVERAGES, _EMAS = (5, 10, 20, 60), (12, 26, 50)
INDICATORS = "ticker string, ts timestamp, rn long, " + ", ".join(f"{n} double" for n in (*(f"ma{k}" for k in _AVERAGES), *(f"ema{k}" for k in _EMAS), "bb_upper", "bb_lower", "high_20", "low_20", "atr14", "rsi_14", "macd_line", "macd_signal", "daily_ret")) + ", ma_cross long"


class Indicators(OrderedBars):
    """Indicators of every bar from the last 60 and the recursive averages."""

    bars = ("close", "high", "low", "volume")
    out = tuple(x.split()[0] for x in INDICATORS.split(", "))

    def on_bar(self, key, state, us, bar):
        s = state
        if not s:
            s.update(n=0, close=[], high=[], low=[], tr=[], ema={}, signal=None, gap=None)
        at, close = s["n"], bar["close"]
        before = s["close"][-1] if s["close"] else None
        spread = bar["high"] - bar["low"]
        tr = spread if before is None else max(spread, abs(bar["high"] - before), abs(bar["low"] - before))
        for name, value, most in (("close", close, 61), ("high", bar["high"], 20), ("low", bar["low"], 20), ("tr", tr, 14)):
            s[name] = [*s[name], value][-most:]
        for k in _EMAS:
            last = s["ema"].get(str(k))
            s["ema"][str(k)] = close if last is None else last + 2 / (k + 1) * (close - last)
        line = s["ema"]["12"] - s["ema"]["26"]
        s["signal"] = line if s["signal"] is None else s["signal"] + 2 / 10 * (line - s["signal"])
        own = np.array(s["close"])
        mean = {k: float(own[-k:].mean()) for k in _AVERAGES}
        dev = 2 * float(own[-20:].std(ddof=1)) if at >= 19 else None
        steps = np.diff(own[-15:])
        up, down = np.maximum(steps, 0), np.maximum(-steps, 0)
        rsi = None
        if len(steps) and down.sum() > 0:
            rsi = 100 - 100 / (1 + up.mean() / down.mean())
        gap = mean[5] - mean[20] if at >= 19 else None
        cross = 0
        if gap is not None and s["gap"] is not None:
            cross = 1 if s["gap"] < 0 < gap else -1 if s["gap"] > 0 > gap else 0
        s.update(n=at + 1, gap=gap)
        bands = (mean[20] + dev, mean[20] - dev) if dev is not None else (None, None)
        return [(
            key[0], pd.Timestamp(us, unit="us"), at, *(mean[k] for k in _AVERAGES), *(s["ema"][str(k)] for k in _EMAS), *bands,
            max(s["high"]), min(s["low"]), sum(s["tr"]) / 14 if at >= 13 else None, rsi, line, s["signal"], close / before - 1 if before else None, cross,
        )]


def streaming_indicators(bars: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Moving and recursive averages, bands, range, relative strength and crosses of a stream of (ticker, ts, close, high, low, volume)."""
    _started(bars.sparkSession)
    keyed = bars.select("ticker", "ts", "close", "high", "low", "volume").withWatermark("ts", late)
    return keyed.groupBy("ticker").transformWithStateInPandas(Indicators(), INDICATORS, "append", "EventTime")


def replayed(rows: DataFrame, key: dict, stream) -> DataFrame:
    """All that ``stream`` makes of stored rows as one stream that ends.

    A last row with the ``key``'s values and a time far ahead lets the watermark pass all others;
    what comes of it is left out.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    last = spark.range(1).select(*(F.lit(key[c]).alias(c) if c in key else F.lit("2262-01-01" if c == "ts" else None).cast(t).alias(c) for c, t in rows.dtypes))
    last = last.select(*(F.coalesce(c, F.lit(0)).cast(t).alias(c) if t in ("double", "bigint", "int") else c for c, t in last.dtypes))
    rows.unionByName(last).write.parquet(f"{folder}/in")
    made = stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    query = made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    one = next(iter(key))
    return spark.read.schema(made.schema).parquet(f"{folder}/out").where(F.col(one) != key[one])
