"""Streaming bars and a streaming position fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_bars(ticks: DataFrame, interval: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Tumbling bars of a tick stream (ticker, ts, price, size, at); ticks later than ``late`` are left out.

    ``ts`` must be a timestamp with time zone; ``at`` breaks ties of first and last.
    """
    order = F.struct("ts", "at")
    bars = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", interval).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").cast("long").alias("volume")
    )
    return bars.select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


POSITION = "ticker string, ts timestamp, action string, price double, cash double, shares long"


def streaming_positions(signals: DataFrame, *, stop=0.08, target=0.15, capital=100_000.0, commission=0.001) -> DataFrame:
    """Entries and exits of a long-only fold over a stream of (ticker, ts, close, vote), with state per ticker.

    Bars of a ticker count in time order within a micro-batch; the state is cash,
    shares and entry price, whatever the stream's length.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cash, shares, paid = state.get if state.exists else (float(capital), 0, 0.0)
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            price = float(row.close)
            if shares:
                gain = price / paid - 1
                why = "signal" if row.vote < 0 else "stop_loss" if gain <= -stop else "take_profit" if gain >= target else None
                if why:
                    cash, shares = cash + shares * price * (1 - commission), 0
                    out.append((key[0], row.ts, why, price, cash, shares))
            elif row.vote > 0:
                bought = int(cash * 0.95 / price) if price > 0 else 0
                if bought:
                    cash, shares, paid = cash - bought * price * (1 + commission), bought, price
                    out.append((key[0], row.ts, "entry", price, cash, shares))
        state.update((cash, shares, paid))
        yield pd.DataFrame(out, columns=["ticker", "ts", "action", "price", "cash", "shares"])

    return signals.groupBy("ticker").applyInPandasWithState(step, POSITION, "cash double, shares long, paid double", "append", GroupStateTimeout.NoTimeout)
