"""Detectors of users: Python table functions over each ticker's bars in order, callable from SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

EVENTS = "ticker string, rn int, event string, strength int"


def register_detector(spark: SparkSession, name: str, make: Callable[[], Callable[[Row], Iterable[tuple[str, int]]]]) -> None:
    """Register ``name`` as a table function of bars.

    ``make`` returns a function of one bar that yields (event, strength) pairs; it is called
    for every ticker anew, so what it keeps between bars is the ticker's own:

        SELECT * FROM name(TABLE(bars) PARTITION BY ticker ORDER BY rn)
    """

    class Detector:
        def __init__(self):
            self.look, self.ticker = None, None

        def eval(self, bar: Row):
            if self.look is None or self.ticker != bar["ticker"]:
                self.look, self.ticker = make(), bar["ticker"]
            for event, strength in self.look(bar):
                yield bar["ticker"], bar["rn"], event, strength

    spark.udtf.register(name, udtf(Detector, returnType=EVENTS))


def detect(bars: DataFrame, name: str) -> DataFrame:
    """(ticker, rn, event, strength) that a registered detector finds."""
    return bars.sparkSession.sql(f"SELECT * FROM {name}(TABLE({{bars}}) PARTITION BY ticker ORDER BY rn)", bars=bars)


def streak(least: int = 3) -> Callable[[Row], Iterable[tuple[str, int]]]:
    """A detector of ``least`` and more rising or falling closes in a row; the strength is how many."""
    last, length, way = None, 0, 0

    def look(bar: Row):
        nonlocal last, length, way
        close = bar["close"]
        now = 0 if last is None or close is None or close == last else 1 if close > last else -1
        length, way, last = (length + 1 if now and now == way else abs(now)), now, close
        if length >= least:
            yield ("rising" if way > 0 else "falling"), length

    return look
