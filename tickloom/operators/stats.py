"""Forward returns after signals and what they say about each signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import div, first_match, ordered
from ..functions.storage import stored
from .signals import active_signals, long_signals

col = F.col
HORIZONS = (1, 3, 5, 10, 20)


def forward_returns(df: DataFrame) -> DataFrame:
    return df.withColumns({f"fwd_{n}": div(F.lead("px", n).over(ordered()), "px") - 1 for n in HORIZONS})


def signal_stats(df: DataFrame, least: int = 3) -> DataFrame:
    """Per ticker, signal and horizon: events, mean, win rate, best, worst, median, drawdown of the compounded events.

    Only bars that have every horizon and strength-1 events count; signals with
    fewer than ``least`` events are left out as insufficient.
    """
    f = forward_returns(df)
    names = [f"fwd_{n}" for n in HORIZONS]
    whole = f.where(" and ".join(f"{n} is not null" for n in names))
    events = long_signals(whole).where("strength = 1").join(whole.select("ticker", "rn", *names), ["ticker", "rn"])
    long = events.unpivot(["ticker", "signal", "rn"], names, "horizon", "ret").withColumn("horizon", F.substring("horizon", 5, 10).cast("int"))
    w = Window.partitionBy("ticker", "signal", "horizon").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    wealth = F.exp(F.sum(F.when(col("ret") > -1, F.log1p("ret"))).over(w))
    long = long.withColumn("wealth", wealth).withColumn("peak", F.max("wealth").over(w))
    out = long.groupBy("ticker", "signal", "horizon").agg(
        F.count("*").alias("events"), F.avg("ret").alias("mean"), F.avg(F.when(col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
        F.percentile("ret", F.lit(0.5)).alias("median"), F.min(div(col("wealth") - col("peak"), "peak")).alias("max_drawdown"),
    )
    return out.where(F.col("events") >= least)


def in_percent(name: str, places: int):
    """A share in percent, rounded; ties are rounded up by any engine."""
    return F.round(col(name) * 100 + F.lit(1e-9), places)


def judge_signals(stats: DataFrame, least: int = 10) -> DataFrame:
    """The verdict on each signal by its five-bar statistics as they are shown: win rate to a tenth, mean to a hundredth of a percent."""
    five = stats.where("horizon = 5")
    win, mean = in_percent("win_rate", 1), in_percent("mean", 2)
    label = first_match((col("events") < least, "insufficient"), ((win >= 60) & (mean > 0), "bullish"), ((win <= 45) & (mean < 0), "bearish"), default="neutral")
    return five.select("ticker", "signal", "events", label.alias("judgement"))


def overall_judgement(judged: DataFrame) -> DataFrame:
    """Bullish and bearish signals, samples and verdict of each ticker.

    ``judged`` has every signal with an event: judge ``signal_stats`` with ``least`` = 1,
    so that the samples count rare signals too.
    """
    n = lambda x: F.sum(F.when(col("judgement") == x, 1).otherwise(0))
    out = judged.groupBy("ticker").agg(n("bullish").alias("n_bullish"), n("bearish").alias("n_bearish"), F.sum("events").alias("samples"))
    return out.withColumn("overall", first_match((col("n_bullish") > col("n_bearish"), "bullish"), (col("n_bearish") > col("n_bullish"), "bearish"), default="neutral"))


def report(stats: DataFrame) -> DataFrame:
    """A Markdown table per ticker, as one string; a ticker has at most one line per signal and horizon."""
    line = F.format_string("| %s | %d | %d | %.2f%% | %.1f%% |", "signal", "horizon", "events", in_percent("mean", 2), in_percent("win_rate", 1))
    lines = stats.select("ticker", F.struct("signal", "horizon", line.alias("line")).alias("l")).groupBy("ticker").agg(F.array_sort(F.collect_list("l")).alias("l"))
    head = "| signal | horizon | events | mean | win rate |\n|---|---|---|---|---|\n"
    return lines.select("ticker", F.concat(F.lit("# "), "ticker", F.lit("\n\n" + head), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))


def full_report(detected: DataFrame) -> DataFrame:
    """A Markdown report per ticker of bars with signals: active signals, statistics, verdict.

    The signals are detected once: their bars are stored for the parts of the report.
    """
    detected = stored(detected.select("ticker", "ts", "rn", "px", *(c for c in detected.columns if c.startswith("signal_"))), "detected")
    stats = signal_stats(detected, least=1)
    verdict = overall_judgement(judge_signals(stats))
    active = active_signals(detected).groupBy("ticker").agg(F.array_sort(F.collect_list(F.format_string("- %s (%s, %d)", "signal", "direction", "occurrences"))).alias("active"))
    tables = report(stats.where("events >= 3")).select("ticker", F.substring_index("markdown", "\n\n", -1).alias("table"))
    out = detected.select("ticker").distinct().join(active, "ticker", "left").join(tables, "ticker", "left").join(verdict, "ticker", "left")
    said = F.when(
        col("overall").isNull(), "no events"
    ).otherwise(F.format_string("%s: %d bullish and %d bearish signals, %d samples", "overall", "n_bullish", "n_bearish", "samples"))
    parts = [
        F.concat(F.lit("# "), col("ticker")),
        F.lit("## Active signals"), F.coalesce(F.array_join("active", "\n"), F.lit("none")),
        F.lit("## Statistics"), F.coalesce("table", F.lit("too few events")),
        F.lit("## Verdict"), said,
    ]
    return out.select("ticker", F.concat_ws("\n\n", *parts).alias("markdown"))


def print_reports(reports: DataFrame) -> None:
    """The reports on standard output, one ticker at a time."""
    for row in reports.orderBy("ticker").toLocalIterator():
        print(row["markdown"], end="\n\n")
