"""Long-only event backtest as a grouped fold, its metrics and rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import div
from .strategies import IDS, known

# Holding profiles as (least bars, most bars, stop, target); 0 is off.
HOLD_PROFILES = {"short": (1, 15, 0.04, 0.08), "medium": (30, 180, 0.0, 0.0), "long": (180, 360, 0.0, 0.0)}
SHARE = 0.95  # of the cash that an entry spends

RESULT = (
    "ticker string, strategy string, final_cash double, n_bars long, sharpe double, max_drawdown double, last_equity double, equity array<double>, "
    "trades array<struct<entry:int,exit:int,entry_price:double,exit_price:double,return_pct:double,hold_bars:int,reason:string>>"
)


def _first_hit(close: np.ndarray, paid: float, begin: int, end: int, stop: float, target: float) -> int:
    """The first bar of begin..end-1 whose close is at or beyond the stop or the target, else ``end``; looks ahead in doubling steps."""
    size = 32
    while begin < end and (stop > 0 or target > 0):
        gain = (close[begin : min(begin + size, end)] - paid) / paid
        hit = np.zeros(len(gain), bool)
        if stop > 0:
            hit |= gain <= -stop
        if target > 0:
            hit |= gain >= target
        if hit.any():
            return begin + int(hit.argmax())
        begin, size = begin + size, 2 * size
    return end


def fold(close, high, low, signal, *, stop, target, hold_min, hold_max, capital, commission, worst_case, limit_pct, size=1.0):
    """Equity by bar, trades and final cash of one ordered series.

    Exits look at the close, first match of: opposite signal after ``hold_min``, stop,
    target, ``hold_max``; no entry on an exit bar, nor on a bar that moved by the
    limit.  An open position is closed after the last bar, which the equity doesn't show.

    The fold goes from event to event: the next buying bar and the next opposite signal are
    found by bisection, the next close at stop or target by array comparisons; bars
    in between cost no step.
    """
    close, high, low, signal = (np.asarray(x, float) for x in (close, high, low, signal))
    n, cash, at = len(close), float(capital), 0
    equity, trades = np.empty(n), []
    buying = signal > 0
    if limit_pct > 0 and n > 1:
        with np.errstate(divide="ignore", invalid="ignore"):
            buying[1:] &= ~((close[:-1] != 0) & (np.abs(close[1:] / close[:-1] - 1) >= limit_pct))
    buys, sells = np.flatnonzero(buying), np.flatnonzero(signal < 0)
    entries, exits = (high, low) if worst_case else (close, close)
    begun = 0  # bars before this have their equity
    with np.errstate(invalid="ignore"):
        while (k := np.searchsorted(buys, at)) < len(buys):
            i = int(buys[k])
            price = float(entries[i])
            bought = int(cash * SHARE * size / price) if price > 0 else 0
            if bought <= 0:
                at = i + 1
                continue
            equity[begun:i] = cash + 0 * close[begun:i]
            cash -= bought * price * (1 + commission)
            k = np.searchsorted(sells, max(i + 1, i + hold_min))
            opposite = int(sells[k]) if k < len(sells) else n
            last = min(opposite, max(i + 1, i + hold_max))
            j = _first_hit(close, price, i + 1, min(last + 1, n), stop, target)
            j = min(j, last)
            equity[i : min(j, n)] = cash + bought * close[i : min(j, n)]
            begun = at = j + 1
            gain = (close[j] - price) / price if j < n else 0.0
            reason = (
                "force_close" if j >= n
                else "signal" if j == opposite
                else "stop_loss" if stop > 0 and gain <= -stop
                else "take_profit" if target > 0 and gain >= target
                else "timeout"
            )
            j = min(j, n - 1)
            out = float(exits[j])
            cash += bought * out * (1 - commission)
            trades.append((i, j, price, out, (out - price) / price, j - i, reason))
            if begun <= n:
                equity[begun - 1 : begun] = cash + 0 * close[begun - 1 : begun]
        equity[begun:] = cash + 0 * close[begun:]
    return equity, trades, cash


def curve_metrics(equity: np.ndarray) -> dict:
    """Annualised Sharpe ratio, largest drawdown and last value of an equity curve."""
    before, peak = equity[:-1], np.maximum.accumulate(equity)
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = (equity[1:] / before - 1)[before != 0]
        falls = ((equity - peak) / peak)[peak != 0]
    dev = steps.std(ddof=1) if len(steps) > 1 else 0.0
    sharpe = steps.mean() / dev * np.sqrt(252.0) if not dev <= 0 else 0.0
    return {"sharpe": float(sharpe), "max_drawdown": float(falls.min()) if len(falls) else None, "last_equity": float(equity[-1]) if len(equity) else None}


def _params(ids, profile: str | None):
    """strategy -> (stop, target, least, most bars)."""
    own = {i: (s.stop_loss, s.take_profit, s.hold_min, s.hold_max) for i, s in known().items()}
    if profile is None:
        return {i: own[i] for i in ids}
    least, most, stop, target = HOLD_PROFILES[profile]
    return dict.fromkeys(ids, (stop, target, least, most))


def _result(ticker, strategy, bars: pd.DataFrame, vote: pd.Series, limits, curve=True, **options) -> dict:
    """A row of RESULT; without ``curve`` the equity of every bar stays here and only its metrics go on."""
    stop, target, least, most = limits
    prices = (bars[c].to_numpy(float) for c in ("close", "high", "low"))
    equity, trades, cash = fold(*prices, vote.fillna(0).to_numpy(), stop=stop, target=target, hold_min=least, hold_max=most, **options)
    names = ("entry", "exit", "entry_price", "exit_price", "return_pct", "hold_bars", "reason")
    found = {"ticker": ticker, "strategy": strategy, "final_cash": cash, "n_bars": len(bars)} | curve_metrics(equity)
    return found | {"equity": equity if curve else None, "trades": [dict(zip(names, t, strict=True)) for t in trades]}


def run_backtest(signals: DataFrame, params: dict, *, capital=100_000.0, commission=0.001, worst_case=False, limit_pct=0.0, size=1.0, curve=True) -> DataFrame:
    """One result per (ticker, strategy) of ``signals``: ticker, strategy, rn, high, low, close, vote.

    The fold is sequential in time, so a group is one series: its length is the number
    of bars of a ticker, which doesn't grow with the number of tickers or strategies.
    """
    options = {"capital": capital, "commission": commission, "worst_case": worst_case, "limit_pct": limit_pct, "size": size, "curve": curve}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        return pd.DataFrame([_result(key[0], key[1], pdf, pdf["vote"], params[key[1]], **options)])

    return signals.select("ticker", "strategy", "rn", "close", "high", "low", "vote").groupBy("ticker", "strategy").applyInPandas(one, RESULT)


def run_strategies(df: DataFrame, runs: dict[str, dict], *, capital=100_000.0, commission=0.001, worst_case=False, limit_pct=0.0, curve=True) -> DataFrame:
    """Results of bars with strategy columns, for each named run (strategy -> limits) in turn; ``run`` names it.

    All strategies of a ticker are folded where its bars are: no copy of the prices for
    each strategy, and no shuffle beyond the one that made the columns.  Without ``curve``
    a result is a few numbers and its trades; with it, the equity of every bar.
    """
    ids = list(dict.fromkeys(i for limits in runs.values() for i in limits))
    options = {"capital": capital, "commission": commission, "worst_case": worst_case, "limit_pct": limit_pct, "curve": curve}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        return pd.DataFrame([{"run": run} | _result(key[0], i, pdf, pdf[f"st_{i}"], limits[i], **options) for run, limits in runs.items() for i in limits])

    return df.select("ticker", "rn", "close", "high", "low", *(f"st_{i}" for i in ids)).groupBy("ticker").applyInPandas(one, "run string, " + RESULT)


def run_sleeves(df: DataFrame, sleeves: DataFrame, limits: dict, *, commission=0.001, worst_case=False, limit_pct=0.0) -> DataFrame:
    """Results of the ``sleeves`` (ticker, run, strategy, capital): each runs on its own capital beside its ticker's bars."""
    options = {"commission": commission, "worst_case": worst_case, "limit_pct": limit_pct}
    columns = [x.split()[0] for x in RESULT.split(", trades")[0].split(", ")] + ["trades"]

    def one(key: tuple, bars: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("rn")
        made = [{"run": r.run} | _result(key[0], r.strategy, bars, bars[f"st_{r.strategy}"], limits[r.strategy], capital=r.capital, **options) for r in own.itertuples()] if len(bars) else []
        return pd.DataFrame(made, columns=["run", *columns])

    left = df.select("ticker", "rn", "close", "high", "low", *(f"st_{i}" for i in limits)).groupBy("ticker")
    return left.cogroup(sleeves.select("ticker", "run", "strategy", "capital").groupBy("ticker")).applyInPandas(one, "run string, " + RESULT)


def votes(df: DataFrame, ids=IDS) -> DataFrame:
    """Bars with strategy columns in long form."""
    names = [f"st_{i}" for i in ids]
    out = df.select("ticker", "rn", "close", "high", "low", *names).unpivot(["ticker", "rn", "close", "high", "low"], names, "strategy", "vote")
    return out.withColumn("strategy", F.substring("strategy", 4, 100))


def trades(results: DataFrame) -> DataFrame:
    return results.select("ticker", "strategy", F.explode("trades").alias("t")).select("ticker", "strategy", "t.*")


def equity_curve(results: DataFrame) -> DataFrame:
    return results.select("ticker", "strategy", F.posexplode("equity").alias("rn", "equity"))


def equity_metrics(curve: DataFrame, keys) -> DataFrame:
    """Annualised Sharpe ratio and largest drawdown of equity curves."""
    w = Window.partitionBy(*keys).orderBy("rn")
    seen = curve.withColumn("ret", div(F.col("equity"), F.lag("equity").over(w)) - 1).withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = seen.groupBy(*keys).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.min(div(F.col("equity") - F.col("peak"), "peak")).alias("max_drawdown"), F.max_by("equity", "rn").alias("last_equity"))
    return out.withColumn("sharpe", _sharpe(F.col("m"), F.col("s"))).drop("m", "s")


def _sharpe(mean: Column, dev: Column) -> Column:
    return F.when(dev > 0, mean / dev * F.sqrt(F.lit(252.0))).otherwise(0.0)


def summarise(results: DataFrame, capital=100_000.0) -> DataFrame:
    """Returns, risk and trade statistics per (ticker, strategy)."""
    t = F.col("trades")
    returns = F.transform(t, lambda x: x["return_pct"])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    wins, losses = F.filter(returns, lambda r: r > 0), F.filter(returns, lambda r: r <= 0)
    n = F.size(t)
    avg = lambda xs, none: F.when(F.size(xs) > 0, total(xs) / F.size(xs)).otherwise(none)
    avg_win, avg_loss = avg(wins, F.lit(0.0)), F.when(F.size(losses) > 0, F.abs(avg(losses, F.lit(0.0)))).otherwise(1.0)
    flat = results.select(
        *(c for c in ("run",) if c in results.columns), "ticker", "strategy", n.alias("n_trades"), ((F.col("final_cash") - capital) / capital).alias("total_return"), F.col("n_bars"),
        F.when(n > 0, F.size(wins) / n).otherwise(0.0).alias("win_rate"), avg(returns, F.lit(0.0)).alias("avg_return"),
        F.when(n > 0, total(F.transform(t, lambda x: x["hold_bars"].cast("double"))) / n).otherwise(0.0).alias("avg_hold"),
        F.when(avg_loss == 0, F.lit(float("inf"))).otherwise(div(avg_win, avg_loss)).alias("profit_factor"), "sharpe", "max_drawdown", "last_equity",
    )
    years = F.greatest(F.col("n_bars") / 252, F.lit(0.01))
    return flat.withColumn("annual_return", F.pow(1 + F.col("total_return"), 1 / years) - 1).drop("n_bars")


def backtest_all(df: DataFrame, *, profile: str | None = "medium", min_trades=1, ids=IDS, capital=100_000.0, **options) -> DataFrame:
    """Summaries of all strategies with at least ``min_trades`` trades; a profile overrides their own limits."""
    out = summarise(run_strategies(df, {"all": _params(ids, profile)}, capital=capital, curve=False, **options), capital)
    return out.where(F.col("n_trades") >= min_trades).drop("run")


def rank_strategies(summary: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Rank within each ticker, best first; ties keep the registry order."""
    place = F.create_map(*[F.lit(x) for pair in enumerate(known()) for x in reversed(pair)])
    return summary.withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(metric), F.element_at(place, F.col("strategy")))))


def _fixed(x: Column, places: int) -> Column:
    """``x`` with that many decimal places, by its exact binary value, ties to the even digit, as C's printf has it."""
    shape = "0." + "0" * places if places else "0"
    wide = F.when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(F.isnan(x), "NaN")
    return wide.otherwise(F.call_function("format_number", x, F.lit(shape)))


def formatted(summary: DataFrame) -> DataFrame:
    """The summary as display strings."""
    pct = lambda c, places=2: F.concat(_fixed(F.col(c) * 100, places), F.lit("%")).alias(c)
    num = lambda c, places=2: _fixed(F.col(c), places).alias(c)
    return summary.select(
        "ticker", "strategy", F.col("n_trades").cast("string").alias("n_trades"), *map(pct, ("total_return", "annual_return", "max_drawdown", "avg_return")),
        pct("win_rate", 1), *map(num, ("sharpe", "profit_factor")), num("avg_hold", 0),
    )
