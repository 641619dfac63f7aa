"""Nearest windows of long series: exact search by sliding products, and by time warping with lower bounds.

A ticker's bars are dealt to blocks of ``block`` bars (each with the ``window`` - 1 bars
that follow it), so one long series is many tasks.  A block meets the query of its ticker, one
array, and sends its ``top`` best windows on; only those are ranked together.  No
window is materialised for the whole series: a block holds a few columns of numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import whole

col = F.col
#: Windows whose shapes stand in memory at a time.
AT_ONCE = 2048


def last_windows(bars: DataFrame, window: int, gap: int) -> DataFrame:
    """(ticker, n, query): the last ``window`` closes of tickers long enough for one to compare with."""
    n = bars.groupBy("ticker").agg(F.count("close").alias("n")).where(col("n") >= 2 * window + gap)
    last = bars.join(n, "ticker").where((col("rn") >= col("n") - window) & (col("rn") < col("n")) & col("close").isNotNull())
    query = last.groupBy("ticker", "n").agg(F.array_sort(F.collect_list(F.struct("rn", "close"))).alias("v")).where(F.size("v") == window)
    return query.select("ticker", "n", F.transform("v", lambda x: x["close"]).alias("query"))


def _search(bars: DataFrame, window: int, gap: int, block: int, best, schema: str) -> DataFrame:
    """What ``best`` (closes, query, starts allowed) finds in every block: rows of start and further numbers."""
    place = F.floor(col("rn") / block)
    both = F.when((col("rn") % block < window - 1) & (col("rn") >= block), F.array(place - 1, place)).otherwise(F.array(place))
    dealt = bars.select("ticker", "rn", "close", F.explode(both).alias("block"))
    queries = last_windows(bars, window, gap)
    ends = col("n") - window - gap - 1
    queries = queries.select("ticker", "query", ends.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(ends / block))).alias("block"))

    queries = queries.toDF(*queries.columns)  # names of its own: it comes from the same bars

    def one(key: tuple, rows: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        if not len(rows) or not len(query):
            return pd.DataFrame([], columns=names)
        rows = rows.sort_values("rn")
        first = int(rows["rn"].iloc[0])
        starts = int(min(len(rows) - window, query["last"].iloc[0] - first, block - 1)) + 1
        found = best(rows["close"].to_numpy(float), np.asarray(query["query"].iloc[0], float), starts) if starts > 0 else []
        return pd.DataFrame([(key[0], first + f[0], *f[1:]) for f in found], columns=names)

    return dealt.groupBy("ticker", "block").cogroup(queries.groupBy("ticker", "block")).applyInPandas(one, schema)


def z_scores(x: np.ndarray) -> np.ndarray:
    """Rows by their own mean and population deviation; zeros where they are constant."""
    x = x - x.mean(axis=-1, keepdims=True)
    dev = np.sqrt((x * x).mean(axis=-1, keepdims=True))
    return np.divide(x, dev, out=np.zeros_like(x), where=dev > 0)


def _windows(values: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(values, window)[starts]


def _exact(values: np.ndarray, z: np.ndarray, starts: np.ndarray):
    """Correlation and distance of the windows at some starts, from their own values."""
    corr, dist = np.empty(len(starts)), np.empty(len(starts))
    for a in range(0, len(starts), AT_ONCE):
        shapes = z_scores(_windows(values, len(z), starts[a : a + AT_ONCE]))
        corr[a : a + AT_ONCE] = shapes @ z / len(z)
        dist[a : a + AT_ONCE] = np.sqrt(((shapes - z) ** 2).sum(axis=1))
    return corr, dist


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.sign(score) * np.floor(np.abs(score) * 1e4 + 0.5)


def best_by_products(values: np.ndarray, query: np.ndarray, starts: int, top: int) -> list[tuple]:
    """(start, correlation, distance) of the ``top`` windows with the best rounded score; ties go to the earlier.

    All products of the query with the series come from one Fourier transform, means and
    deviations from running sums.  Windows near the last place, and those whose running
    deviation can't be trusted, are computed again from their values.
    """
    w, z = len(query), z_scores(query)
    full = np.convolve(np.isnan(values).astype(int), np.ones(w, int), "valid")[:starts] == 0
    if not full.any():
        return []
    x = np.nan_to_num(values - np.nanmean(values))
    size = 1 << (len(x) + w - 1).bit_length()
    dots = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(z[::-1], size), size)[w - 1 : w - 1 + starts]
    sums, squares = (np.concatenate([[0], np.cumsum(v)]) for v in (x, x * x))
    mean = (sums[w:] - sums[:-w])[:starts] / w
    var = (squares[w:] - squares[:-w])[:starts] / w - mean * mean
    # what cancels in the running sums, with a wide margin
    doubtful = full & (var <= 1e-7 * max(float(squares[-1]) / len(x), 1e-300))
    sound = np.flatnonzero(full & ~doubtful)
    corr = dots[sound] / (w * np.sqrt(var[sound]))
    score = corr - np.sqrt(np.maximum(w + z @ z - 2 * w * corr, 0)) / 10
    near = sound[score >= np.partition(score, len(score) - top)[len(score) - top] - 1e-3] if len(sound) > top else sound
    again = np.concatenate([near, np.flatnonzero(doubtful)])
    corr, dist = _exact(values, z, again)
    order = np.lexsort((again, -_rounded(corr - dist / 10)))[:top]
    return [(int(again[i]), float(corr[i]), float(dist[i])) for i in order]


def search_by_products(bars: DataFrame, window: int = 30, gap: int = 60, top: int = 5, block: int = 1 << 16) -> DataFrame:
    """ticker, start, corr, dist, score and rank of the windows most like each ticker's last one, ending ``gap`` bars before it.

    The same windows as ``similarity.search_historical``.  Windows with a missing close are none.
    """
    found = _search(bars, window, gap, block, lambda v, q, n: best_by_products(v, q, n, top), "ticker string, start long, corr double, dist double")
    scored = found.withColumn("score", F.round(col("corr") - col("dist") / 10, 4))
    return scored.withColumn("rank", F.row_number().over(whole().orderBy(F.desc("score"), "start"))).where(col("rank") <= top)


def warping_costs(shapes: np.ndarray, query: np.ndarray, band: int, limit: float) -> np.ndarray:
    """Warping cost (sum of absolute differences) of every row; infinite as soon as it must be over ``limit``."""
    out, alive = np.full(len(shapes), np.inf), np.arange(len(shapes))
    n = len(query)
    x = np.ascontiguousarray(shapes.T)
    before = np.full((n + 1, x.shape[1]), np.inf)
    before[0] = 0
    for i in range(n):
        here = np.full_like(before, np.inf)
        for j in range(max(0, i - band), min(n, i + band + 1)):
            here[j + 1] = np.abs(x[i] - query[j]) + np.minimum(np.minimum(before[j], before[j + 1]), here[j])
        keep = here.min(axis=0) <= limit
        if not keep.all():
            alive, x, here = alive[keep], x[:, keep], here[:, keep]
            if not len(alive):
                return out
        before = here
    out[alive] = before[n]
    return out


def lower_bounds(shapes: np.ndarray, query: np.ndarray, band: int) -> np.ndarray:
    """No row's warping cost is smaller: its ends meet the query's ends, and every value something within the band."""
    n = len(query)
    padded = np.pad(query, band, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * band + 1)[:n]
    over = np.maximum(np.maximum(shapes - view.max(axis=1), view.min(axis=1) - shapes), 0).sum(axis=1)
    ends = np.abs(shapes[:, 0] - query[0]) + (np.abs(shapes[:, -1] - query[-1]) if n > 1 else 0)
    return np.maximum(over, ends)


def best_by_warping(values: np.ndarray, query: np.ndarray, starts: int, top: int, band: int) -> list[tuple]:
    """(start, cost) of the ``top`` windows with the smallest warping cost of their z-scores; ties go to the earlier.

    Windows are warped in the order of their lower bounds, some hundred at a time, until
    the next bound is above the last place's cost; within a window, rows above it end the work.
    """
    w, z = len(query), z_scores(query)
    full = np.flatnonzero(np.convolve(np.isnan(values).astype(int), np.ones(w, int), "valid")[:starts] == 0)
    bounds = np.empty(len(full))
    for a in range(0, len(full), AT_ONCE):
        bounds[a : a + AT_ONCE] = lower_bounds(z_scores(_windows(values, w, full[a : a + AT_ONCE])), z, band)
    order = np.argsort(bounds, kind="stable")
    best: list[tuple[float, int]] = []
    step = max(32, 4 * top)
    for a in range(0, len(order), step):
        limit = best[top - 1][0] if len(best) >= top else np.inf
        own = order[a : a + step]
        own = own[bounds[own] <= limit + 1e-9]
        if not len(own):
            break
        costs = warping_costs(z_scores(_windows(values, w, full[own])), z, band, limit + 1e-9)
        best = sorted(best + [(float(c), int(full[i])) for c, i in zip(costs, own, strict=True) if np.isfinite(c)])[:top]
        step = min(2 * step, 512)
    return [(start, cost) for cost, start in best]


def search_by_dtw(bars: DataFrame, window: int = 30, gap: int = 60, top: int = 5, band: int | None = None, block: int = 1 << 14) -> DataFrame:
    """ticker, start, dtw and rank of the windows with the smallest time-warping cost to each ticker's last one.

    Every window ending ``gap`` bars before it is considered.  ``band``: how many bars a
    value may be warped; by default any number.
    """
    width = window if band is None else band
    found = _search(bars, window, gap, block, lambda v, q, n: best_by_warping(v, q, n, top, width), "ticker string, start long, dtw double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("ticker").orderBy("dtw", "start"))).where(col("rank") <= top)
