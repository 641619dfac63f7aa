"""Similar price windows within and across tickers."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import div, first_match, ordered, rows, whole
from ..functions.storage import stored

col = F.col


def normalised(values: Column) -> Column:
    """z-scores of an array by its population deviation; zeros if it is constant."""
    n = F.size(values)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    with_mean = F.transform(F.array(F.struct(values.alias("v"), mean(values).alias("m"))), lambda s: F.struct(s["v"].alias("v"), s["m"].alias("m"), F.sqrt(mean(F.transform(s["v"], lambda x: (x - s["m"]) * (x - s["m"])))).alias("d")))
    return F.get(F.transform(with_mean, lambda s: F.when(s["d"] > 0, F.transform(s["v"], lambda x: (x - s["m"]) / s["d"])).otherwise(F.transform(s["v"], lambda x: F.lit(0.0)))), F.lit(0))


def scores(a: Column, b: Column, w: int) -> Column:
    """struct<corr, dist, score> of two z-scored arrays."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    dist = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    return F.struct((dot / w).alias("corr"), dist.alias("dist"), F.round(dot / w - dist / 10, 4).alias("score"))


def windows(bars: DataFrame, window: int) -> DataFrame:
    """Every full window, keyed by its first bar ``start``, as an array of z-scored closes."""
    ahead = ordered().rowsBetween(0, window - 1)
    df = bars.withColumn("values", F.collect_list("close").over(ahead)).where(F.size("values") == window)
    return df.select("ticker", col("rn").alias("start"), normalised(col("values")).alias("shape"))


def search_historical(bars: DataFrame, window: int = 30, gap: int = 60, top: int = 5, dtw: bool = False) -> DataFrame:
    """The windows most like each ticker's last one, ending ``gap`` bars before it; ties go to the earlier.

    The last window of a ticker is joined to its own windows by key: no cross join.
    ``dtw`` adds the time-warping distance of the windows found; it doesn't change their order.
    """
    shapes = windows(bars, window)
    n = bars.groupBy("ticker").agg(F.count("close").alias("n")).where(col("n") >= 2 * window + gap)
    query = shapes.join(n, "ticker").where(col("start") == col("n") - window).select("ticker", "n", col("shape").alias("query"))
    pairs = shapes.join(query, "ticker").where(col("start") <= col("n") - window - gap - 1)
    pairs = pairs.select("ticker", "start", "shape", "query", scores(col("shape"), col("query"), window).alias("s"))
    ranked = pairs.withColumn("rank", F.row_number().over(whole().orderBy(F.desc("s.score"), "start"))).where(col("rank") <= top)
    if dtw:
        return _with_dtw(ranked).select("ticker", "start", "s.*", "dtw", "rank")
    return ranked.select("ticker", "start", "s.*", "rank")


def _with_dtw(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the dynamic time warping distance (absolute cost) of ``shape`` and ``query``, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(dtw=[dtw_distance(a, b) for a, b in zip(pdf["shape"], pdf["query"], strict=True)])

    return pairs.mapInPandas(run, pairs.withColumn("dtw", F.lit(0.0)).schema)


def dtw_distance(a, b) -> float:
    best = [0.0] + [float("inf")] * len(b)
    for x in a:
        corner, best[0] = best[0], float("inf")
        for j, y in enumerate(b, 1):
            corner, best[j] = best[j], abs(x - y) + min(corner, best[j], best[j - 1])
    return float(best[-1])


def latest_shapes(bars: DataFrame, window: int = 30) -> DataFrame:
    """ticker and the z-scored closes of its last full window."""
    last = bars.where(col("close").isNotNull()).withColumn("back", F.row_number().over(whole().orderBy(F.desc("rn")))).where(col("back") <= window)
    out = last.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("rn", "close"))).alias("v")).where(F.size("v") == window)
    return out.select("ticker", normalised(F.transform("v", lambda x: x["close"])).alias("shape"))


#: Query vectors that a task holds at a time.
QUERIES = 64


def search_cross(bars: DataFrame, targets: DataFrame, window: int = 30, top: int = 5) -> DataFrame:
    """For each target ticker the tickers whose last window is most like its own.

    ``targets`` is a stated set of query tickers (column ``ticker``).  It goes over the
    candidates in blocks of ``QUERIES`` vectors of fixed length; each block's best
    partners are found in every partition before they meet by target.
    """
    shapes = stored(latest_shapes(bars, window), "shapes")
    query = shapes.join(targets.select("ticker").distinct(), "ticker").select("ticker", "shape")
    rows, block, out = query.toLocalIterator(), [], None
    while block is not None:
        block = [F.struct(F.lit(r["ticker"]).alias("target"), F.array(*map(F.lit, r["shape"])).alias("query")) for r in itertools.islice(rows, QUERIES)] or None
        if block is None and out is not None:
            break
        known = F.array(*block) if block else F.array().cast("array<struct<target:string,query:array<double>>>")
        pairs = shapes.select("ticker", "shape", F.explode(known).alias("q")).where("ticker <> q.target")
        scored = pairs.select(col("q.target").alias("target"), "ticker", scores(col("shape"), col("q.query"), window).alias("s")).select("target", "ticker", "s.*")
        best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "ticker"))).where(col("rank") <= top)
        out = best if out is None else out.unionByName(best)
    return out


def pattern_features(bars: DataFrame, window: int = 30) -> DataFrame:
    """Direction, return, volatility, drawdown, Sharpe, slope and class of each ticker's last window; none for tickers with fewer bars."""
    last = bars.withColumn("newest", F.max("rn").over(whole())).where(col("rn") > col("newest") - window)
    last = last.withColumn("ret", div(col("close"), F.lag("close").over(ordered())) - 1).withColumn("peak", F.max("close").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    x = col("rn").cast("double")
    out = last.groupBy("ticker").agg(
        F.count("*").alias("bars"), F.count("close").alias("n"), F.min_by("close", "rn").alias("first"), F.max_by("close", "rn").alias("last"), (F.stddev_pop("ret") * F.sqrt(F.lit(252.0))).alias("volatility"), F.min(div(col("close") - col("peak"), "peak")).alias("max_drawdown"),
        F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("dev"), F.regr_slope(col("close"), x).alias("slope"), F.regr_r2(col("close"), x).alias("r2"),
    )
    ret = div(col("last") - col("first"), "first")
    out = out.where(col("bars") == window).withColumn("total_return", ret)
    label = first_match(
        (col("n") < 10, "unknown"), ((col("r2") > 0.7) & (col("slope") > 0), "strong_uptrend"), (col("r2") > 0.7, "strong_downtrend"), ((col("r2") > 0.3) & (col("slope") > 0), "uptrend"), (col("r2") > 0.3, "downtrend"),
        (F.abs(col("total_return")) < 0.05, "sideways"), (col("total_return") > 0, "choppy_up"), default="choppy_down",
    )
    sharpe = F.when(col("dev") > 0, col("mean") / col("dev") * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return out.select("ticker", F.when(col("total_return") > 0, "up").otherwise("down").alias("direction"), "total_return", "volatility", "max_drawdown", sharpe.alias("sharpe"), "slope", label.alias("pattern"))


def extract_windows(bars: DataFrame, window: int = 30) -> DataFrame:
    """Trailing z-scored window of every bar that has a full one."""
    df = bars.withColumn("values", F.collect_list("close").over(rows(window))).where(F.size("values") == window)
    return df.select("ticker", "rn", normalised(col("values")).alias("shape"))
