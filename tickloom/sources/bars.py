"""Bar sources: raw tables to (ticker, ts, rn, open, high, low, close, volume) and scans over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import div, ordered, whole

SCHEMA = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(x, T.DoubleType()) for x in ("open", "high", "low", "close")), T.StructField("volume", T.LongType())])

# Period names and their days.
PERIODS = {"1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730, "3y": 1095, "5y": 1825, "max": 99999}


def numbered(bars: DataFrame) -> DataFrame:
    """``bars`` with the 0-based bar number ``rn`` of each ticker."""
    order = whole().orderBy("ts")
    return bars.withColumn("rn", F.row_number().over(order) - 1)


def bars_from(df: DataFrame, ticker: Column, bucket: Column, price: Column, volume: Column, order: Column) -> DataFrame:
    """Aggregate ticks into bars: first, highest, lowest and last price and the volume of each bucket.

    A partial aggregate, so a hot ticker doesn't travel tick by tick.
    """
    flat = df.select(ticker.alias("ticker"), bucket.alias("ts"), price.alias("price"), volume.alias("size"), order.alias("at"))
    return flat.where("ticker is not null and ts is not null").groupBy("ticker", "ts").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").cast("long").alias("volume")
    )


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-hour bars by event type."""
    e = _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return numbered(bars_from(e, F.col("event_type"), F.window("ts", "4 hours")["start"], F.col("value"), F.lit(1), F.struct("ts", "event_id")))


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by order priority."""
    o = _table(spark, sf_dir, "orders")
    return numbered(bars_from(o, F.col("o_orderpriority"), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")), F.col("o_totalprice"), F.lit(1), F.col("o_orderkey")))


def bars_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by brand; ``part`` is joined by key, the planner picks the side to broadcast by size."""
    li = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    brand = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return numbered(bars_from(li.join(brand, "l_partkey"), F.col("p_brand"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")), F.col("l_extendedprice"), F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber")))


def normalise_columns(df: DataFrame) -> DataFrame:
    """Names trimmed and lower-cased, aliases resolved, adj_close filled from close."""
    found: dict[str, str] = {}
    for name in df.columns:
        key = name.strip().lower()
        if re.search(r"adj.*close", key):
            key = "adj_close"
        key = {"symbol": "ticker", "date": "ts", "datetime": "ts"}.get(key, key)
        found.setdefault(key, name)
    out = df.select(*(F.col(f"`{old}`").alias(new) for new, old in found.items()))
    if "close" in found:
        out = out.withColumn("adj_close", F.coalesce("adj_close", "close") if "adj_close" in found else F.col("close"))
    return out


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Bars from files, with normalised columns; CSV needs a header and is read with types inferred by the caller's schema."""
    reader = spark.read.options(**options)
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    df = normalise_columns(raw)
    casts = {f.name: F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") for f in SCHEMA}
    df = df.withColumns({k: v for k, v in casts.items() if k in df.columns})
    # NaN is a missing value
    return df.withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("open", "high", "low", "close", "adj_close") if x in df.columns and dict(df.dtypes)[x] == "double"})


def fetch_data(bars: DataFrame, ticker: str | None = None, period: str = "1y") -> DataFrame:
    """Bars of one or all tickers whose date is within the period before the ticker's last bar."""
    df = bars if ticker is None else bars.where(F.col("ticker") == ticker.strip().upper())
    last = F.max("ts").over(whole())
    return numbered(df.drop("rn").withColumn("last", last).where(F.col("ts") >= F.date_sub(F.to_date("last"), PERIODS.get(period, 365))).drop("last"))


def with_fallback(primary: DataFrame, secondary: DataFrame, period: str) -> DataFrame:
    """Per ticker the secondary source where the primary is short for the period and the secondary has more bars."""
    days = PERIODS.get(period, 365)
    a, b = primary.drop("rn").withColumn("source", F.lit(0)), secondary.drop("rn").withColumn("source", F.lit(1))
    both = a.unionByName(b)
    n0, n1 = F.sum(F.when(F.col("source") == 0, 1).otherwise(0)).over(whole()), F.sum("source").over(whole())
    use = F.when((F.lit(days) > 365) & (n0 < days * 0.4) & (n1 > n0), 1).when(n0 == 0, 1).otherwise(0)
    return numbered(both.withColumn("use", use).where("source = use").drop("source", "use"))


def fetch_intraday(ticks: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Bars of ``interval`` with the previous close, change and percentage change.

    ``ticks``: ticker, ts, price, size, at (a unique order).
    """
    bars = numbered(bars_from(ticks, F.col("ticker"), F.window("ts", interval)["start"], F.col("price"), F.col("size"), F.struct("ts", "at")))
    previous = F.lag("close").over(ordered())
    return bars.withColumn("prev_close", previous).withColumn("change", F.col("close") - F.col("prev_close")).withColumn("change_pct", div(F.col("change"), "prev_close") * 100)


def fetch_quote(bars: DataFrame) -> DataFrame:
    """The latest bar of each ticker with change, 52-week range and average volume."""
    year = F.col("ts") >= F.col("last") - F.expr("interval 364 days")
    seen = bars.withColumn("last", F.max("ts").over(whole())).withColumn("prev_close", F.lag("close").over(ordered()))
    now = lambda x: F.max_by(x, "ts").alias(x)
    out = seen.groupBy("ticker").agg(
        F.max("ts").alias("ts"), now("open"), now("high"), now("low"), now("close"), now("volume"), now("prev_close"),
        F.max(F.when(year, F.col("high"))).alias("high_52w"), F.min(F.when(year, F.col("low"))).alias("low_52w"), F.avg("volume").alias("avg_volume"),
    )
    return out.withColumn("change", F.col("close") - F.col("prev_close")).withColumn("change_pct", div(F.col("change"), "prev_close") * 100)


def market_snapshot(bars: DataFrame, indices: dict[str, str]) -> DataFrame:
    """ticker, name, price and change_pct of the last against the previous non-null close of the given tickers."""
    names = F.create_map(*[F.lit(x) for pair in indices.items() for x in pair])
    some = bars.where(F.col("ticker").isin(list(indices)) & F.col("close").isNotNull())
    ranked = some.withColumn("k", F.row_number().over(whole().orderBy(F.desc("ts")))).where("k <= 2")
    out = ranked.groupBy("ticker").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("price"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("previous"))
    return out.select("ticker", F.element_at(names, F.col("ticker")).alias("name"), "price", (div(F.col("price") - F.col("previous"), "previous") * 100).alias("change_pct"))


def ticker_list(bars: DataFrame, companies: DataFrame, query: str = "", most: int = 200) -> DataFrame:
    """Tickers with history, with the company's name and sector if known; a substring search on symbol or name."""
    known = companies.select(F.col("symbol").alias("ticker"), "company", "sector").dropDuplicates(["ticker"])
    out = bars.select("ticker").distinct().join(known, "ticker", "left").select("ticker", F.substring(F.coalesce("company", F.lit("")), 1, 30).alias("name"), F.substring(F.coalesce("sector", F.lit("")), 1, 20).alias("sector"))
    q = query.strip().upper()
    if q:
        out = out.where(F.upper("ticker").contains(q) | F.upper("name").contains(q))
    return out.orderBy("ticker").limit(most)
