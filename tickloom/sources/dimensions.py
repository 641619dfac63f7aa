"""Company and keyword dimensions, HTML tables, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored

col = F.col


def strip_tags(html: Column) -> Column:
    """Text of an HTML fragment: tags out, the usual entities decoded, trimmed."""
    text = F.regexp_replace(html, r"<[^>]+>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(text)


def html_cells(pages: DataFrame, *, key="page_id", html="html") -> DataFrame:
    """(key, row, cell, text) of every table cell of every page."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = rows.select(key, "row", F.posexplode(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("cell", "td"))
    return cells.select(key, "row", "cell", strip_tags(col("td")).alias("text"))


def html_links(pages: DataFrame, *, key="page_id", html="html") -> DataFrame:
    """(key, place, href, text) of every link."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))).alias("place", "a"))
    return found.select(key, "place", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), strip_tags(col("a")).alias("text"))


def companies(raw: DataFrame) -> DataFrame:
    """Company rows with lower-case names, dashes for dots in symbols, one row per symbol."""
    names = {"Symbol": "symbol", "Company": "company", "Security": "company", "Sector": "sector", "GICS Sector": "sector", "Sub-Industry": "sub_industry", "GICS Sub-Industry": "sub_industry", "Headquarters": "headquarters", "DateAdded": "date_added", "CIK": "cik", "Founded": "founded", "BusinessSummary": "summary"}
    df = raw.select(*(col(f"`{old}`").alias(new) for old, new in names.items() if old in raw.columns))
    return df.withColumn("symbol", F.replace("symbol", F.lit("."), F.lit("-"))).dropDuplicates(["symbol"])


def missing_summaries(dim: DataFrame) -> DataFrame:
    """Companies whose summary is blank, 'nan' or no longer than ten characters."""
    s = F.trim(F.coalesce("summary", F.lit("")))
    return dim.where((F.lower(s) == "nan") | (F.length(s) <= 10))


def enrich(dim: DataFrame, found: DataFrame) -> DataFrame:
    """``dim`` with missing summaries filled from ``found`` (symbol, summary)."""
    fresh = found.select("symbol", col("summary").alias("fresh")).dropDuplicates(["symbol"])
    s = F.trim(F.coalesce("summary", F.lit("")))
    missing = (F.lower(s) == "nan") | (F.length(s) <= 10)
    return dim.join(fresh, "symbol", "left").withColumn("summary", F.when(missing, F.coalesce("fresh", "summary")).otherwise(col("summary"))).drop("fresh")


def read_mapping(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """An event-to-sector map: one JSON document a file, or one a line."""
    return spark.read.option("multiLine", multi_line).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str, key: str) -> int:
    """Add the rows whose ``key`` the sink doesn't have yet, and return how many; every call is a checkpoint to resume from."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        done = spark.read.option("header", True).schema(df.schema).csv(path).select(key)
        df = df.join(done, key, "left_anti").select(*df.columns)
    fresh = stored(df, "csv")
    fresh.write.mode("append").option("header", True).csv(path)
    return fresh.count()


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
