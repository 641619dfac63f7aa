"""News texts against sector keywords, sector trends, and the three-way judgement."""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import change, first_match, mean, true, whole
from ..functions.storage import few_rows_at_a_time, stored

col = F.col
#: Texts that a Python worker gets at a time.
TEXTS = 500
#: This worker's last automaton.
_KEPT: dict = {}


def keyword_dimension(mapping: DataFrame) -> DataFrame:
    """(keyword, sector, etf, direction, weight) of an event-to-sector map read as multi-line JSON."""
    groups = mapping.select(F.explode("event_keywords").alias("g"))
    return groups.select(F.explode("g.keywords").alias("keyword"), "g.sector", "g.etf", "g.direction", "g.weight")


def _search(words: list[str]) -> ahocorasick.Automaton:
    """One automaton of all words; a worker keeps the one that it built last."""
    automaton = ahocorasick.Automaton()
    for i, word in enumerate(words):
        automaton.add_word(word, i)
    automaton.make_automaton()
    return automaton


def _scan(batches, words: list[str], mark: str):
    """(id, low) of every word in the texts of batches (id, text), which are read one at a time."""
    if _KEPT.get("mark") != mark:
        _KEPT.clear()
        _KEPT.update(mark=mark, words=pa.array(words, pa.string()), automaton=_search([w for w in words if w]), shift="" in words)
    # the empty word is in every text, and no automaton's; it sorts first
    automaton, shift = _KEPT["automaton"], int(_KEPT["shift"])
    for batch in batches:
        rows, found = [], []
        for i, text in enumerate(x.as_py() for x in batch.column(1)):
            if text is None:
                continue
            own = {w + shift for _, w in automaton.iter(text)} if len(automaton) else set()
            own |= {0} if shift else set()
            rows += [i] * len(own)
            found += sorted(own)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), _KEPT["words"].take(pa.array(found, pa.int64()))], names=["id", "low"])


def _hits(low: DataFrame, words: list[str], kind: str) -> DataFrame:
    """(id, low) of every word that a text holds: one pass over each text, whatever the number of words."""
    shared, mark = low.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex
    return low.mapInArrow(lambda batches: _scan(batches, shared.value, mark), f"id {kind}, low string")


def match_keywords(texts: DataFrame, keywords: DataFrame, *, text_id="doc_id", text="text", most_bytes: int = 1 << 25) -> DataFrame:
    """(text id, keyword, sector, etf, direction, weight) of every keyword that a text contains, whatever its case.

    The distinct lower-cased keywords become one Aho-Corasick automaton in every worker, so
    a text is read once however many there are; nothing of the texts is shuffled, only the
    hits meet the dimension by keyword.  What is broadcast is checked: beyond
    ``most_bytes`` of keywords they are dealt by a hash into several automata, one scan each.
    The hits are stored here, with ``TEXTS`` texts at a time in a Python worker.
    Null texts and null keywords match nothing; the empty keyword is in every text.
    """
    fields = ["keyword", "sector", "etf", "direction", "weight"]
    dimension = keywords.select(*fields).distinct().withColumn("low", F.lower("keyword")).where("low is not null")
    words = dimension.select("low").distinct()
    size = words.agg(F.coalesce(F.sum(F.octet_length("low")), F.lit(0))).first()[0]
    parts = max(1, -(-size // most_bytes))
    low, out = texts.select(col(text_id).alias("id"), F.lower(text).alias("low_text")), None
    for part in range(parts):
        own = sorted(r["low"] for r in words.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == part).collect())
        found = _hits(low, own, texts.schema[text_id].dataType.simpleString())
        out = found if out is None else out.unionByName(found)
    with few_rows_at_a_time(texts.sparkSession, TEXTS):
        out = stored(out, "hits")
    return out.join(dimension, "low").select(col("id").alias(text_id), *fields)


def etf_trend(bars: DataFrame) -> DataFrame:
    """up, down or flat: the 20-bar against the 60-bar average of each ticker's last bar."""
    df = bars.withColumns({"a": mean("close", 20), "b": mean("close", 60)}).withColumn("newest", F.max("rn").over(whole())).where("rn = newest")
    return df.select("ticker", F.when(col("a") > col("b"), "up").when(col("a") < col("b"), "down").otherwise("flat").alias("trend"))


def news_scores(matches: DataFrame, trends: DataFrame, *, text_id="doc_id") -> DataFrame:
    """-2..2 per text and ETF: the direction of its keywords, stronger where the ETF's trend agrees."""
    side = F.when(col("direction") == "positive", col("weight")).when(col("direction") == "negative", -col("weight")).otherwise(0.0)
    sums = matches.where("etf is not null").groupBy(text_id, "etf").agg(F.sum(side).alias("lean"), F.count("*").alias("hits"))
    out = sums.join(trends.withColumnRenamed("ticker", "etf"), "etf", "left")
    score = first_match(((col("lean") > 0) & true(col("trend") == "up"), 2), (col("lean") > 0, 1), ((col("lean") < 0) & true(col("trend") == "down"), -2), (col("lean") < 0, -1), default=0)
    return out.select(text_id, "etf", "hits", "lean", score.alias("score"))


def sector_rotation(bars: DataFrame, keep: int = 5, avoid: int = 3, window: int = 20) -> DataFrame:
    """Tickers (sectors) by their 20-bar return: the best are kept, the worst avoided, with their rank from that end; the others held."""
    df = bars.withColumn("ret", change("close", window)).withColumn("newest", F.max("rn").over(whole())).where("rn = newest").select("ticker", "ret")
    df = stored(df, "returns")
    # the ends come from bounded sorts, so only a few rows are numbered together
    ends = []
    for action, most, order in (("keep", keep, (F.desc("ret"), F.asc("ticker"))), ("avoid", avoid, (F.asc_nulls_last("ret"), F.desc("ticker")))):
        best = df.orderBy(*order).limit(most).withColumn("action", F.lit(action))
        ends.append(best.select("ticker", "action", F.row_number().over(Window.partitionBy("action").orderBy(*order)).alias("rank")))
    both = ends[0].unionByName(ends[1].join(ends[0].select("ticker"), "ticker", "left_anti"))
    return df.join(F.broadcast(both), "ticker", "left").select("ticker", "ret", "rank", F.coalesce("action", F.lit("hold")).alias("action"))


def three_way(news: DataFrame, trends: DataFrame, stocks: DataFrame) -> DataFrame:
    """-3..3 per ticker: news, sector trend and the ticker's own statistics.

    ``news``: etf, score; ``trends``: ticker (the etf), trend; ``stocks``: ticker, etf, win_rate (0..1), mean.
    """
    n = news.groupBy("etf").agg(F.sum("score").alias("news"))
    t = trends.select(col("ticker").alias("etf"), "trend")
    df = stocks.join(n, "etf", "left").join(t, "etf", "left")
    a = F.coalesce(F.signum("news"), F.lit(0.0)).cast("int")
    b = F.when(col("trend") == "up", 1).when(col("trend") == "down", -1).otherwise(0)
    c = first_match(((col("win_rate") > 0.6) & (col("mean") > 0), 1), (col("win_rate") < 0.45, -1), default=0)
    out = df.select("ticker", "etf", a.alias("news_score"), b.alias("trend_score"), c.alias("stock_score"))
    total = col("news_score") + col("trend_score") + col("stock_score")
    label = first_match((total >= 2, "strong_bullish"), (total == 1, "bullish"), (total == 0, "neutral"), (total == -1, "bearish"), default="strong_bearish")
    return out.withColumn("total", total).withColumn("judgement", label)


def long_lower_shadow(bars: DataFrame) -> DataFrame:
    """Whether a bar closes up with a lower shadow over twice its body and over the upper one."""
    body, lower, upper = F.abs(col("close") - col("open")), F.least("open", "close") - col("low"), col("high") - F.greatest("open", "close")
    return bars.withColumn("long_lower_shadow", F.when((lower > 2 * body) & (lower > upper) & (col("close") > col("open")), 1).otherwise(0))
