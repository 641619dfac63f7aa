"""Filter interaction audit by depth-first execution of the permutation trie.

Every order of the filters is a path in a trie; nodes that were reached by the same
filters in another order have the same survivors, so they share one state.  The trie is
walked depth-first: a state's survivors are a DataFrame, persisted while its subtree is
walked and made by one filter from the state above; a state met again is taken from the
memo.  One aggregate of a state's survivors counts, part by part, what stands there and
what every filter that is still to come removes: the edges.  With k filters there are
2 ** k states instead of k! paths, and at most k + 1 persisted at a time.  A persisted block
that is lost with its executor is computed again from the stored table of marks.

``marks`` reads the texts once and keeps a few bytes of each row: its part, a bit for each
filter that it fails, and its labels.  Only digests of equal texts meet by key; those of a
hundredth of all rows or more are broadcast (under a hundred of them).

Filters: A: under ``least_words`` words; B: 100 * distinct words < ``least_distinct`` * words;
C: 100 * ``[A-Z]`` > ``most_capitals`` * code points; D: any of ``SYMBOLS``; E: the text of a
smaller id of the table.  Words are runs without ASCII white space, case counts.

Defined cases: null text is empty; null part is the empty string; a null id has no smaller
one, and its text is no one's original; rows that repeat an id count each by their own
text, and equal texts of one id are not each other's copies; null labels count as 0, of
several labels of an id the largest counts; extra columns are ignored; no rows, no result.
Distinct words are told apart by 64-bit hashes within a text, texts by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .shared import discard, heavy_keys_aside, shared_dir, stored

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"


def _counts(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked."""
    return np.diff(np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])[offsets])


def _failed(data, offsets, least_words, least_distinct, most_capitals) -> np.ndarray:
    """Bits of the filters that look at one text alone."""
    rows = len(offsets) - 1
    start, end, row = tx.words(data, offsets, tx.SPACED)
    n_words = np.bincount(row, minlength=rows)
    hashes = tx.word_hashes(data, start, end)
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[1:] != row[:-1])  # rows are in order before and after
    distinct = np.bincount(row[new], minlength=rows)
    capitals = _counts(data, offsets, (data >= 65) & (data <= 90))
    points = _counts(data, offsets, (data & 0xC0) != 0x80)
    symbols = _counts(data, offsets, np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    tests = (n_words < least_words, 100 * distinct < least_distinct * n_words, 100 * capitals > most_capitals * points, symbols > 0)
    return sum(t.astype(np.int8) << i for i, t in enumerate(tests))


def marks(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", part="source", good="quality", toxic="toxic", least_words=200, least_distinct=50, most_capitals=2) -> DataFrame:
    """part, fails (a bit for each filter), good and toxic (0 or 1) of every row: a stored table."""

    def read(batches):
        for batch in batches:
            for row0, row1, data, offsets in tx.pieces(batch.column(2)):
                failed = _failed(data, offsets, least_words, least_distinct, most_capitals)
                raw, at = data.tobytes(), offsets.tolist()
                digests = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in itertools.pairwise(at)]
                columns = [batch.column(i).slice(row0, row1 - row0) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed, pa.int8()), pa.array(digests, pa.binary())], names=["id", "part", "fails", "digest"])

    source = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text)
    kind = docs.schema[key].dataType.simpleString()
    read_once = stored(source.mapInArrow(read, f"id {kind}, part string, fails byte, digest binary"), "marks")
    owned = heavy_keys_aside(read_once, "digest", F.lit(True), F.min("id").alias("owner"), read_once.count())
    copied = F.coalesce(F.col("owner") < F.col("id"), F.lit(False))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max((F.col(good) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    # stored, so that a join by a hot id can be split
    known = stored(known.where("good = 1 or toxic = 1"), "labels")
    bits = F.col("fails").bitwiseOR(F.when(copied, F.lit(1 << 4)).otherwise(F.lit(0))).cast("byte")
    flags = [F.coalesce(c, F.lit(0)).cast("byte").alias(c) for c in ("good", "toxic")]
    out = stored(owned.select("id", "part", bits.alias("fails")).join(known, "id", "left").select("part", "fails", *flags), "facts")
    discard(read_once, known)
    return out


def _fails(i: int) -> Column:
    return F.col("fails").bitwiseAND(F.lit(1 << i)) != 0


def walk(facts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of every state and edge of the trie: a stored table of (part, state, filter, n, good, toxic, alone).

    ``state``: bits of the filters applied.  With a null filter, n is what is kept there;
    with a filter's number n is what it removes next, good and toxic how many of those
    are good or toxic, and alone how many fail no other filter.
    """
    spark, k = facts.sparkSession, len(filters)
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    met: set[int] = set()

    def visit(survivors: DataFrame, state: int) -> None:
        met.add(state)
        left = [i for i in range(k) if not state >> i & 1]
        found = survivors.groupBy("part").agg(
            F.array(
                F.struct(F.lit(None).cast("int").alias("filter"), F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.lit(0).cast("long").alias("alone")),
                *(
                    F.struct(F.lit(i).alias("filter"), F.count_if(_fails(i)).alias("n"), F.count_if(_fails(i) & (F.col("good") == 1)).alias("good"), F.count_if(_fails(i) & (F.col("toxic") == 1)).alias("toxic"), F.count_if(F.col("fails") == 1 << i).alias("alone"))
                    for i in left
                ),
            ).alias("edges")
        )
        found.select("part", F.lit(state).alias("state"), F.inline("edges")).write.mode("append").parquet(path)
        for i in left:
            after = state | 1 << i
            if after in met:  # the same survivors by another order
                continue
            child = survivors.where(~_fails(i)).persist(StorageLevel.MEMORY_AND_DISK)
            visit(child, after)
            child.unpersist()

    visit(facts, 0)
    return spark.read.schema("part string, state int, filter int, n long, good long, toxic long, alone long").parquet(path)


def audit(facts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for every part, order of all filters and step, zeros included.

    kept, removed, good_lost and toxic_lost after and by the step; redundant: rows that
    fail its filter but went before; unique_fails: rows that fail it alone; shapley: what
    its filter removes, summed over all orders.
    """
    k = len(filters)
    edges = walk(facts, filters)
    steps = []
    for order in itertools.permutations(range(k)):
        state = 0
        for place, i in enumerate(order):
            steps.append({"filter_order": "".join(filters[x] for x in order), "step": place + 1, "filter": i, "before": state, "after": state | 1 << i})
            state |= 1 << i
    factorial = [1]
    for i in range(1, k + 1):
        factorial.append(factorial[-1] * i)
    # in how many orders exactly the filters of a state come before one more
    times = F.array(*(F.lit(factorial[m] * factorial[k - 1 - m] if m < k else 0) for m in range(k + 1)))
    applied = F.bit_count("state")
    edge = F.col("filter").isNotNull()
    place = F.col("state") * (k + 1) + F.coalesce(F.col("filter"), F.lit(k))
    # at most 2 ** k * (k + 1) rows a part
    parts = edges.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(place, F.struct("n", "good", "toxic", "alone")))).alias("at"),
        F.array(*(F.coalesce(F.sum(F.when(edge & (F.col("filter") == i), F.col("n") * F.get(times, applied))), F.lit(0)) for i in range(k))).alias("shares"),
    )
    listed = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:int,before:int,after:int>>")).alias("s")
    rows = parts.select("part", "at", "shares", listed)

    def count(state: Column, column: Column, name: str) -> Column:
        """Nothing is listed where nothing is left."""
        return F.coalesce(F.element_at("at", state * (k + 1) + column)[name], F.lit(0)).cast("long")

    s = lambda name: F.col("s")[name]
    removed, root = count(s("before"), s("filter"), "n"), F.lit(0)
    return rows.select(
        "part", s("filter_order").alias("filter_order"), s("step").alias("step"), count(s("after"), F.lit(k), "n").alias("kept"), removed.alias("removed"),
        (count(root, s("filter"), "n") - removed).alias("redundant"), count(root, s("filter"), "alone").alias("unique_fails"), count(s("before"), s("filter"), "good").alias("good_lost"),
        count(s("before"), s("filter"), "toxic").alias("toxic_lost"), F.get(F.col("shares"), s("filter")).cast("long").alias("shapley"),
    )
