"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Semantics
---------
Words are runs of ASCII letters and digits and of all characters from U+0080 up,
after lower-casing A-Z.  Every ``size`` consecutive words of an item make a
window; an item with fewer words (but not none) is one window of its own length.
A document word inside any occurrence of any window is *hit*.  A document is
contaminated when at least one word is hit and hits are at least 1/``share`` of
its words.

Null or empty text has no words: zero counts, not contaminated.  Repeated
documents each get a row; repeated items count by their own ids.  An empty
benchmark hits nothing.  Further columns of the inputs are ignored by ``scan``
and kept by ``remove_documents``.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .shared import bit_table, in_table, stored

#: Benchmark text is broadcast in blocks of at most this many bytes; an index takes some four times as much.
BLOCK_BYTES = 16 << 20
_FILTER = (1 << 20) - 1


class WindowIndex:
    """Hash set of the windows of one block of items, in flat arrays: sorted hashes with the place of each window's words and its item."""

    def __init__(self, items, size: int):
        self.ids = [str(i) for i, _ in items]
        held: dict[int, list] = {}
        words_of, base = [], 0
        for row0, _, data, offsets in tx.pieces(pa.array([t for _, t in items], pa.string())):
            data = tx.LOWER[data]
            start, end, row = tx.words(data, offsets, tx.ALNUM)
            hashes = tx.word_hashes(data, start, end)
            # the words, each followed by a space
            length = end - start + 1
            to = np.cumsum(length) - length
            words = np.full(int(length.sum()), 32, np.uint8)
            inner = np.ones(len(words), bool)
            inner[to + length - 1] = False
            words[inner] = data[_ragged(start, end - start)]
            words_of.append(words)
            counts = np.bincount(row, minlength=len(offsets) - 1)
            for n in {min(size, c) for c in np.unique(counts).tolist()} - {0}:
                first, mark = tx.windows(hashes, row, n)
                own = counts[row[first]] >= size if n == size else counts[row[first]] == n
                first, mark = first[own], mark[own]
                held.setdefault(n, []).append((mark, base + to[first], base + to[first + n - 1] + length[first + n - 1] - 1, row0 + row[first]))
            base += len(words)
        self.words = np.concatenate(words_of) if words_of else np.zeros(0, np.uint8)
        self.windows = {}
        for n, parts in held.items():
            mark, begin, stop, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(mark, kind="stable")
            known = np.zeros(_FILTER + 1, bool)
            known[(mark & np.uint64(_FILTER)).astype(np.int64)] = True
            self.windows[n] = mark[order], begin[order], stop[order], item[order].astype(np.int32), known

    def hits(self, data, start, end, row, hashes):
        """First word, length and items of every verified occurrence."""
        raw, seen = None, {}
        for length, (known, begin, stop, item, some) in self.windows.items():
            first, mark = tx.windows(hashes, row, length)
            maybe = np.flatnonzero(some[(mark & np.uint64(_FILTER)).astype(np.int64)])
            a, b = np.searchsorted(known, mark[maybe], "left"), np.searchsorted(known, mark[maybe], "right")
            for k in np.flatnonzero(b > a).tolist():
                raw = data.tobytes() if raw is None else raw
                j = int(first[maybe[k]])
                words = b" ".join(raw[start[x] : end[x]] for x in range(j, j + length))
                if words not in seen:
                    seen[words] = {self.ids[item[x]] for x in range(a[k], b[k]) if self.words[begin[x] : stop[x]].tobytes() == words}
                if seen[words]:
                    yield j, length, seen[words]


def _ragged(begin, length):
    """Indexes of consecutive spans."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)


def item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int):
    """The stated query set in blocks of bounded size, one at a time on the driver."""
    block, held = [], 0
    for r in benchmark.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1])
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", size=13, share=20, block_bytes=BLOCK_BYTES, carry=()) -> DataFrame:
    """One row per document: counts, hit items, verdict and hit spans.

    A benchmark within ``block_bytes`` is broadcast whole: one pass, no shuffle.
    A larger one goes block by block; each pass holds one block only and stores the
    hits of the texts that have any, which are joined by id and text in the end.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and
    ``spans``: half-open byte ranges of the hit words, merged over adjacent words;
    then the columns named in ``carry``, as carried_0 and so on.
    """
    spark = docs.sparkSession
    none = [F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("held"), F.expr("cast(array() as array<string>)").alias("items")]
    carried = [F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)]
    state = docs.select(F.col(doc_id), F.col(text), *none, *carried)
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    ahead = list(itertools.islice(blocks, 2))
    if len(ahead) < 2:
        return _with_hits(state, spark.sparkContext.broadcast(WindowIndex(ahead[0] if ahead else [], size)), doc_id, share, last=True)
    found = None
    for block in itertools.chain(ahead, blocks):
        shared = spark.sparkContext.broadcast(WindowIndex(block, size))
        one = stored(_with_hits(docs.select(F.col(doc_id), F.col(text), *none, F.xxhash64(text).alias("tag")), shared, doc_id, share, last=False), "decontamination")
        found = one if found is None else found.unionByName(one)
        shared.unpersist()
    # a text has at most one span for each of its words and block
    hits = found.dropDuplicates(["id", "tag", "block"]).groupBy("id", "tag").agg(F.flatten(F.collect_list("held")).alias("held"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hits = stored(hits, "hits")
    table = spark.sparkContext.broadcast(bit_table(hits.select("tag"), "tag"))

    @F.pandas_udf("boolean")
    def may_hit(tag: pd.Series) -> pd.Series:
        return pd.Series(in_table(table.value, tag.to_numpy().view(np.uint64)))

    # only texts with hits travel
    marked = docs.select(F.col(doc_id), F.col(text), *carried, F.xxhash64(text).alias("tag")).withColumn("hit", may_hit("tag"))
    met = marked.where("hit").drop("hit").alias("d").join(hits.alias("h"), F.col("d.tag").eqNullSafe(F.col("h.tag")) & F.col(f"d.{doc_id}").eqNullSafe(F.col("h.id")), "left")
    empty = lambda c, kind: F.coalesce(f"h.{c}", F.array().cast(kind)).alias(c)
    met = met.select(f"d.{doc_id}", f"d.{text}", empty("held", "array<struct<start:long,end:long>>"), empty("items", "array<string>"), *(f"d.carried_{i}" for i in range(len(carry))))
    rest = marked.where("not hit").select(doc_id, text, *none, *(f"carried_{i}" for i in range(len(carry))))
    return _with_hits(rest.unionByName(met), None, doc_id, share, last=True)


def _with_hits(state: DataFrame, index, doc_id: str, share: int, last: bool) -> DataFrame:
    """Verdicts of all rows with what is ``held`` and the index's hits; or, before the last pass, the hits of the rows that have any.

    ``held`` and the hits of a pass are spans of words.
    """
    block = uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            held, known, out, rows = batch.column(2).to_pylist(), batch.column(3).to_pylist(), [], []
            for row0, row1, data, offsets in tx.pieces(batch.column(1)):
                data = tx.LOWER[data]
                start, end, row = tx.words(data, offsets, tx.ALNUM)
                n_words = np.bincount(row, minlength=row1 - row0)
                first = np.concatenate([[0], np.cumsum(n_words)])
                spans = [(int(first[i]) + s["start"], int(first[i]) + s["end"]) for i in range(row1 - row0) for s in held[row0 + i]]
                items = {i: set(known[row0 + i]) for i in range(row1 - row0) if known[row0 + i]}
                if index is not None:
                    for j, length, who in index.value.hits(data, start, end, row, tx.word_hashes(data, start, end)):
                        spans.append((j, j + length))
                        items.setdefault(int(row[j]), set()).update(who)
                marks = np.array(spans, np.int64).reshape(-1, 2)
                hit = tx.covered(len(start), marks[:, 0], marks[:, 1])
                n_hit = np.bincount(row[hit], minlength=row1 - row0)
                places = np.arange(len(start))
                merged = _spans(hit, start, end, row, offsets) if last else _spans(hit, places, places + 1, row, first)
                for i in range(row1 - row0) if last else sorted(items):
                    own = sorted(items.get(i, ()))
                    if last:
                        out.append((int(n_words[i]), int(n_hit[i]), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), bool(n_hit[i] > 0 and share * n_hit[i] >= n_words[i]), merged.get(i, [])))
                    else:
                        rows.append(row0 + i)
                        out.append((merged[i], own, block))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), _SPANS) if last else (_SPANS, pa.list_(pa.string()), pa.string())
            columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[4:]], names=names)
            else:
                of = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(4).take(of), *made], names=names)

    kind = state.schema[doc_id].dataType.simpleString()
    if last:
        schema = f"`{doc_id}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
        schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in state.schema[4:])
        names = [doc_id, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *state.columns[4:]]
    else:
        schema, names = f"id {kind}, tag long, held array<struct<start:long,end:long>>, items array<string>, block string", ["id", "tag", "held", "items", "block"]
    return state.mapInArrow(run, schema)


def _spans(hit, start, end, row, offsets) -> dict:
    """Merged byte spans of runs of hit words, by row."""
    at = np.flatnonzero(hit)
    out: dict[int, list] = {}
    for j in at.tolist():
        own = out.setdefault(int(row[j]), [])
        base = int(offsets[row[j]])
        if own and j and hit[j - 1] and row[j - 1] == row[j]:
            own[-1]["end"] = int(end[j]) - base
        else:
            own.append({"start": int(start[j]) - base, "end": int(end[j]) - base})
    return out


def _rejoined(docs: DataFrame, verdicts: DataFrame, doc_id: str, how: str) -> DataFrame:
    return docs.join(verdicts, docs[doc_id].eqNullSafe(verdicts["__id"]), how)


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, text="text", item_id="item_id", item_text="text", size=13, share=20, block_bytes=BLOCK_BYTES, **options) -> DataFrame:
    """The rows that are not contaminated, all columns kept; one scan, no shuffle, for a benchmark of one block."""
    blocks = list(itertools.islice(item_blocks(benchmark, item_id, item_text, block_bytes), 2))
    if len(blocks) > 1:
        found = scan(docs, benchmark, text=text, item_id=item_id, item_text=item_text, size=size, share=share, block_bytes=block_bytes, carry=docs.columns, **options)
        return found.where("not contaminated").select(*(F.col(f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)))
    index = docs.sparkSession.sparkContext.broadcast(WindowIndex(blocks[0] if blocks else [], size))

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        """Only texts go to Python, and only verdicts come back."""
        out = []
        for row0, row1, data, offsets in tx.pieces(texts):
            data = tx.LOWER[data]
            start, end, row = tx.words(data, offsets, tx.ALNUM)
            found = [(j, j + n) for j, n, _ in index.value.hits(data, start, end, row, tx.word_hashes(data, start, end))]
            marks = np.array(found, np.int64).reshape(-1, 2)
            n_words = np.bincount(row, minlength=row1 - row0)
            n_hit = np.bincount(row[tx.covered(len(start), marks[:, 0], marks[:, 1])], minlength=row1 - row0)
            out.append((n_hit == 0) | (share * n_hit < n_words))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(clean(F.col(f"`{text}`")))


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """doc_id and the text without its hit spans, for every document."""
    found = scan(docs, benchmark, doc_id=doc_id, text=text, **options)
    cut = found.select(F.col(doc_id).alias("__id"), "spans").where(F.size("spans") > 0).dropDuplicates(["__id"])

    def strip(batches):
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if t is not None and spans:
                    raw, kept, at = t.encode(), [], 0
                    for s in spans:
                        kept.append(raw[at : s["start"]])
                        at = s["end"]
                    t = b"".join([*kept, raw[at:]]).decode()
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, text])

    joined = _rejoined(docs.select(doc_id, text), cut, doc_id, "left").select(doc_id, text, "spans")
    return joined.mapInArrow(strip, docs.select(doc_id, text).schema)
