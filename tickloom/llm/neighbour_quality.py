"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed terms: byte trigrams, shapes of words (the changes between
letters, capitals, digits and marks within a word), windows of words that the text has
had before, and words equal to the one before.  Terms weigh log(1 + count) times inverse document frequency, counted over
*all* documents.  The latent space is a truncated singular value decomposition of the
labelled sample's unit rows.  Labelled vectors are broadcast: at most
``2 * max_each`` a class by ``rank``, a fixed size.  For every document the cosines with all of them are computed exactly, a block
of documents at a time; the ``neighbours`` nearest vote with their similarity to the power
``sharpness``, weighted back to the classes' true shares.  Labelled texts tied with the last
neighbour vote too.

Fitting draws about ``max_each`` labelled rows of either label by a hash of the id.  The
driver gets their term counts, not their texts: at most 50 KB each, however long they are.

Defined cases: null and empty texts, and texts without a known term, score the share of
good labels, with similarity 0; without labels every score is 0.5; null labels and null ids
are never learned from; an id labelled more than once has its largest label, one with
several texts is learned from one of them; repeated rows score alike; extra columns are
ignored; no rows, no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .shared import sampled

#: Terms are hashed to so many numbers: trigrams to the first half, shapes to a quarter, the rest is for repeats.
TERMS = 1 << 13
#: Documents whose counts stand in memory at a time.
ROWS = 128
#: Words of the windows that count when they come again, and the terms of each.
REPEATED, REPEAT_TERMS = (1, 3, 8), 64


def _classes() -> np.ndarray:
    """Letters of any script, capitals and digits are one class each, every other byte is its own."""
    table = np.arange(256, dtype=np.uint64)
    table[97:123] = 1
    table[128:] = 1
    table[65:91] = 2
    table[48:58] = 3
    return table


_CLASS = _classes()


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each row has each term: rows by ``TERMS``."""
    rows = len(offsets) - 1
    keys = []
    row = np.repeat(np.arange(rows), np.diff(offsets))
    if len(data) > 2:
        wide = data.astype(np.uint64)
        gram = tx.mix(wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)) % np.uint64(TERMS // 2)
        inside = row[:-2] == row[2:]
        keys.append((row[:-2] * TERMS + gram.astype(np.int64))[inside])
    start, end, owner = tx.words(data, offsets, tx.SPACED)
    if len(start):
        kinds = _CLASS[data]
        before = np.concatenate([np.zeros(1, np.uint64), kinds[:-1]])
        before[start] = 0
        turn = np.where(kinds != before, tx.mix(before << np.uint64(8) | kinds | np.uint64(1 << 20)), np.uint64(0))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turn)])
        shape = tx.mix(sums[end] - sums[start]) % np.uint64(TERMS // 4)
        keys.append(owner * TERMS + TERMS // 2 + shape.astype(np.int64))
        hashes = tx.word_hashes(data, start, end)
        for place, k in enumerate(REPEATED):
            first, window = tx.windows(hashes, owner, k)
            order = np.lexsort((window, owner[first]))
            again = order[1:][(window[order][1:] == window[order][:-1]) & (owner[first][order][1:] == owner[first][order][:-1])]
            base = 3 * TERMS // 4 + place * REPEAT_TERMS
            keys.append(owner[first][again] * TERMS + base + (window[again] % np.uint64(REPEAT_TERMS)).astype(np.int64))
        same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) + 1
        keys.append(owner[same] * TERMS + 3 * TERMS // 4 + len(REPEATED) * REPEAT_TERMS + same % REPEAT_TERMS)
    every = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return np.bincount(every, minlength=rows * TERMS).reshape(rows, TERMS)


def _blocks(column):
    """Slices of a quarter megabyte and of at most ``ROWS`` rows."""
    for row0, row1, data, offsets in tx.pieces(column):
        for a in range(0, row1 - row0, ROWS):
            b = min(a + ROWS, row1 - row0)
            yield row0 + a, row0 + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of texts and in how many each term occurs; a task sends one count for each term at most."""

    def count(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for row0, row1, data, offsets in _blocks(batch.column(0)):
                total += (term_counts(data, offsets) > 0).sum(axis=0)
                n += row1 - row0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], n), pa.int64())], names=["term", "df"])

    out = np.zeros(TERMS + 1)
    for term, df in docs.select(text).mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return int(out[-1]), out[:-1]


class Model:
    """Term weights, the latent axes, and the labelled vectors with their votes."""

    def __init__(self, idf, axes, vectors, votes, good, neighbours, sharpness):
        self.idf, self.axes, self.vectors, self.votes, self.good, self.neighbours, self.sharpness = idf, axes, vectors, votes, good, neighbours, sharpness

    @property
    def prior(self) -> float:
        return float(self.votes[self.good].sum() / self.votes.sum()) if len(self.votes) else 0.5

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of term counts; zero without a known term."""
        return _unit(_unit(np.log1p(counts, dtype=np.float32) * self.idf) @ self.axes)

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and largest similarity of each row."""
        if not len(self.votes):
            return np.full(len(counts), 0.5), np.zeros(len(counts))
        near = self.latent(counts) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        weight = np.where(near >= last[:, None], np.maximum(near, 0), 0).astype(np.float64) ** self.sharpness * self.votes
        total = weight.sum(axis=1)
        known = total > 0
        out = np.full(len(counts), self.prior)
        out[known] = np.clip(weight[known][:, self.good].sum(axis=1) / total[known], 0, 1)
        return out, np.where(known, np.clip(near.max(axis=1), 0, 1), 0.0).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-12)


def latent_axes(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The first right singular vectors of x, by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    y = x @ np.random.default_rng(5).standard_normal((x.shape[1], min(rank + 16, *x.shape)), dtype=np.float32)
    for _ in range(rounds):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    return np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T)


def _sample_counts(docs: DataFrame, text: str) -> DataFrame:
    """y, terms and counts (numbers as bytes) of every row."""

    def run(batches):
        for batch in batches:
            for row0, row1, data, offsets in _blocks(batch.column(1)):
                counts = term_counts(data, offsets)
                some = [np.flatnonzero(c) for c in counts]
                terms = [s.astype(np.uint16).tobytes() for s in some]
                values = [np.minimum(c[s], (1 << 32) - 1).astype(np.uint32).tobytes() for c, s in zip(counts, some, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row0, row1 - row0), pa.array(terms, pa.binary()), pa.array(values, pa.binary())], names=["y", "terms", "counts"])

    return docs.select("y", text).mapInArrow(run, "y int, terms binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", label="quality", max_each=2000, rank=64, neighbours=15, sharpness=4.0) -> Model:
    n, df = document_frequencies(docs, text)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32) * (df > 0)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    totals = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    xs, ys, votes = [], [], []
    for y in (0, 1):
        if not totals.get(y):
            continue
        chosen = sampled(known.where(F.col("y") == y), key, max_each, totals[y])
        # chosen: at most 2 * max_each rows
        found = docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key).agg(F.max(text).alias("text"), F.max("y").alias("y"))
        rows = sorted((bytes(r["terms"]), bytes(r["counts"])) for r in _sample_counts(found, "text").collect())
        x = np.zeros((len(rows), TERMS), np.float32)
        for i, (terms, counts) in enumerate(rows):
            x[i, np.frombuffer(terms, np.uint16)] = np.frombuffer(counts, np.uint32)
        del rows
        x = _unit(np.log1p(x, out=x) * idf)
        xs.append(x[x.any(axis=1)])
        ys += [y] * len(xs[-1])
        votes += [totals[y] / max(len(x), 1)] * len(xs[-1])
    x = np.concatenate(xs) if xs else np.zeros((0, TERMS), np.float32)
    xs.clear()
    if not len(x):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0, bool), neighbours, sharpness)
    axes = latent_axes(x, rank)
    return Model(idf, axes, _unit(x @ axes), np.array(votes), np.array(ys, bool), neighbours, sharpness)


def score(docs: DataFrame, model: Model, *, key="doc_id", text="text") -> DataFrame:
    """key, score and similarity of the nearest labelled text (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for row0, row1, data, offsets in _blocks(batch.column(1)):
                scores, best = shared.value.score(term_counts(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row0, row1 - row0), pa.array(scores, pa.float64()), pa.array(best, pa.float64())], names=[key, "score", "best_similarity"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, best_similarity double")
