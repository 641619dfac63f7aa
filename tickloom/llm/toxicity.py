"""Toxicity by multiple-instance learning with a leaky noisy-or.

A text is a bag of sentences (split at ``.``, ``!``, ``?`` and line ends).  A
sentence's score is a logistic function of the sparse weights of its hashed
words and word stems; a text's score is the noisy-or of its sentences and of a leak term that
also gives texts without words their score.  The weights come from document
labels alone, by proximal AdaGrad on the noisy-or likelihood.  Sentences scoring
0.5 or more are reported as offending, with byte spans.

Fitting uses a bounded, hashed sample: at most about ``max_positive`` and
``max_negative`` labelled rows reach the driver, weighted back to their true
shares.  Null and empty texts score the leak; null labels are never learned
from; a doc_id labelled more than once has its largest label, one with several texts is
learned from one of them; without labels the score is the initial leak.  Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .shared import sampled

BITS = 18
#: Besides a whole word, its first so many bytes are features if it is longer: inflected forms share them.
STEMS = (5, 6, 7, 8)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def _sentences(data, offsets):
    """Word and stem features, the sentence of each, and row, first and last byte of each sentence."""
    low = tx.LOWER[data]
    start, end, row = tx.words(low, offsets, tx.ALNUM)
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    rolled = tx.Rolling(tx.byte_values()[low])
    stops = np.cumsum(_STOP[data])[start]
    new = np.ones(len(start), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    sentence = np.cumsum(new) - 1
    features, owners = [rolled.spans(start, end)], [sentence]
    for size in STEMS:
        longer = np.flatnonzero(end - start > size)
        features.append(tx.mix(rolled.spans(start[longer], start[longer] + size) + np.uint64(size)))
        owners.append(sentence[longer])
    feature = (np.concatenate(features) >> np.uint64(64 - BITS)).astype(np.int64)
    return feature, np.concatenate(owners), row[first], start[first], end[last]


def _softplus(z):
    return np.logaddexp(0, z)


class Model:
    def __init__(self, weights, bias, leak):
        self.weights, self.bias, self.leak = weights, bias, leak

    def score(self, data, offsets):
        """Score of each row; row, span and score of each sentence."""
        feature, sentence, row, start, end = _sentences(data, offsets)
        z = self.bias + np.bincount(sentence, self.weights[feature], minlength=len(row))
        against = np.bincount(row, _softplus(z), minlength=len(offsets) - 1) + _softplus(self.leak)
        return -np.expm1(-against), row, start, end, 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", label="toxic", max_positive=4000, max_negative=8000, epochs=12, batch=128, rate=0.15, l1=4e-4, least_docs=4) -> Model:
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    totals = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    rows = []
    for y, most in ((1, max_positive), (0, max_negative)):
        if totals.get(y):
            chosen = sampled(known.where(F.col("y") == y), key, most, totals[y])
            found = docs.select(key, text).join(F.broadcast(chosen), key)  # chosen: at most 2 * most rows
            some = found.groupBy(key).agg(F.coalesce(F.max(text), F.lit("")), F.max("y")).drop(key).collect()  # one text for each
            rows += [(r[0], r[1], totals[y] / max(1, len(some))) for r in some]
    weights, bias, leak = np.zeros(1 << BITS), -7.0, -4.0
    if not rows:
        return Model(weights, bias, leak)
    rows.sort()
    mean = sum(r[2] for r in rows) / len(rows)
    def bag(text):
        data = np.frombuffer(text.encode(), np.uint8)
        feature, sentence, row, *_ = _sentences(data, np.array([0, len(data)]))
        return feature, sentence, len(row)

    seen = np.zeros(1 << BITS, np.int32)
    for t, *_ in rows:
        seen[np.unique(bag(t)[0])] += 1
    usual, bags = seen >= least_docs, []
    for i, (t, y, weight) in enumerate(rows):
        feature, sentence, n = bag(t)
        some = usual[feature]
        bags.append((feature[some].astype(np.int32), sentence[some].astype(np.int32), n, y, weight / mean))
        rows[i] = None  # its text isn't needed any more
    grown, grown_bias, grown_leak = np.full(1 << BITS, 1e-4), 1.0, 1.0
    draw = np.random.default_rng(3)
    for _ in range(epochs):
        order = draw.permutation(len(bags)).tolist()
        for a in range(0, len(order), batch):
            part = [bags[i] for i in order[a : a + batch]]
            shift = np.concatenate([[0], np.cumsum([b[2] for b in part])])
            feature = np.concatenate([b[0] for b in part])
            sentence = np.concatenate([b[1] + s for b, s in zip(part, shift[:-1], strict=True)])
            owner = np.repeat(np.arange(len(part)), [b[2] for b in part])
            y, weight = np.array([b[3] for b in part]), np.array([b[4] for b in part])
            z = bias + np.bincount(sentence, weights[feature], minlength=shift[-1])
            against = np.bincount(owner, _softplus(z), minlength=len(part)) + _softplus(leak)
            pull = weight * np.where(y == 1, -1 / np.maximum(np.expm1(against), 1e-6), 1.0) / len(part)
            down = pull[owner] / (1 + np.exp(-z))
            g = np.bincount(feature, down[sentence], minlength=1 << BITS)
            moved = np.flatnonzero(g)
            grown[moved] += g[moved] ** 2
            step = rate / np.sqrt(grown[moved])
            w = weights[moved] - step * g[moved]
            weights[moved] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            gb, gl = down.sum(), (pull / (1 + np.exp(-leak))).sum()
            grown_bias, grown_leak = grown_bias + gb * gb, grown_leak + gl * gl
            bias -= rate * gb / np.sqrt(grown_bias)
            leak -= rate * gl / np.sqrt(grown_leak)
    return Model(weights, bias, leak)


def score(docs: DataFrame, model: Model, *, key="doc_id", text="text") -> DataFrame:
    """key, score and offending sentences (byte spans and scores) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            scores, offending = [], []
            for row0, row1, data, offsets in tx.pieces(batch.column(1)):
                own, row, start, end, p = shared.value.score(data, offsets)
                bad: dict[int, list] = {}
                for s in np.flatnonzero(p >= 0.5).tolist():
                    base = int(offsets[row[s]])
                    bad.setdefault(int(row[s]), []).append({"start": int(start[s]) - base, "end": int(end[s]) - base, "score": float(p[s])})
                scores += own.tolist()
                offending += [bad.get(i, []) for i in range(row1 - row0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(offending, spans)], names=[key, "score", "offending"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, offending array<struct<start:long,end:long,score:double>>")
