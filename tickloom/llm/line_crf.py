"""Quality rules and line sequence labelling with a linear-chain CRF.

Each text has exact base counts (words, characters in words, symbols, duplicate
lines, words in repeated five-word windows) and, line by line, a label *content*
or *boilerplate* from Viterbi decoding of a linear-chain conditional random field
over bucketed line features.  A text fails the base rules with fewer than
``least_words`` words or more than ``most_repeated`` percent repeated words;
otherwise the share of its words in content lines decides.

The CRF is trained by gradient ascent on its exact likelihood (forward-backward)
over a bounded, hashed sample of about ``max_train`` documents with a quality
label.  Line labels are latent: they start as the document's and are then decoded
again under the model, as far as their content share agrees with the document's label.

Defined cases: null text has no words and fails; lines without a word take no
part in the sequence; without labelled documents the CRF is neutral and keeps
what passes the base rules; null labels aren't learned from; repeated rows are
judged alike; very long texts are decoded whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .shared import sampled

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?;:=_~^\\/{}[]()\"+-"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True

#: Upper bounds of the buckets of each line feature.
BUCKETS = {
    "words": (1, 3, 7, 15, 40),
    "symbols": (0.0, 0.02, 0.08),
    "upper": (0.05, 0.2, 0.6),
    "digits": (0.0, 0.05, 0.2),
    "marks": (0.0, 0.03, 0.1),
    "mean_word": (2.5, 4.0, 7.0, 10.0),
    "distinct": (0.2, 0.5, 0.8),
    "repeats": (0.0, 0.3),
    "duplicate": (0.5,),
    "stopped": (0.5,),
}
WIDTH = sum(len(v) + 1 for v in BUCKETS.values())


def analyse(data: np.ndarray, offsets: np.ndarray):
    """Base counts by text, and row, word count and active features of every line with a word."""
    rows = len(offsets) - 1
    start, end, row = tx.words(data, offsets, tx.SPACED)
    n_words = np.bincount(row, minlength=rows)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.bincount(row, heads[end] - heads[start], minlength=rows).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]

    hashes = tx.word_hashes(data, start, end)
    first, window = tx.windows(hashes, row, 5)
    keyed = tx.mix(window ^ (row[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(first), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = tx.covered(len(start), first[twice], first[twice] + 5)
    n_repeat = np.bincount(row[repeated], minlength=rows)

    # lines with a word, each from its first to its last byte
    breaks = np.cumsum(data == 10)
    place = breaks[start] if len(start) else np.zeros(0, np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    w0 = np.flatnonzero(new)
    w1 = np.concatenate([w0[1:], [len(start)]]) if len(w0) else w0
    line_row, count = row[w0], w1 - w0
    ends = np.concatenate([np.flatnonzero(data == 10), [len(data)]])
    begin = np.maximum(offsets[line_row], np.concatenate([[-1], ends])[np.searchsorted(ends, start[w0])] + 1) if len(w0) else w0
    finish = np.minimum(offsets[line_row + 1], ends[np.searchsorted(ends, end[w1 - 1] - 1)]) if len(w0) else w0
    whole = tx.word_hashes(data, begin, finish) if len(w0) else np.zeros(0, np.uint64)
    keyed = tx.mix(whole ^ (line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(keyed, kind="stable")
    duplicate = np.zeros(len(w0), bool)
    duplicate[order[1:][keyed[order][1:] == keyed[order][:-1]]] = True
    n_dup = np.bincount(line_row[duplicate], minlength=rows)

    def share(table):
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return (sums[finish] - sums[begin]) / np.maximum(finish - begin, 1)

    line = np.cumsum(new) - 1
    keyed = tx.mix(hashes ^ (line.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(keyed)
    fresh = np.ones(len(start), bool)
    fresh[order[1:][keyed[order][1:] == keyed[order][:-1]]] = False
    safe = np.maximum(count, 1)
    features = {
        "words": count,
        "symbols": share(_SYMBOL),
        "upper": share(_UPPER),
        "digits": share(_DIGIT),
        "marks": share(_MARK),
        "mean_word": np.bincount(line, heads[end] - heads[start], minlength=len(w0)) / safe,
        "distinct": np.bincount(line, fresh, minlength=len(w0)) / safe,
        "repeats": np.bincount(line, repeated, minlength=len(w0)) / safe,
        "duplicate": duplicate,
        "stopped": _STOP[data[end[w1 - 1] - 1]] if len(w0) else duplicate,
    }
    active, base = np.zeros((len(w0), len(features)), np.int64), 0
    for k, (name, values) in enumerate(features.items()):
        active[:, k] = base + np.searchsorted(np.array(BUCKETS[name]), np.asarray(values, float), side="left")
        base += len(BUCKETS[name]) + 1
    return np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1), line_row, count, active


class Crf:
    """Emission weights (2 by features), 2 by 2 transitions; label 1 is content."""

    def __init__(self, emit=None, move=None):
        self.emit = np.zeros((2, WIDTH)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def scores(self, active):
        return self.emit[:, active].sum(axis=2).T

    def viterbi(self, active, lengths, bias=None) -> np.ndarray:
        """Best label of every line; sequences follow one another with the given lengths (all > 0).

        ``bias``: what content gains in every line, if anything.
        """
        scores = self.scores(active)
        if bias is not None:
            scores[:, 1] += bias
        out = np.zeros(len(active), np.int64)
        if not len(active):
            return out
        begin = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        size, begin = lengths[order], begin[order]
        longest, best = int(size[0]), scores[begin].copy()
        back = np.zeros((len(active), 2), np.int8)
        final = np.zeros(len(size), np.int64)
        alive = len(size)
        for t in range(1, longest):
            still = int(np.searchsorted(-size, -t, side="left"))  # sequences longer than t
            final[still:alive] = best[still:alive].argmax(axis=1)
            alive = still
            step = best[:alive, :, None] + self.move[None]
            back[begin[:alive] + t] = step.argmax(axis=1)
            best[:alive] = step.max(axis=1) + scores[begin[:alive] + t]
        final[:alive] = best[:alive].argmax(axis=1)
        label, alive = final.copy(), 0
        for t in range(longest - 1, -1, -1):
            alive = int(np.searchsorted(-size, -t, side="left"))
            out[begin[:alive] + t] = label[:alive]
            label[:alive] = back[begin[:alive] + t, label[:alive]]
        return out


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(sequences, *, steps=60, rate=0.15, ridge=1e-3, weights=None) -> Crf:
    """sequences: (active features, label of the document, labels of the lines) each; exact gradients by forward-backward."""
    crf = Crf()
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    if not sequences:
        return crf
    size = np.array([len(s[0]) for s in sequences])
    active = np.concatenate([s[0] for s in sequences])
    truth = np.concatenate([s[2] for s in sequences])
    begin = np.cumsum(size) - size
    share = np.bincount([s[1] for s in sequences], minlength=2) / len(sequences)
    heavy = np.array([0.5 / max(share[s[1]], 1e-9) / len(s[0]) for s in sequences])  # every document counts once, both labels alike
    longest = int(size[0])
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    moments = [np.zeros_like(crf.emit), np.zeros_like(crf.emit), np.zeros_like(crf.move), np.zeros_like(crf.move)]
    total = (heavy * size).sum()
    for step in range(1, steps + 1):
        scores = crf.scores(active)
        f, b = np.zeros_like(scores), np.zeros_like(scores)
        f[begin] = scores[begin]
        for t in range(1, longest):
            at = begin[: alive[t]] + t
            f[at] = scores[at] + _logsum(f[at - 1][:, :, None] + crf.move, 1)
        for t in range(longest - 2, -1, -1):
            at = begin[: alive[t + 1]] + t
            b[at] = _logsum(crf.move[None] + (scores[at + 1] + b[at + 1])[:, None, :], 2)
        norm = np.repeat(_logsum(f[begin + size - 1], 1), size)
        p = np.exp(f + b - norm[:, None])
        by_line = np.repeat(heavy, size)
        gap = (np.eye(2)[truth] - p) * by_line[:, None]
        g_emit = np.stack([np.bincount(active.ravel(), np.repeat(gap[:, k], active.shape[1]), minlength=WIDTH) for k in range(2)]) / total
        inner = np.ones(len(active), bool)
        inner[begin] = False
        at = np.flatnonzero(inner)
        pair = np.exp(f[at - 1][:, :, None] + crf.move + (scores[at] + b[at])[:, None, :] - norm[at][:, None, None])
        g_move = -(pair * by_line[at][:, None, None]).sum(axis=0)
        np.add.at(g_move, (truth[at - 1], truth[at]), by_line[at])
        g_move /= total
        for w, g, m, v in ((crf.emit, g_emit, *moments[:2]), (crf.move, g_move, *moments[2:])):
            g = g - ridge * w
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return crf


def line_labels(crf: Crf, documents) -> list[np.ndarray]:
    """The best line labels of (active, words by line, label) documents that agree with the document's label.

    At least half of the words of a good document are content, fewer of a bad one;
    where the best labels say otherwise, the document's own label gains in steps.
    """
    if not documents:
        return []
    size = np.array([len(d[0]) for d in documents])
    active, words = np.concatenate([d[0] for d in documents]), np.concatenate([d[1] for d in documents])
    own, begin = np.array([d[2] for d in documents]), np.cumsum(size) - size
    total, push = np.add.reduceat(words, begin), np.zeros(len(size))
    for gain in (*(0.5 * 2**k for k in range(8)), None):
        labels = crf.viterbi(active, size, np.repeat(push * (2 * own - 1), size))
        wrong = (2 * np.add.reduceat(words * labels, begin) >= total) != (own == 1)
        if gain is None or not wrong.any():
            break
        push[wrong] = gain
    labels = np.where(np.repeat(wrong, size), np.repeat(own, size), labels)
    return np.split(labels, begin[1:])


def fit(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", label="quality", max_train=3000, rounds=1, **options) -> Crf:
    """Train on at most about ``max_train`` documents of either label.

    No line has a label of its own.  All lines start with that of their document; then,
    ``rounds`` times, lines take the best labels under the model that agree with the
    document's, and the model is trained again.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    documents = []
    for y, n in known.groupBy("y").count().collect():
        chosen = sampled(known.where(F.col("y") == y), key, max_train // 2, n)
        found = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(chosen), key)  # chosen: at most max_train rows
        rows = found.groupBy(key).agg(F.max(text).alias("text")).select("text").collect()  # one text for each
        for t in sorted(r[0] for r in rows):
            data = np.frombuffer(t.encode(), np.uint8)
            _, _, count, active = analyse(data, np.array([0, len(data)]))
            if len(active):
                documents.append((active, count, int(y > 0)))
    return learn(documents, rounds, **options)


def learn(documents, rounds: int = 1, **options) -> Crf:
    """A CRF from (active, words by line, label) documents whose line labels are not known."""
    lines = [np.full(len(d[0]), d[2]) for d in documents]
    crf = train([(d[0], d[2], own) for d, own in zip(documents, lines, strict=True)], **options)
    for k in range(rounds):
        # at first every line by itself: transitions learned from whole documents only know no change
        lines = line_labels(Crf(crf.emit) if k == 0 else crf, documents)
        crf = train([(d[0], d[2], own) for d, own in zip(documents, lines, strict=True)], **options)
    return crf


def judge(docs: DataFrame, crf: Crf, *, key="doc_id", text="text", least_words=10, most_repeated=20, least_content=0.5) -> DataFrame:
    """Base counts, verdicts, share of words in content lines and the line labels of every row."""
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "line_labels"]

    def run(batches):
        for batch in batches:
            parts = [[] for _ in range(9)]
            for row0, row1, data, offsets in tx.pieces(batch.column(1)):
                base, line_row, count, active = analyse(data, offsets)
                rows = row1 - row0
                lines = np.bincount(line_row, minlength=rows)
                label = crf.viterbi(active, lines[lines > 0])
                content = np.bincount(line_row, count * label, minlength=rows) / np.maximum(base[:, 0], 1)
                failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeated * base[:, 0])
                for k in range(5):
                    parts[k].append(base[:, k])
                parts[5].append(failed)
                parts[6].append(~failed & (content >= least_content))
                parts[7].append(content)
                parts[8] += [x.tolist() for x in np.split(label, np.cumsum(lines)[:-1])]
            whole = [np.concatenate(p) if p else [] for p in parts[:8]]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(w, k) for w, k in zip(whole, kinds, strict=True)), pa.array(parts[8], pa.list_(pa.int8()))], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, line_labels array<tinyint>")
