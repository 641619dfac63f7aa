"""Periodic runs of words: blocks of a power of two matched across their text, matches extended exactly.

A run is a stretch of words with smallest period q (words q apart are identical) of at
least ``least`` words and ``times`` * q words that no neighbouring word extends.  For
every scale b = 8, 16, 32, ... the text's aligned blocks of b words become keys of a
pyahocorasick automaton over integer sequences, which is searched once across the whole
text.  A key has eight integers, each the number of a distinct window of b / 8 words;
numbers of longer windows come from pairs of those of shorter ones, so equal numbers are
equal words.  (Keys of b words would be the same blocks, but in a text of one repeated
word the automaton's failure links would be b long.)  A block that occurs again between
b + 1 and 2 b words later (1 to 16 for b = 8) is a seed for that period.  Seeds are
extended both ways by comparing hashes of spans of halving length, and every stretch that
is long enough is compared word by word before it counts; should a hash have lied, all
stretches of its period are found by comparing the words themselves.  Scales end when no
window of b / 8 words occurs twice.

No run is missed: with period q in b + 1 .. 2 b a run holds at least 2 q > 2 b words
before its last q, so an aligned block of b words and its copy q words later are both in
it (for b = 8 at least 24 - 7 or 2 q words, and 15 are enough).  Of stretches with the
same words that have several periods the smallest is the run's.

A text of n words costs n words for each scale, O(n log n), whatever repeats in it.
Texts are processed whole, a quarter of a megabyte of short ones at a time.

Defined cases: null, empty and short texts have no runs, and their words are kept; null
ids and repeated rows are like any other; extra columns are ignored; no rows, no result.
Distinct words are told apart by 64-bit hashes (BLAKE2 beyond 256 bytes) within one slice.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx

#: Parts of a block, each one integer of a key: short keys keep the automaton's work a letter bounded.
SYMBOLS = 8
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_PAIR = np.dtype([("end", np.int64), ("block", np.int64)])


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all windows of 2 * ``size`` words from those of ``size`` words; equal windows have equal numbers."""
    pairs = names[:-size] * (names.max() + 1) + names[size:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def _seeds(names: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of aligned blocks of ``SYMBOLS`` parts and of their later occurrences at a distance of this scale.

    ``names``: the number of the window of ``part`` words from each place on.  Windows that
    are ``part`` words apart stand side by side in the sequence that is searched.
    """
    n, size = len(names), SYMBOLS * part
    rows = n // part + 1  # a number that no key has ends every column
    place = np.arange(rows * part).reshape(rows, part).T.ravel()
    line = np.append(names, np.full(rows * part - n, names.max() + 1))[place]
    blocks = names[np.arange(0, n - size + part, size)[:, None] + part * np.arange(SYMBOLS)]
    keys: dict[tuple, int] = {}
    own = np.array([keys.setdefault(key, len(keys)) for key in map(tuple, blocks.tolist())], np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, block in keys.items():
        automaton.add_word(key, block)
    automaton.make_automaton()
    hits = np.fromiter(automaton.iter(tuple(line.tolist())), _PAIR)
    at, block = place[hits["end"]] - (size - part), hits["block"]
    if part == 1:  # distances from 1 to 16
        near = np.concatenate([(at - 1) // size, (at - 1) // size - 1])
        at, block = np.concatenate([at, at]), np.concatenate([block, block])
    else:
        near = (at - size - 1) // size
    ok = near >= 0
    ok[ok] = own[near[ok]] == block[ok]
    return near[ok] * size, at[ok]


def _matched(rolled: tx.Rolling, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from places a and b on (step 1) or before them (step -1), at most ``room``."""
    got = np.zeros(len(a), np.int64)
    size = 1 << max(int(room.max(initial=0)).bit_length() - 1, 0)
    while size:
        try_ = np.flatnonzero(got + size <= room)
        p, q = a[try_] + step * got[try_], b[try_] + step * got[try_]
        if step < 0:
            p, q = p - size, q - size
        got[try_[rolled.spans(p, p + size) == rolled.spans(q, q + size)]] += size
        size >>= 1
    return got


def periodic_runs(ids: np.ndarray, hashes: np.ndarray, *, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence, by start, then period."""
    n = len(ids)
    if n < max(least, times):
        return np.zeros((0, 3), np.int64)
    rolled, found, names, part = None, [], ids, 1
    while part == 1 or times * (SYMBOLS * part + 1) <= n:
        a, b = _seeds(names, part)
        names, part = _doubled(names, part), 2 * part
        if names.max() + 1 == len(names):  # nothing repeats that is as long as a part
            part = n
        if not len(a):
            continue
        rolled = rolled or tx.Rolling(hashes)
        period = b - a
        before = _matched(rolled, a, b, a, -1)
        after = _matched(rolled, a, b, n - b, 1)
        length = before + after + period
        ok = length >= np.maximum(least, times * period)
        found.append(np.unique(np.stack([a - before, length, period], 1)[ok], axis=0))
    if not found or not sum(map(len, found)):
        return np.zeros((0, 3), np.int64)
    runs = _smallest(np.concatenate(found))
    true = [(ids[s : s + m - q] == ids[s + q : s + m]).all() for s, m, q in runs.tolist()]
    if not all(true):  # a hash of two different spans: compare all words of those periods
        periods = np.unique(np.concatenate(found)[:, 2])
        runs = _smallest(np.concatenate([_by_comparison(ids, int(q), least, times) for q in periods]))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row for each stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _by_comparison(ids: np.ndarray, period: int, least: int, times: int) -> np.ndarray:
    """All long enough stretches with one period."""
    same = np.concatenate([[False], ids[period:] == ids[:-period], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, length = edges[::2], edges[1::2] - edges[::2] + period
    ok = length >= max(least, times * period)
    return np.stack([start[ok], length[ok], np.full(ok.sum(), period)], 1)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Some words of each row, joined by one blank."""
    blank = end[:-1][row[1:] == row[:-1]]  # the byte after a word that isn't its row's last is white space
    stays = tx.covered(len(data), start, end) if len(start) else np.zeros(len(data), bool)
    stays[blank] = True
    data = data.copy()
    data[blank] = 0x20
    size = np.bincount(row, end - start, minlength=rows).astype(np.int64) + np.bincount(row[1:][row[1:] == row[:-1]], minlength=rows)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(data[stays]))


def collapse(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """key, n_words, runs (start, length, period) and the text without what runs repeat, words joined by one blank.

    A word goes if a run holds it after that run's first period.
    """

    def run(batches):
        for batch in batches:
            for row0, row1, data, offsets in tx.pieces(batch.column(1)):
                start, end, row = tx.words(data, offsets, tx.SPACED)
                hashes = tx.word_hashes(data, start, end)
                ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
                edge = np.searchsorted(row, np.arange(row1 - row0 + 1))
                runs, stays = [], np.ones(len(start), bool)
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    own = periodic_runs(ids[a:b], hashes[a:b], least=least, times=times)
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()])
                    if len(own):
                        stays[a:b] = ~tx.covered(b - a, own[:, 0] + own[:, 2], own[:, 0] + own[:, 1])
                columns = [batch.column(0).slice(row0, row1 - row0), pa.array(np.diff(edge), pa.int64()), pa.array(runs, _RUNS), _joined(data, start[stays], end[stays], row[stays], row1 - row0)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period; ties go to the smallest start, then period.  Null without runs."""
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))
