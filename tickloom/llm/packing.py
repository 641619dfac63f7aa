"""Vector best-fit packing of tokenised documents into sequences.

``tokenize`` turns every text into token ids plus a final end id and cuts only
documents longer than a sequence.  ``pack`` deals the pieces by a hash into
groups of about ``group`` pieces; each group is packed on its own, longest piece
first, by vector best-fit: a piece goes to the open sequence that can take it
under every capacity (tokens, documents, attention cost, the sum of squared
lengths) and has the smallest weighted norm of residuals (or the largest weighted
dot product of piece and residuals).  A group wastes at most a few part-filled
sequences, which is nothing against its thousands of pieces, so the group count
follows the input and no task grows with it.

Defined cases: null text is empty and makes one piece with the end id alone;
repeated documents are packed as often as they occur; no documents, no rows;
further columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .shared import stored, worker_cache

#: Distinct parts of words, and ids of them, that a worker remembers (some 40 MB); others are encoded where they occur.
REMEMBERED, REMEMBERED_IDS = 600_000, 4_000_000
#: Parts that go to the tokenizer at once.
AT_ONCE = 2000
#: Trailing characters that the tokenizer always splits from a letter or digit before them.
_TAIL = np.isin(np.arange(256), np.frombuffer(b".,!?%*$#&|", np.uint8))
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def _letter(char: bytes) -> bool:
    """Whether a non-ASCII character stays one letter in the tokenizer's normal form, whatever stands before it."""
    try:
        c = char.decode()
    except UnicodeDecodeError:
        return False
    return len(c) == 1 and "\u00c0" <= c <= "\u04ff" and c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha() and unicodedata.normalize("NFC", c) == c


def _cuts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where each word's trailing punctuation begins, if it can be encoded by itself; else the word's end."""
    if not len(start):
        return end
    solid = np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data))))[end - 1]
    cut = np.where(solid >= start, solid + 1, end)
    tailed = np.flatnonzero(cut < end)
    wide = tailed[data[cut[tailed] - 1] > 127]
    plain = tailed[data[cut[tailed] - 1] < 128]
    cut[plain[~_ALNUM[data[cut[plain] - 1]]]] = -1
    # the last character's bytes as one number
    at, value, going = cut[wide] - 1, np.zeros(len(wide), np.int64), np.ones(len(wide), bool)
    for k in range(4):
        byte = data[np.maximum(at - k, 0)].astype(np.int64)
        value = np.where(going, value | byte << 8 * k, value)
        going &= (byte & 0xC0) == 0x80
    known = {v: _letter(v.to_bytes(4, "big").lstrip(b"\0")) for v in np.unique(value).tolist()}
    cut[wide[~np.fromiter((known[v] for v in value.tolist()), bool, len(wide))]] = -1
    return np.where(cut < 0, end, cut)


class WordIds:
    """Ids of texts by look-up of parts of words, so that a worker encodes each common part once.

    The tokenizer never merges across ASCII white space, nor between a letter or
    digit and the punctuation behind it, so a text's ids are the concatenation of its
    parts' ids.  The tokenizer lower-cases after composing characters, so A-Z are
    lower-cased in words of ASCII alone; others keep their bytes.  Sorted hashes and
    flat arrays hold what is known; their size is bounded.
    """

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.limit = tokenizer, REMEMBERED
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        # entry 0 is the end id
        self.flat, self.first, self.count = np.full(1, end_id, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int32)

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for every part."""
        flat, count = [], []
        for i in range(0, len(parts), AT_ONCE):
            found = self.tokenizer.encode_batch_fast([p.decode() for p in parts[i : i + AT_ONCE]], add_special_tokens=False)
            ids = [e.ids for e in found]
            count.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(count[-1].sum())))
        return np.concatenate(flat), np.concatenate(count)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """Ids of all texts, each followed by the end id, and the number of ids of each."""
        start, end, row = tx.words(data, offsets, tx.SPACED)
        beyond = np.concatenate([[0], np.cumsum(data > 127)])
        plain = beyond[end] == beyond[start]
        data = np.where(tx.covered(len(data), start[plain], end[plain]), tx.LOWER[data], data)
        cut = _cuts(data, start, end)
        pieces = 1 + (cut < end)
        of = np.repeat(np.arange(len(start)), pieces)
        tail = np.zeros(len(of), bool)
        tail[1:] = of[1:] == of[:-1]
        begin, stop, row = np.where(tail, cut[of], start[of]), np.where(tail, end[of], cut[of]), row[of]

        hashes, sample, inverse = np.unique(tx.word_hashes(data, begin, stop), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, hashes)
        at = np.zeros(len(hashes), np.int64)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        at[known] = self.entry[place[known]]
        new = np.flatnonzero(~known)
        flat, first, count = self.flat, self.first, self.count
        if len(new):
            raw = data.tobytes()
            ids, sizes = self._encoded([raw[a:b] for a, b in zip(begin[sample[new]].tolist(), stop[sample[new]].tolist(), strict=True)])
            at[new] = len(first) + np.arange(len(new))
            first = np.concatenate([first, len(flat) + np.cumsum(sizes, dtype=np.int64) - sizes])
            count, flat = np.concatenate([count, sizes]), np.concatenate([flat, ids])
            if len(first) <= self.limit and len(flat) <= REMEMBERED_IDS:  # else what this call brought is forgotten
                self.flat, self.first, self.count = flat, first, count
                self.hashes = np.insert(self.hashes, place[new], hashes[new])
                self.entry = np.insert(self.entry, place[new], at[new])

        entry = np.zeros(len(begin) + len(offsets) - 1, np.int64)  # a text's end id follows its words
        entry[np.arange(len(begin)) + row] = at[inverse]
        counts = count[entry].astype(np.int64)
        ends = np.cumsum(counts)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[entry] - (ends - counts), counts)]
        closing = np.cumsum(np.bincount(row, minlength=len(offsets) - 1) + 1) - 1
        return ids, np.diff(ends[closing], prepend=0)


def _worker_ids(vocabulary: str, end_id: int) -> WordIds:
    """This worker's ``WordIds``; Spark reuses workers, so it serves many tasks."""
    from tokenizers import Tokenizer

    key, cache = (zlib.crc32(vocabulary.encode()), end_id), worker_cache()
    if cache.get("word_ids_of") != key:
        cache["word_ids_of"], cache["word_ids"] = key, WordIds(Tokenizer.from_str(vocabulary), end_id)
    return cache["word_ids"]


def tokenize(docs: DataFrame, tokenizer_file: str, *, doc_id="doc_id", text="text", capacity=2048, end_id=0, with_ids=False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids on request)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size, read on the driver

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _worker_ids(vocabulary.value, end_id)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for row0, _, data, offsets in tx.pieces(batch.column(1), 4 * tx.SLICE_BYTES):
                ids, lengths = encode(data, offsets)
                ids = ids.astype("<u4", copy=False)
                at = 0
                for i, n in enumerate(lengths.tolist()):
                    for p, s in enumerate(range(0, n, capacity)):
                        own = ids[at + s : at + min(s + capacity, n)]
                        row.append(row0 + i)
                        piece.append(p)
                        start.append(s)
                        length.append(len(own))
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            kept.append(own.astype(np.int32))
                    at += n
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=names)

    names = [doc_id, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(doc_id, text).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str):
    """Sequence and offset of each piece; lengths in the order of placement."""
    n = len(lengths)
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1)
    share = demand / capacities
    # an open sequence's residuals, as shares of the capacities; full ones leave the arrays
    left, name, fill = np.zeros((n, 3)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = share[-1, 0] if n else 0.0
    opened, live = 0, 0
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        need = share[i]
        rest = left[:live] - need
        fits = (rest >= -1e-12).all(axis=1)
        if fits.any():
            at = np.flatnonzero(fits)
            score = (weights * rest[at] ** 2).sum(axis=1) if rule == "norm" else -(weights * left[at] * need).sum(axis=1)
            j = int(at[score.argmin()])
        else:
            j = live
            left[j], name[j], fill[j] = 1.0, opened, 0
            live, opened = live + 1, opened + 1
        sequence[i], offset[i] = name[j], fill[j]
        fill[j] += lengths[i]
        left[j] -= need
        if left[j, 0] < least - 1e-12:  # nothing that is still to come fits
            live -= 1
            left[j], name[j], fill[j] = left[live], name[live], fill[live]
    return sequence, offset


def pack(pieces: DataFrame, *, doc_id="doc_id", capacity=2048, most_documents=2048, most_cost=None, weights=(1.0, 0.01, 0.01), rule="norm", group=8000) -> DataFrame:
    """``pieces`` with sequence_id (long, unique over all groups) and offset.

    ``most_documents`` and ``most_cost`` (by default ``capacity`` squared) bound the
    pieces and the attention cost of one sequence.  A piece has a token at least and
    the squares of lengths add up to less than the square of their sum, so with these
    defaults the tokens bind first; set lower ones for sequences of few documents or of
    cheap attention.
    """
    capacities = np.array([capacity, most_documents, most_cost or capacity**2], float)
    w = np.array(weights, float)
    groups = max(1, -(-pieces.count() // group))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", doc_id, "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit(rows["length"].to_numpy(), capacities, w, rule)
        return rows.assign(sequence_id=rows["dealt"].to_numpy() * (1 << 32) + sequence, offset=offset).drop(columns="dealt")

    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64(doc_id, "piece", "ids_crc32"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("dealt").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, *, doc_id="doc_id", text="text", capacity=2048, end_id=0, with_ids=False, **options) -> DataFrame:
    """Tokenise (once: the pieces are stored) and pack."""
    pieces = stored(tokenize(docs, tokenizer_file, doc_id=doc_id, text=text, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    return pack(pieces, doc_id=doc_id, capacity=capacity, **options)


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id and the token ids of each sequence, from pieces packed with ids."""
    inner = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most its capacity
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inner, lambda x: x["ids"])).alias("ids"))
