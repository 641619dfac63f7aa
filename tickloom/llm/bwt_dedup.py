"""Removal of repeated byte strings, by threshold-bounded interval expansion on a
Burrows-Wheeler transform.

A byte goes if a string of ``minimum`` bytes covers it that also starts in a
document with a smaller id.  Strings are judged on the input and never cross
documents.

How the work is dealt out.  Every window of ``minimum`` bytes has an anchor: its
``SEED``-byte string of smallest hash, the leftmost if tied.  Equal windows have
equal anchors at equal places, so windows only meet those of the same anchor.
Neighbouring windows with one anchor form a segment.  A first scan counts in how
many documents each anchor occurs; the anchors of two or more go into a bit table
(``ANCHOR_BITS`` to ``MOST_ANCHOR_BITS``, by the bytes of the texts, so that it stays
mostly empty).  A second scan sends the segments of those anchors, packed, to groups
by anchor hash.  There are at most ``GROUPS`` of them, so that the rows that travel
grow with the input only; the buckets into which a group is cut follow the input.

The match itself is made in the bucket.  Equal segments (compared byte by byte) are
one string with its smallest document.  The strings' suffixes are put in order and
transformed; a breadth-first backward extension starts from the intervals of single
bytes and grows them one byte a level, so that the common prefixes of neighbouring
suffixes come out by increasing value: a suffix that no longer shares its first
``level`` bytes with a neighbour is dropped.  It stops at ``minimum``; the intervals
left are the repeated windows.  Their smallest document keeps them, all others lose
them.

An anchor in ``crowd`` documents or more could make a bucket grow without bound.
Its segments are reduced to distinct strings by a partial aggregate before they meet
in the same expansion, and the smallest documents are joined back to the copies.  If
even the distinct strings of one anchor are more than ``most_strings``, they are dealt
by longer anchors: a window has room for half of what it lacks to ``minimum`` to the
left or to the right of its anchor, so it is keyed by the anchor with that much more,
and so on until the key is the window itself.

Equal whole texts are one string from the start.  Both tables only save work: where
a large corpus fills them, more segments travel and the result is the same.  Texts
of any length are read in blocks that overlap by ``minimum`` - 1 bytes.

Defined cases: null text is empty; rows with a null id neither lose bytes nor take
any; rows with equal ids don't take from each other; texts shorter than ``minimum``
stay whole; no documents, no rows; extra columns are ignored.  Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .shared import bit_table, discard, heavy_keys_aside, in_table, stored

#: Bytes of an anchor.
SEED = 16
#: Bits of the table of crowded anchors, and of that of repeated ones: a bit for every segment up to the most.
ANCHOR_BITS, MOST_ANCHOR_BITS = 26, 30
#: Groups in which segments travel; a task expands a group bucket by bucket.
GROUPS = 1024
#: Bits of the table's part that one group of anchors fills; and anchors of a group.
CHUNK_BITS, CHUNK_ANCHORS = 18, 500_000
#: Bits of the tables of documents to scan and to cut.
DOC_BITS = 24
#: Anchors, and segment bytes, that a task gathers before it sends them off.
FLUSH_ANCHORS, FLUSH = 1 << 19, 8 << 20
#: Removed spans that a task gathers before it sends them off, and bytes of the texts that meet their spans at a time.
FLUSH_SPANS, TEXT_BYTES = 200_000, 4 << 20
#: Copies of a crowded segment in one row, so that rows are alike in the work they bring.
LISTED = 64
#: Tables of anchors that are merged at a time.
MERGED = 64
_PLACE = (1 << 28) - 1
#: What goes with a packed segment: document, tag of its text, place in it, place of the anchor in the segment, length.
_KINDS = [np.dtype(x) for x in ("<i8", "<i4", "<i4", "<i2", "<i2")]
_KINDS_BYTES = sum(k.itemsize for k in _KINDS)


def blocks(column, minimum: int):
    """(row, place of its first byte in the text, bytes, offsets) of slices; a long text comes in overlapping blocks."""
    for row0, row1, data, offsets in tx.pieces(column):
        if len(data) <= 2 * tx.SLICE_BYTES:
            yield np.arange(row0, row1), np.zeros(row1 - row0, np.int64), data, offsets
            continue
        for a in range(0, len(data) - minimum + 1, tx.SLICE_BYTES):
            part = data[a : a + tx.SLICE_BYTES + minimum - 1]
            yield np.array([row0]), np.array([a]), part, np.array([0, len(part)])


def segments(data, offsets, minimum: int):
    """Row, anchor hash, first window start, last window end and anchor place of every segment."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < minimum:
        return none, none.astype(np.uint64), none, none, none
    rolled = tx.Rolling(tx.byte_values()[data])
    least = rolled.sums[SEED:] - rolled.sums[:-SEED]
    least *= rolled.down[: len(least)]
    least &= np.uint64(~_PLACE & ((1 << 64) - 1))
    least |= np.arange(len(least), dtype=np.uint64)
    width, span = minimum - SEED + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    # windows inside one row; a segment starts where the anchor changes or a row begins
    inside = np.zeros(n + 1, np.int8)
    long = np.diff(offsets) >= minimum
    inside[offsets[:-1][long]] = 1
    inside[offsets[1:][long] - minimum + 1] -= 1
    inside = np.cumsum(inside[: len(least)], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    new[offsets[:-1][long]] = True
    first = np.flatnonzero(new)
    if not len(first):
        return none, none.astype(np.uint64), none, none, none
    row = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(np.append(first[1:], n) - 1, offsets[row + 1] - minimum)
    anchor = (least[first] & np.uint64(_PLACE)).astype(np.int64)
    return row, rolled.spans(anchor, anchor + SEED), first, last + minimum, anchor


def _suffix_order(text: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of (at least) their first ``depth`` bytes, by growing prefixes."""
    total = len(text)
    key = text << 54
    for k in range(1, min(7, total)):
        key[: total - k] |= np.where(left[: total - k] > k, text[k:], 0) << (54 - 9 * k)
    width = 7
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        ranked = key[order]
        rank = np.empty(total, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ranked[1:] != ranked[:-1]]))
        parts = 3 if total < 1 << 21 else 2  # ranks that fit into one key
        key = rank << (21 * (parts - 1) if parts == 3 else 32)
        for k in range(1, parts):
            if k * width < total:
                key[: total - k * width] |= np.where(left[: total - k * width] > k * width, rank[k * width :], 0) << (21 * (parts - 1 - k))
        width *= parts


def repeated(data: np.ndarray, offsets: np.ndarray, minimum: int) -> np.ndarray:
    """For every place in the given strings the interval of its ``minimum`` bytes, -1 if they are unique or cut off."""
    n, strings = len(data), len(offsets) - 1
    sizes = np.diff(offsets)
    place = np.arange(n) + np.repeat(np.arange(strings), sizes)  # a sentinel follows every string
    total = n + strings
    text = np.zeros(total, np.int64)
    text[place] = data.astype(np.int64) + 1
    left = np.zeros(total, np.int64)
    left[place] = np.repeat(offsets[1:], sizes) - np.arange(n)
    order = _suffix_order(text, left, minimum)

    # the transform: the row of the suffix one byte longer, -1 at a string's start
    row_of = np.empty(total, np.int32)
    row_of[order] = np.arange(total, dtype=np.int32)
    longer = np.where((order > 0) & (text[order - 1] > 0), row_of[order - 1], -1)
    head = text[order].astype(np.int16)

    # intervals of one byte, then backward by one byte a level; what can't grow into a whole window is left out
    inner = np.zeros(total, bool)
    inner[place] = np.arange(n) - np.repeat(offsets[:-1], sizes) >= minimum - 1
    rows = np.flatnonzero(inner[order])
    name = np.zeros(len(rows), np.int32)
    carried, marked = np.zeros(total, np.int32), np.zeros(total, bool)
    for level in range(1, minimum + 1):
        if level > 1:
            to = longer[rows]
            ok = to >= 0
            to = to[ok]
            carried[to] = name[ok]
            marked[to] = True
            rows = np.flatnonzero(marked)
            marked[rows] = False
            name = carried[rows]
        first = head[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (name[1:] != name[:-1]) | (first[1:] != first[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]  # the common prefix with either neighbour ends here
        name = np.cumsum(new, dtype=np.int32)[~alone]
        rows = rows[~alone]
        if not len(rows):
            break
    out = np.full(total, -1, np.int64)
    out[order[rows]] = name
    return out[place]


def _least_by_window(data, offsets, windows, least, minimum):
    """The smallest document of every window of the given strings; ``least`` has that of each string."""
    best = np.repeat(least, windows)
    interval = repeated(data, offsets, minimum)[_ragged(offsets[:-1], windows)]
    hit = np.flatnonzero(interval >= 0)
    if len(hit):
        low = np.full(int(interval.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, interval[hit], best[hit])
        best[hit] = low[interval[hit]]
    return best


def _anchor_bits(size: int) -> int:
    """Bits of the table of repeated anchors for that many bytes of text: about one for every segment."""
    return min(max(ANCHOR_BITS, int(size // 18).bit_length()), MOST_ANCHOR_BITS)


def _packed_anchors(h: np.ndarray, parts: int, bits: int) -> pa.RecordBatch:
    """Anchors of one flush by group: 40 bits of each distinct one, and how often those occur that do so twice or more."""
    group = (h >> np.uint64(CHUNK_BITS)) & np.uint64((1 << (bits - CHUNK_BITS)) - 1)
    group = group * np.uint64(parts) + (h >> np.uint64(48)) % np.uint64(parts)
    value = (h & np.uint64((1 << CHUNK_BITS) - 1)) | ((h >> np.uint64(bits)) & np.uint64((1 << 22) - 1)) << np.uint64(CHUNK_BITS)
    key = np.sort(group << np.uint64(40) | value)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    copies = np.diff(np.append(first, len(key)))
    key = key[first]
    group, narrow = (key >> np.uint64(40)).astype(np.int64), key.view(np.uint8).reshape(-1, 8)[:, :5]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(key))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        often = np.flatnonzero(copies[a:b] > 1)
        out.append((int(group[a]), narrow[a:b].tobytes(), often.astype(np.int32).tobytes(), copies[a:b][often].astype(np.int32).tobytes()))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "anchors", "often", "copies"])


def _merged_anchors(group: pa.Table, parts: int, crowd: int) -> pa.Table:
    """The group's chunk of both tables, and how many segments its repeated anchors have."""
    values, copies = [], []
    for raw, often, number in zip(*(group.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
        wide = np.zeros((len(raw) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        count = np.ones(len(wide), np.int64)
        count[np.frombuffer(often, np.int32)] = np.frombuffer(number, np.int32)
        values.append(wide.reshape(-1).view(np.uint64))
        copies.append(count)
    values, copies = np.concatenate(values), np.concatenate(copies)
    order = np.argsort(values)
    values, copies = values[order], copies[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    total = np.add.reduceat(copies, first)
    at = (values[first] & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)
    tables = []
    for chosen in (total > 1, total >= crowd):
        bits = np.zeros(1 << CHUNK_BITS, bool)
        bits[at[chosen]] = True
        tables.append(pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()))
    part = group.column(0)[0].as_py()
    load = int(total[(total > 1) & (total < crowd)].sum())
    return pa.table({"chunk": pa.array([part // parts], pa.int64()), "part": pa.array([part % parts], pa.int64()), "bits": tables[0], "crowded": tables[1], "load": pa.array([load], pa.int64())})


def _either(group: pa.Table) -> pa.Table:
    """Chunks of one place, joined."""
    out = {"chunk": group.column("chunk").slice(0, 1), "part": pa.array([group.column("part")[0].as_py() // MERGED], pa.int64())}
    for c in ("bits", "crowded"):
        out[c] = pa.array([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column(c).to_pylist()]).tobytes()], pa.binary())
    return pa.table(out | {"load": pa.array([sum(group.column("load").to_pylist())], pa.int64())})


def _anchor_tables(source: DataFrame, keep, minimum: int, crowd: int, size: int):
    """Tables of repeated and of crowded anchors, and how many segments of the former there are.

    ``size``: bytes of the texts, which decide into how many groups anchors are dealt.
    """
    bits = _anchor_bits(size)
    parts = max(1, size // 18 // (CHUNK_ANCHORS << (bits - CHUNK_BITS)))

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for row_of, _, data, offsets in blocks(_kept(batch, keep.value).column(1), minimum):
                row, anchor, *_ = segments(data, offsets, minimum)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                held.append(anchor[new])
                count += len(held[-1])
                if count >= FLUSH_ANCHORS:
                    yield _packed_anchors(np.concatenate(held), parts, bits)
                    held, count = [], 0
        if count:
            yield _packed_anchors(np.concatenate(held), parts, bits)

    chunk = "chunk long, part long, bits binary, crowded binary, load long"
    tables = source.mapInArrow(run, "part long, anchors binary, often binary, copies binary").groupBy("part").applyInArrow(lambda g: _merged_anchors(g, parts, crowd), chunk)
    merged = False
    while parts > 1 or not merged:  # once at least: the last step is taken one partition after the other
        tables, merged = tables.groupBy("chunk", F.expr(f"part div {MERGED}")).applyInArrow(_either, chunk), True
        parts = -(-parts // MERGED)
    out, load = [np.zeros(1 << (b - 3), np.uint8) for b in (bits, ANCHOR_BITS)], 0
    for row in tables.toLocalIterator():  # one row a chunk
        for table, raw in zip(out, (row["bits"], row["crowded"]), strict=True):
            at = row["chunk"] % (len(table) >> (CHUNK_BITS - 3)) << (CHUNK_BITS - 3)
            table[at : at + (1 << (CHUNK_BITS - 3))] |= np.frombuffer(raw, np.uint8)
        load += row["load"]
    return out, load


def _kept(batch, bits):
    """The rows of a batch (id, text, tag, id hash) whose id is in the table."""
    return batch.filter(pa.array(in_table(bits, batch.column(3).to_numpy().view(np.uint64))))


def _gathered(source: DataFrame, keep, tables, minimum: int, buckets: int, groups: int) -> DataFrame:
    """Segments of repeated anchors, packed by the group of their bucket."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def packed():
            h, length = (np.concatenate([x[i] for x in held]) for i in (0, 5))
            raw = np.concatenate([x[6] for x in held])
            begin = np.cumsum(length) - length
            bucket = _anchor_bucket(h, buckets) % min(buckets, groups)
            order = np.argsort(bucket, kind="stable")
            firsts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            ends = np.append(firsts[1:], len(order))
            columns = [np.concatenate([x[i] for x in held])[order].astype(kind) for i, kind in enumerate(_KINDS, 1)]
            moved = raw[_ragged(begin[order], length[order])]
            cuts = np.concatenate([[0], np.cumsum(length[order])])
            small = lambda x: pa.compress(x, "zstd", asbytes=True)
            facts = [small(b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
            blobs = [small(moved[cuts[a] : cuts[b]].tobytes()) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][firsts]), pa.array(ends - firsts, pa.int32()), pa.array(facts, pa.binary()), pa.array(blobs, pa.binary())], names=["bucket", "n", "facts", "raw"])

        for batch in batches:
            part = _kept(batch, keep.value)
            ids, tags = part.column(0).to_numpy(), part.column(2).to_numpy()
            for row_of, base, data, offsets in blocks(part.column(1), minimum):
                row, h, start, end, anchor = segments(data, offsets, minimum)
                take = np.flatnonzero(in_table(tables.value[0], h) & ~in_table(tables.value[1], h))
                if not len(take):
                    continue
                row, h, start, end, anchor = row[take], h[take], start[take], end[take], anchor[take]
                raw = data[_ragged(start, end - start)]
                held.append((h, ids[row_of[row]], tags[row_of[row]], base[row] + start - offsets[row], anchor - start, end - start, raw))
                size += len(raw)
                if size >= FLUSH:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return source.mapInArrow(run, "bucket long, n int, facts binary, raw binary")


def _ragged(begin, length):
    """Indexes of consecutive spans."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)


def _runs(doc, tag, at, windows, earlier, minimum):
    """Removed spans of occurrences: ``earlier`` tells window by window whether a smaller document has it."""
    begin = np.cumsum(windows) - windows
    edge = np.zeros(len(earlier), bool)
    edge[begin[windows > 0]] = True
    on = earlier & (edge | ~np.concatenate([[False], earlier[:-1]]))
    nxt = np.concatenate([edge[1:], [True]]) if len(earlier) else edge
    off = earlier & (nxt | ~np.concatenate([earlier[1:], [False]]))
    first, last = np.flatnonzero(on), np.flatnonzero(off)
    own = np.repeat(np.arange(len(windows)), windows)[first] if len(first) else np.zeros(0, np.int64)
    return doc[own], tag[own], at[own].astype(np.int64) + first - begin[own], at[own].astype(np.int64) + last - begin[own] + minimum


def _anchor_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which the segments of an anchor meet."""
    return (tx.mix(h) % np.uint64(buckets)).astype(np.int64)


def _bucket(doc, tag, buckets: int) -> np.ndarray:
    """The group in which a text meets its spans."""
    return (tx.mix(doc.astype(np.uint64) ^ tx.mix(tag.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _packed_spans(doc, tag, start, end, buckets: int) -> pa.RecordBatch:
    """Removed spans, packed by the bucket of their document."""
    bucket = _bucket(doc, tag, buckets)
    order = np.argsort(bucket, kind="stable")
    firsts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    lists = pa.array(np.append(firsts, len(order)), pa.int32())
    column = lambda v, t: pa.ListArray.from_arrays(lists, pa.array(v[order], t))
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][firsts]), column(doc, pa.int64()), column(tag, pa.int32()), column(start, pa.int64()), column(end, pa.int64())], names=["bucket", "doc", "tag", "start", "end"])


_SPANS = "bucket long, doc array<long>, tag array<int>, start array<long>, end array<long>"


def _expand(group: pa.Table, minimum: int, buckets: int, groups: int, doc_buckets: int) -> pa.Table:
    """Removed spans of one group, expanded bucket by bucket."""
    columns, parts = [[] for _ in _KINDS], []
    for n, facts, small in zip(*(group.column(c).to_pylist() for c in ("n", "facts", "raw")), strict=True):
        facts, at = pa.decompress(facts, n * _KINDS_BYTES, "zstd", asbytes=True), 0
        for own, kind in zip(columns, _KINDS, strict=True):
            own.append(np.frombuffer(facts, kind, n, at))
            at += n * kind.itemsize
        parts.append(pa.decompress(small, int(columns[-1][-1].sum(dtype=np.int64)), "zstd", asbytes=True))
    doc, tag, at, left, length = (np.concatenate(c) for c in columns)
    left, length, raw = left.astype(np.int64), length.astype(np.int64), np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(length) - length
    if buckets <= groups:
        found = [_expand_bucket(doc, tag, at, left, length, raw, minimum)]
    else:
        # the anchors' hashes tell the buckets apart
        seeds = raw[(begin + left)[:, None] + np.arange(SEED)].reshape(-1)
        places = np.arange(len(left)) * SEED
        bucket = _anchor_bucket(tx.Rolling(tx.byte_values()[seeds]).spans(places, places + SEED), buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        own = [order[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        found = [_expand_bucket(doc[o], tag[o], at[o], left[o], length[o], raw[_ragged(begin[o], length[o])], minimum) for o in own]
    return pa.Table.from_batches([_packed_spans(*(np.concatenate(c) for c in zip(*found, strict=True)), doc_buckets)])


def _expand_bucket(doc, tag, at, left, length, raw, minimum: int):
    """Removed spans of the segments of one bucket, whose bytes follow each other in ``raw``."""
    begin = np.cumsum(length) - length
    # equal segments are one string, kept by its smallest document; a hash brings them together, their bytes decide
    alike = tx.mix(tx.Rolling(tx.byte_values()[raw]).spans(begin, begin + length) + left.astype(np.uint64))
    order = np.lexsort((doc, length, alike))
    new = np.ones(len(order), bool)
    new[1:] = (alike[order][1:] != alike[order][:-1]) | (length[order][1:] != length[order][:-1])
    first = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(order))))
    same = raw[_ragged(begin[order], length[order])] == raw[_ragged(begin[order[first]], length[order])]
    new |= ~np.logical_and.reduceat(same, np.cumsum(length[order]) - length[order])
    lead = order[new]
    string = np.empty(len(order), np.int64)
    string[order] = np.cumsum(new) - 1
    rank = np.flatnonzero(new)
    own = np.searchsorted(rank, first)  # strings follow the first of their hash, or are one by themselves
    string[order] = np.where(new, np.cumsum(new) - 1, own)
    windows = length[lead] - minimum + 1
    data, cuts = raw[_ragged(begin[lead], length[lead])], np.concatenate([[0], np.cumsum(length[lead])])
    least = _least_by_window(data, cuts, windows, doc[lead], minimum)
    at0, counts = np.cumsum(windows) - windows, windows[string]
    earlier = least[_ragged(at0[string], counts)] < np.repeat(doc, counts)
    return _runs(doc, tag, at, counts, earlier, minimum)


def _dealt_by_longer_anchors(strings: DataFrame, minimum: int, most: int) -> DataFrame:
    """``strings`` (h, left, raw, first) in pieces (place: their first window in the string) of which a key has at most ``most``, or one window each."""
    pieces = strings.select("h", "left", "raw", "first", F.lit(0).alias("place"), F.col("h").alias("key"), F.lit(SEED).alias("seed"), F.col("left").cast("int").alias("at"), F.col("raw").alias("piece"))
    done = None
    while True:
        big = stored(pieces.where(F.col("seed") < minimum).groupBy("key", "seed").count().where(F.col("count") > most).select("key", "seed"), "crowded-keys")
        small = pieces.join(big, ["key", "seed"], "left_anti")
        done = small if done is None else done.unionByName(small)
        if big.isEmpty():
            return done
        half = F.expr(f"cast(({minimum} - seed + 1) div 2 as int)")
        split = pieces.join(big, ["key", "seed"], "left_semi").withColumns({"half": half, "windows": F.length("piece") - minimum + 1})
        # windows with room to the left come first: those that start ``half`` or more before the anchor
        split = split.withColumn("turn", F.greatest(F.lit(0), F.least(F.expr("at - half + 1"), F.col("windows"))))
        byte = lambda a, n: F.substring("piece", F.expr(f"cast({a} + 1 as int)"), F.expr(f"cast({n} as int)"))
        lefts = split.where("turn > 0").select("h", "left", "raw", "first", "place", F.xxhash64(byte("at - half", "half + seed"), F.lit(0)).alias("key"), F.expr("seed + half").alias("seed"), F.expr("at - half").alias("at"), byte("0", f"turn + {minimum - 1}").alias("piece"))
        rights = split.where("turn < windows").select("h", "left", "raw", "first", (F.col("place") + F.col("turn")).alias("place"), F.xxhash64(byte("at", "seed + half"), F.lit(1)).alias("key"), F.expr("seed + half").alias("seed"), F.expr("at - turn").alias("at"), byte("turn", f"windows - turn + {minimum - 1}").alias("piece"))
        pieces = stored(lefts.unionByName(rights), "longer-anchors")


def _crowded(source: DataFrame, keep, tables, minimum: int, per_bucket: int, most: int, doc_buckets: int) -> DataFrame:
    """Removed spans of segments whose anchor occurs in very many documents."""

    def run(batches):
        held: dict[tuple[int, int, bytes], list] = {}
        count = 0

        def packed():
            out = [(h, left, raw, own[i : i + LISTED]) for (h, left, raw), own in held.items() for i in range(0, len(own), LISTED)]
            lists = lambda k, t: pa.array([[x[k] for x in own] for *_, own in out], pa.list_(t))
            return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))), lists(0, pa.int64()), lists(1, pa.int32()), lists(2, pa.int32())], names=["h", "left", "raw", "docs", "tags", "places"])

        for batch in batches:
            part = _kept(batch, keep.value)
            ids, tags = part.column(0).to_numpy(), part.column(2).to_numpy()
            for row_of, base, data, offsets in blocks(part.column(1), minimum):
                row, h, start, end, anchor = segments(data, offsets, minimum)
                take = np.flatnonzero(in_table(tables.value[1], h))
                if not len(take):
                    continue
                row, h, start, end, anchor = row[take], h[take], start[take], end[take], anchor[take]
                columns = (h.view(np.int64), anchor - start, start, end, ids[row_of[row]], tags[row_of[row]], base[row] + start - offsets[row])
                for own, left, a, b, *copy in zip(*(c.tolist() for c in columns), strict=True):
                    held.setdefault((own, left, data[a:b].tobytes()), []).append(copy)
                count += len(take)
                if count >= 50_000:
                    yield packed()
                    held, count = {}, 0
        if held:
            yield packed()

    def expanded(group: pa.Table) -> pa.Table:
        raw = group.column("piece").to_pylist()
        data, length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        windows = length - minimum + 1
        best = _least_by_window(data, np.concatenate([[0], np.cumsum(length)]), windows, group.column("first").to_numpy(), minimum)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(windows)]), pa.int32()), pa.array(best))
        return pa.table([group.column("h"), group.column("left"), group.column("raw"), group.column("place"), lists], names=["h", "left", "raw", "place", "firsts"])

    def spans(batches):
        held, count = [], 0
        packed = lambda: _packed_spans(*(np.concatenate(c) for c in zip(*held, strict=True)), doc_buckets)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):  # up to LISTED copies of some dozen windows each
                docs, tags, places, firsts = (batch.column(i).slice(k, 128) for i in range(4))
                copies, windows = docs.value_lengths().to_numpy().astype(np.int64), firsts.value_lengths().to_numpy().astype(np.int64)
                doc, of = docs.flatten().to_numpy(), np.repeat(np.arange(len(copies)), copies)
                counts = windows[of]
                least = firsts.flatten().to_numpy()[_ragged((np.cumsum(windows) - windows)[of], counts)]
                held.append(_runs(doc, tags.flatten().to_numpy(), places.flatten().to_numpy(), counts, least < np.repeat(doc, counts), minimum))
                count += len(held[-1][0])
                if count >= FLUSH_SPANS:
                    yield packed()
                    held, count = [], 0
        if count:
            yield packed()

    found = stored(source.mapInArrow(run, "h long, left int, raw binary, docs array<long>, tags array<int>, places array<int>"), "crowded")
    # rows with a full list come often for very common strings only: these are dealt over several tasks
    full = F.when(F.size("docs") == LISTED, 1).otherwise(0)
    strings = stored(found.groupBy("h", "left", "raw").agg(F.min(F.array_min("docs")).alias("first"), F.sum(full).alias("full")), "strings")
    totals = strings.agg(F.count("*").alias("n"), F.max("full").alias("full")).first()
    shares = max(1, -(-(totals["full"] or 0) // 256))
    pieces = _dealt_by_longer_anchors(strings.drop("full"), minimum, most)
    buckets = max(1, -(-totals["n"] // per_bucket))
    made = pieces.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).applyInArrow(expanded, "h long, left int, raw binary, place int, firsts array<long>")
    whole = made.groupBy("h", "left", "raw").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "firsts"))), lambda x: x["firsts"])).alias("firsts"))
    share = F.when(F.size("docs") == LISTED, F.pmod(F.xxhash64(F.col("docs")[0]), F.lit(shares)).cast("int")).otherwise(0)
    many = strings.select("h", "left", "raw", F.explode(F.expr(f"sequence(0, if(full > 0, {shares - 1}, 0))")).alias("share"))
    firsts = whole.join(many, ["h", "left", "raw"])
    dealt = found.withColumn("share", share).join(firsts, ["h", "left", "raw", "share"]).where("array_max(docs) > array_min(firsts)").select("docs", "tags", "places", "firsts")
    return stored(dealt.mapInArrow(spans, _SPANS), "crowded-spans")


def _touched(spans: DataFrame) -> np.ndarray:
    """A bit for every document that loses something."""
    chunks = 1 << (DOC_BITS - CHUNK_BITS)

    def mark(batches):
        bits = np.zeros(1 << DOC_BITS, bool)
        for batch in batches:
            bits[(tx.mix(batch.column(0).flatten().to_numpy().astype(np.uint64)) & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)] = True
        raw = [(i, np.packbits(x, bitorder="little").tobytes()) for i, x in enumerate(bits.reshape(chunks, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in raw], pa.int64()), pa.array([x for _, x in raw], pa.binary())], names=["chunk", "bits"])

    def either(group: pa.Table) -> pa.Table:
        joined = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("bits").to_pylist()])
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "bits": pa.array([joined.tobytes()], pa.binary())})

    # tables of many tasks are joined in two steps
    made = spans.select("doc").mapInArrow(mark, "chunk long, bits binary")
    made = made.groupBy("chunk", F.spark_partition_id() % MERGED).applyInArrow(either, made.schema).groupBy("chunk").applyInArrow(either, made.schema)
    out = np.zeros(1 << (DOC_BITS - 3), np.uint8)
    for row in made.toLocalIterator():
        out[row["chunk"] << (CHUNK_BITS - 3) : (row["chunk"] + 1) << (CHUNK_BITS - 3)] = np.frombuffer(row["bits"], np.uint8)
    return out


def _cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """What is left of the texts (id, tag, text) of one bucket without the spans of the same bucket."""
    flat = lambda c: spans.column(c).combine_chunks().flatten().to_numpy() if spans.num_rows else np.zeros(0, np.int64)
    doc, tag, start, end = flat("doc"), flat("tag"), flat("start"), flat("end")
    order = np.lexsort((tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    out, seen = [], set()
    for i, t, text in zip(*(texts.column(c).to_pylist() for c in ("id", "tag", "text")), strict=True):
        a, b = np.searchsorted(doc, [i, i + 1])
        a, b = a + np.searchsorted(tag[a:b], [t, t + 1])
        if a == b or (i, t) in seen:
            continue
        seen.add((i, t))
        raw = np.frombuffer(text.encode(), np.uint8)
        gone = tx.covered(len(raw), start[a:b], end[a:b])
        step = np.diff(gone.astype(np.int8), prepend=0, append=0)
        merged = [{"start": x, "end": y} for x, y in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
        out.append((i, t, int(gone.sum()), len(merged), hashlib.sha256(raw[~gone].tobytes()).hexdigest(), merged))
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "tag", "n_removed", "n_spans", "kept", "ranges"])


def repeated_spans(docs: DataFrame, *, doc_id="doc_id", text="text", minimum=50, crowd=None, per_bucket=8000, most_strings=20_000, groups=GROUPS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ``ranges`` of every row.

    ``crowd``: by default a hundredth of the documents, 1,000 at least and 20,000 at most.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc_id).cast("long").alias("id"), body.alias("text"), F.shiftrightunsigned(F.xxhash64(body), 33).cast("int").alias("tag"), F.xxhash64(F.col(doc_id).cast("long")).alias("k"))
    facts = stored(source.select("id", "tag", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "facts")
    totals = facts.agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).first()
    marked = heavy_keys_aside(facts, "sha", F.col("id").isNotNull() & (F.col("n_bytes") >= minimum), F.min("id").alias("owner"), totals["n"])
    marked = stored(marked.withColumn("copy", F.coalesce(F.col("id") > F.col("owner"), F.lit(False)) & (F.col("n_bytes") >= minimum)).drop("owner"), "facts")
    discard(facts)
    facts = marked

    crowd = crowd or min(max(1000, totals["n"] // 100), 20_000)
    keep = spark.sparkContext.broadcast(bit_table(facts.where(f"id is not null and not copy and n_bytes >= {minimum}").select(F.xxhash64("id").alias("k")), "k", DOC_BITS))
    known = source.where("id is not null")
    made, load = _anchor_tables(known, keep, minimum, crowd, totals["bytes"] or 0)
    tables = spark.sparkContext.broadcast(made)
    buckets, doc_buckets = max(1, -(-load // per_bucket)), max(1, -(-(totals["bytes"] or 0) // TEXT_BYTES))
    packed = _gathered(known, keep, tables, minimum, buckets, groups)
    spans = packed.groupBy("bucket").applyInArrow(lambda g: _expand(g, minimum, buckets, groups, doc_buckets), _SPANS)
    if made[1].any():
        spans = spans.unionByName(_crowded(known, keep, tables, minimum, per_bucket, most_strings, doc_buckets))
    spans = stored(spans, "spans")

    # only documents that lose something travel with their text
    touched = spark.sparkContext.broadcast(_touched(spans))

    def losing(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            part = batch.filter(pa.array(in_table(touched.value, tx.mix(ids.astype(np.uint64)))))
            ids, tags = part.column(0).to_numpy(), part.column(2).to_numpy()
            first = np.sort(np.unique(np.stack([ids, tags]), axis=1, return_index=True)[1]) if len(ids) else []
            part = part.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(part.column(0).to_numpy(), part.column(2).to_numpy(), doc_buckets)), *(part.column(i) for i in (0, 2, 1))], names=["bucket", "id", "tag", "text"])

    texts = known.mapInArrow(losing, "bucket long, id long, tag int, text string")
    cuts = texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_cut, "id long, tag int, n_removed long, n_spans long, kept string, ranges array<struct<start:long,end:long>>")
    whole = F.expr("array(struct(cast(0 as bigint) as start, n_bytes as end))")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    out = facts.join(cuts, ["id", "tag"], "left")
    pick = lambda copy, other, rest: F.when(F.col("copy"), copy).otherwise(F.coalesce(other, rest))
    return out.select(
        F.col("id").alias(doc_id), "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept"), F.col("sha")).alias("kept_sha256"), pick(whole, F.col("ranges"), none).alias("ranges"),
    )
