"""WARC archives of pages and their external capture index.

``write_archives`` lets Spark write one WARC/1.1 record per page; the record
terminator (two CRLFs) is the text writer's line separator, so the files are
written by Spark's own committed output, gzipped, and survive lost executors.
``read_archives`` reads the files record by record by Content-Length, checks every
digest and yields one index line per record; ``at`` and ``size`` are the record's place
in the unpacked archive.  Each archive is a run of lines sorted by URL key and time.

``capture_history`` merges these runs externally: limits drawn from a bounded sample of
lines cut every run into sorted slices, a row each, that go to the partition of their
range; there a k-way loser tree merges the slices as they are, without sorting lines
again.  A slice has ``CHUNK`` lines at most and is opened when its first line is due, so a
task holds the slices that overlap one key, not its range.  The partitions follow each other in key order, and limits are whole keys (URL
key, time, archive, place), so that a URL captured very often is split too.

Equal payloads are found by digest.  Pages whose digest is in a table of repeated ones,
of fixed size (``DIGEST_BITS``), meet by digest; all others are written as they come.

Defined cases: null html is an empty payload; null url an empty target; payloads
under ``least`` bytes are always responses; rows that repeat a page_id and its
payload each make a record, and all rows with the largest page_id of a payload
are responses; a null page_id never wins against another id.  No pages give no
archives and an empty index; a missing folder is an error.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import itertools
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bit_table, heavy_keys_aside, in_table, shared_dir, stored

#: The end of every WARC record.
END = "\r\n\r\n"
#: Bits of the table of repeated digests.
DIGEST_BITS = 24
#: Ranges of the index at most, and lines drawn for the limit of each.
MOST_RANGES, DRAWN = 4000, 20
#: Lines of a slice of a run, and bytes of an archive, at most.
CHUNK, ARCHIVE_BYTES = 256, 1 << 28
INDEX = "url_key string, ts string, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, archive string, at long, size long"


def url_key(url):
    """Sort-friendly key: host labels reversed, then port, path and query; no scheme or fragment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_extract(bare, r"^[^/?:]*", 0)
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(reversed_host, F.lit(")"), F.substr(bare, F.length(host) + 1))


def roles(pages: DataFrame, *, page_id="page_id", url="url", html="html", least=1000) -> DataFrame:
    """Pages with digest, size, record type and the response that a revisit refers to."""
    flat = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    flat = flat.withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    facts = stored(flat.select("page_id", "payload_digest", "payload_bytes"), "digests")
    known = facts.where(F.col("payload_bytes") >= least)
    twins = known.groupBy("payload_digest").agg(F.count("*").alias("copies")).where("copies > 1").select(F.xxhash64("payload_digest").alias("h"))
    table = pages.sparkSession.sparkContext.broadcast(bit_table(twins, "h", DIGEST_BITS))

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        return pd.Series(in_table(table.value, h.to_numpy().view(np.uint64)))

    # only pages that may have a twin travel
    marked = flat.withColumn("twin", may_repeat(F.xxhash64("payload_digest")) & (F.col("payload_bytes") >= least))
    alone = marked.where("not twin").drop("twin").withColumn("keeper", F.lit(None).cast(flat.schema["page_id"].dataType))
    met = heavy_keys_aside(marked.where("twin").drop("twin"), "payload_digest", F.lit(True), F.max("page_id").alias("keeper"), facts.count(), known)
    both = alone.unionByName(met)
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    return both.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, per_archive=256, archive_bytes=ARCHIVE_BYTES, epoch="2024-01-01 00:00:00", **columns) -> None:
    """Write archives of at most ``per_archive`` records and about ``archive_bytes`` of payload below ``folder``.

    Payloads that are larger than their share of an archive go to archives with fewer records, by
    size in steps of four; only a payload over ``archive_bytes`` makes a larger archive of its own.
    The capture time is ``epoch`` plus page_id seconds (plus none for ids that
    are not numbers), as the pages carry no time of their own.
    """
    r = roles(pages, **columns)
    seconds = F.coalesce(F.expr("try_cast(page_id as bigint)"), F.lit(0)) % (10**9)
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(epoch).cast("timestamp")) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.when(F.col("record_type") == "response", F.col("html")).otherwise("")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    clean = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[\r\n]", " ")
    headers = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:sha1:"), F.sha1(F.concat_ws("\n", F.col("page_id").cast("string"), uri, "payload_digest").cast("binary")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("X-URL-Key: "), url_key(uri)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("X-Page-ID: "), clean("page_id")),
        F.concat(F.lit("X-Refers-To-Page: "), clean("refers_to")),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *headers), F.lit(END), payload)  # concat_ws leaves out null headers
    share = max(archive_bytes // per_archive, 1)
    largest = pages.agg(F.max(F.octet_length(F.col(columns.get("html", "html"))))).first()[0] or 0
    for step in range(max(math.ceil(math.log(max(largest, 1) / share, 4)), 0) + 1):
        low, high = share * 4 ** (step - 1) if step else -1, share * 4**step
        own = r.where((F.octet_length(payload) > low) & (F.octet_length(payload) <= high)) if largest > share else r
        own.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max(per_archive // 4**step, 1)).option("compression", "gzip").text(f"{folder}/size-{step}")


def records(archive):
    """(headers, payload, place, size) of every record of an unpacked archive, a binary file object, by Content-Length."""
    at = 0
    while first := archive.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        headers, size = {}, len(first)
        while (line := archive.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"record at byte {at} has no end of headers")
            size += len(line)
            name, _, value = line[:-2].decode().partition(": ")
            headers[name] = value
        payload = archive.read(int(headers["Content-Length"]))
        if archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is not terminated")
        size += 2 + len(payload) + 4
        yield headers, payload, at, size
        at += size


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Index lines of all archives below ``folder``; each archive makes one sorted run.

    A response whose payload doesn't match its digest or length is an error, and so is a missing folder.
    """

    def parse(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run = []
                for h, payload, at, size in records(gzip.GzipFile(fileobj=io.BytesIO(raw.as_buffer()))):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
                        raise ValueError(f"payload at byte {at} of {path} doesn't match its digest")
                    run.append((h["X-URL-Key"], h["WARC-Date"], h.get("X-Page-ID"), h["WARC-Target-URI"], h["WARC-Type"], h.get("X-Refers-To-Page"), length, digest, path, at, size))
                run.sort(key=_key)
                yield _lines(run)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(parse, INDEX)


def _key(line):
    """Order of index lines: URL key, time, archive, place."""
    return line[0], line[1], line[8], line[9]


def _lines(run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run, strict=True) if run else [[]] * 11, _TYPES, strict=True)], names=_NAMES)


_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = [pa.int64() if x.split()[1] == "long" else pa.string() for x in INDEX.split(", ")]


class LoserTree:
    """Tournament tree over sorted runs: every step replays one leaf's path.

    Runs may be opened while lines are drawn, as long as they begin at or after the last line; an
    ended run's leaf is taken by the next one.  Each node keeps the loser of its match, and
    the winner that went on, so that any leaf's path can be replayed.
    """

    def __init__(self, runs, key):
        self.key, self.k = key, 1
        self.runs, self.heads, self.free = [None], [None], [0]
        self.lost, self.won = [0, 0], [0, 0]
        for run in runs:
            self.open(run)

    def open(self, run) -> None:
        """Let one more sorted run take part."""
        run = iter(run)
        first = next(run, None)
        if first is None:
            return
        if not self.free:
            self._widen()
        leaf = self.free.pop()
        self.runs[leaf], self.heads[leaf] = run, first
        self._replay(leaf)

    def first(self):
        """The smallest line, which stays; None at the end."""
        return self.heads[self.won[1]] if self.k > 1 else self.heads[0]

    def take(self):
        """Draw the smallest line."""
        leaf = self.won[1] if self.k > 1 else 0
        line, self.heads[leaf] = self.heads[leaf], next(self.runs[leaf], None)
        if self.heads[leaf] is None:
            self.free.append(leaf)
        self._replay(leaf)
        return line

    def _widen(self) -> None:
        """Twice as many leaves; all matches are played again."""
        self.free = list(range(2 * self.k - 1, self.k - 1, -1))
        self.runs, self.heads = self.runs + [None] * self.k, self.heads + [None] * self.k
        self.k *= 2
        self.lost, self.won = [0] * self.k, [0] * self.k
        for node in range(self.k - 1, 0, -1):
            self._match(node)

    def _match(self, node: int) -> None:
        a, b = (c - self.k if c >= self.k else self.won[c] for c in (2 * node, 2 * node + 1))
        x, y = self.heads[a], self.heads[b]
        ahead = y is None or (x is not None and (self.key(x), a) < (self.key(y), b))
        self.won[node], self.lost[node] = (a, b) if ahead else (b, a)

    def _replay(self, leaf: int) -> None:
        node = (leaf + self.k) // 2
        while node:
            self._match(node)
            node //= 2

    def __iter__(self):
        while self.first() is not None:
            yield self.take()


def merged_as_they_come(runs, key):
    """All lines of sorted runs in order; the runs come in the order of their first lines and each is opened when its first line is due."""
    tree, coming = LoserTree([], key), iter(runs)
    run = next(coming, None)
    while run is not None or tree.first() is not None:
        while run is not None and (tree.first() is None or key(run[0]) <= key(tree.first())):
            tree.open(run)
            run = next(coming, None)
        yield tree.take()


def _limits(index: DataFrame, ranges: int) -> list[tuple]:
    """Keys that cut the index into ranges of about as many lines, from a sample of ``DRAWN`` lines for each range."""
    keys, n = index.select("url_key", "ts", "archive", "at"), index.count()
    if ranges == 1 or not n:
        return []
    share = min(1.0, ranges * DRAWN / n)
    drawn = keys.where(F.pmod(F.xxhash64("archive", "at"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * MOST_RANGES * DRAWN)
    some = sorted(tuple(r) for r in drawn.collect())
    return sorted({some[i * len(some) // ranges] for i in range(1, ranges)}) if some else []


def capture_history(index: DataFrame, partitions: int) -> DataFrame:
    """Index lines in global (URL key, timestamp, archive, place) order over the partitions.

    ``index``: stored lines in runs, sorted within each archive.
    """
    limits = _limits(index, min(partitions, MOST_RANGES))
    shared = index.sparkSession.sparkContext.broadcast(limits)  # at most MOST_RANGES keys

    def sliced(batches):
        """Runs, or what a batch has of them, cut at the limits and after ``CHUNK`` lines: a row for each slice."""
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys = list(zip(columns[0], columns[1], columns[8], columns[9], strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i][2] != keys[i - 1][2] or keys[i] < keys[i - 1]), len(keys)]
            parts, firsts = [], []
            for begin, end in zip(edges, edges[1:], strict=False):
                while begin < end:
                    part = bisect.bisect_right(shared.value, keys[begin])
                    cut = bisect.bisect_left(keys, shared.value[part], begin, end) if part < len(shared.value) else end
                    cut = min(cut, begin + CHUNK)
                    parts.append(part)
                    firsts.append(begin)
                    begin = cut
            lists = pa.array([*firsts, len(keys)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.ListArray.from_arrays(lists, c) for c in batch.columns)], names=["part", *_NAMES])

    def merge(batches):
        slices = (row for batch in batches for small in _few(batch) for row in zip(*(c.to_pylist() for c in small.columns), strict=True))
        for _, own in itertools.groupby(slices, key=lambda row: row[0]):
            out = []
            for line in merged_as_they_come((list(zip(*row[1:], strict=True)) for row in own), _key):
                out.append(line)
                if len(out) == 4096:
                    yield _lines(out)
                    out = []
            if out:
                yield _lines(out)

    lists = ", ".join(f"{n} array<{'bigint' if t == pa.int64() else 'string'}>" for n, t in zip(_NAMES, _TYPES, strict=True))
    dealt = index.mapInArrow(sliced, f"part int, {lists}").repartitionByRange(len(limits) + 1, "part")
    first = [F.get(n, F.lit(0)) for n in ("url_key", "ts", "archive", "at")]
    return dealt.sortWithinPartitions("part", *first).mapInArrow(merge, INDEX)


def _few(batch: pa.RecordBatch, rows: int = 16):
    """A batch, some slices at a time."""
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


def archive_pages(pages: DataFrame, *, per_partition=4000, **options) -> DataFrame:
    """Write the pages to archives, read them back and return their capture history."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, **options)
    index = stored(read_archives(spark, folder), "index")
    return capture_history(index, max(1, -(-index.count() // per_partition)))
