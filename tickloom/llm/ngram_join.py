"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document's row of the incidence matrix is its set of distinct ``size``-word
shingles (words are lower-cased A-Z runs without ASCII white space; a shorter text
has its whole word sequence as the only shingle).  Documents link when
``percent`` * union <= 100 * intersection.

Only the part of the product that can matter is computed.  Rows are sorted by one
global order of shingles, from rare to common, so that by their sizes two linked rows
must share a shingle in their first places (the size-derived bounds of ``probe``
and ``index`` lengths); the product over those columns, one block per shingle,
yields candidate pairs, which size and position bounds thin out further.  An entry
carries the ``BEFORE`` entries before it, and two rows don't meet in a block where those
overlap: they have met in that earlier block.  For the
remaining pairs overlap counts are accumulated over ``PARTS`` blocks of all columns;
a pair goes as soon as what it has and what is left can't reach the bound.  Equal
sets are one row of the matrix from the start.  Each block's rows are first linked to
two hubs of the block, so that a group of near copies falls together in linear work;
only pairs between different groups go through the whole product.

Every link between different texts counts in the components; nothing is capped.
Hubs with more than a hundredth of all pairs are met by several tasks, and so are
blocks of very many rows.  The order of shingles is only a matter of speed: it reads
tables of fixed size (``COMMON_BITS``) of the shingles seen in many documents, one for
each size in ``COMMON``.

Defined cases: null and wordless texts have no shingles and link with nothing;
rows with a null id have a null component; rows that repeat an id are one
document; equal texts are linked; no documents, no rows; extra columns ignored.
``one_per_component`` judges every row by its own text, whatever its id.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .components import components
from .shared import bit_table, bit_tables, discard, in_table, stored

#: Bits of the tables of common shingles and of the table of documents to verify.
COMMON_BITS = 24
#: Occurrences from which a shingle comes later in the order.
COMMON = (32, 128, 512, 2048, 8192, 65536)
#: Bits of the table of columns with more than one row.
COLUMN_BITS = 26
#: Blocks of columns in which overlaps are bounded by counts, and in which they are accumulated.
CELLS, PARTS = 256, 16
#: Earlier entries of its row that an entry carries.
BEFORE = 8
#: Rows of a block that meet in one task, and texts that a Python worker gets at a time.
BLOCK_ROWS, TEXTS = 500, 2000
#: Shingles of a text window of this many, in which repeated ones are counted before the shuffle.
WINDOW = 1 << 21


def shingle_rows(data, offsets, size: int):
    """Distinct shingles sorted by (row, hash), as rows and hashes."""
    data = tx.LOWER[data]
    start, end, row = tx.words(data, offsets, tx.SPACED)
    words = tx.word_hashes(data, start, end)
    first, grams = tx.windows(words, row, size)
    rows = row[first]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begin = (np.cumsum(counts) - counts)[short]
        grams = np.concatenate([grams, tx.Rolling(words, 0xD6E8FEB86659FD93).spans(begin, begin + counts[short])])
        rows = np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _profiles(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """Set size and 128-bit digest of every row, and counts of shingles repeated within windows of rows."""

    def run(batches):
        held, n_held = [], 0

        def counted():
            grams, copies = np.unique(np.concatenate(held), return_counts=True)
            grams, copies = grams[copies > 1], copies[copies > 1]
            none = pa.nulls(len(grams), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(grams), kind), none, none, none, _signed(grams), pa.array(copies, pa.int64())], names=names)

        for batch in batches:
            n, one, two = [], [], []
            for row0, row1, data, offsets in tx.pieces(batch.column(1)):
                rows, grams = shingle_rows(data, offsets, size)
                held.append(grams)
                n_held += len(grams)
                n.append(np.bincount(rows, minlength=row1 - row0))
                for out, salt in ((one, 0x5851F42D4C957F2D), (two, 0x14057B7EF767814F)):
                    sums = np.zeros(row1 - row0, np.uint64)
                    begin = np.flatnonzero(np.diff(rows, prepend=-1))
                    if len(begin):
                        sums[rows[begin]] = np.add.reduceat(tx.mix(grams ^ np.uint64(salt)), begin)
                    out.append(sums)
                if n_held >= WINDOW:
                    yield counted()
                    held, n_held = [], 0
            if n:
                none = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n), pa.int64()), _signed(np.concatenate(one)), _signed(np.concatenate(two)), none, none], names=names)
        if held:
            yield counted()

    kind = _arrow(docs, doc_id)
    names = ["id", "n", "one", "two", "gram", "copies"]
    return docs.select(doc_id, text).mapInArrow(run, f"id {docs.schema[doc_id].dataType.simpleString()}, n long, one long, two long, gram long, copies long")


def _arrow(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _prefixes(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, common) -> DataFrame:
    """The first shingles of every row in the global order, with the row's digest."""

    def run(batches):
        for batch in batches:
            for row0, row1, data, offsets in tx.pieces(batch.column(1)):
                rows, grams = shingle_rows(data, offsets, size)
                late = sum(in_table(t, grams).view(np.int8) for t in common.value)
                n = np.bincount(rows, minlength=row1 - row0)
                begin = np.flatnonzero(np.diff(rows, prepend=-1))
                own = rows[begin]
                digests = [np.add.reduceat(tx.mix(grams ^ np.uint64(s)), begin) if len(begin) else np.zeros(0, np.uint64) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                order = np.lexsort((grams, late, rows))
                keep = np.arange(len(rows)) - np.repeat(begin, n[own]) < np.repeat(n[own] - (percent * n[own] + 99) // 100 + 1, n[own])
                first = grams[order][keep]
                sizes = np.bincount(rows[keep], minlength=row1 - row0)[own]
                cells = np.bincount(np.repeat(np.arange(len(own)), n[own]) * CELLS + (grams & np.uint64(CELLS - 1)).astype(np.int64), minlength=len(own) * CELLS)
                wide = np.repeat(n[own] > 0x7FFF, CELLS)  # counts that may not fit bound nothing
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * CELLS, pa.int32()), pa.array(np.where(wide, 0, cells), pa.int16()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _signed(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row0 + own)), pa.array(n[own], pa.int64()), *map(_signed, digests), lists, cells], names=["id", "n", "one", "two", "grams", "cells"])

    return docs.select(doc_id, text).mapInArrow(run, f"id {docs.schema[doc_id].dataType.simpleString()}, n long, one long, two long, grams array<long>, cells array<smallint>")


def _entries(classes: DataFrame, repeated) -> DataFrame:
    """Incidence entries (id, n, at, gram) of the columns that (may) have more than one row, those before it, and how many a row has."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            grams = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(in_table(repeated.value, grams.to_numpy().view(np.uint64)))
            of = pa.array(row[keep])
            counts = np.bincount(row[keep], minlength=len(sizes))
            central = counts[row[keep]]
            n_before = np.minimum(np.arange(len(keep)) - (np.cumsum(counts) - counts)[row[keep]], BEFORE)
            ends = np.cumsum(n_before)
            earlier = np.arange(n_before.sum()) + np.repeat(np.arange(len(keep)) - ends, n_before)
            before = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), grams.take(pa.array(keep[earlier])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(at[keep], pa.int32()), grams.take(pa.array(keep)), pa.array(central, pa.int32()), before], names=["id", "n", "at", "gram", "central", "before"])

    return classes.select("id", "n", "grams").mapInArrow(run, f"id {classes.schema['id'].dataType.simpleString()}, n long, at int, gram long, central int, before array<long>")


def _sets(docs: DataFrame, doc_id: str, text: str, size: int, wanted) -> DataFrame:
    """Whole shingle sets, in ``PARTS`` blocks of columns, of (at least) the documents in the table of wanted ids."""

    def run(batches):
        for batch in batches:
            take = in_table(wanted.value, batch.column(2).to_numpy().view(np.uint64))
            part = batch.filter(pa.array(take))
            for row0, row1, data, offsets in tx.pieces(part.column(1)):
                rows, grams = shingle_rows(data, offsets, size)
                block = rows * PARTS + (grams & np.uint64(PARTS - 1)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                n = row1 - row0
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(block, minlength=n * PARTS))]), pa.int32()), _signed(grams[order]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * PARTS, pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(row0, n), lists], names=["id", "grams"])

    front = docs.where(F.col(doc_id).isNotNull()).select(doc_id, text, F.xxhash64(doc_id).alias("h"))
    return front.mapInArrow(run, f"id {docs.schema[doc_id].dataType.simpleString()}, grams array<array<long>>")


def _heavy(pairs: DataFrame) -> DataFrame | None:
    """(heavy_id, shares) of the ids with more than a hundredth of all pairs: two hundred at most; None if there are none."""
    total = pairs.count()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("heavy_id")).groupBy("heavy_id").agg(F.count("*").alias("n"))
    some = ends.where(F.col("n") > max(total // 100, 16)).select("heavy_id", F.ceil(F.col("n") / max(total // 200, 8)).cast("int").alias("shares"))
    rows = some.collect()  # two hundred at most
    return pairs.sparkSession.createDataFrame(rows, some.schema) if rows else None


def _met(pairs: DataFrame, rows: DataFrame, end: str, heavy: DataFrame | None) -> DataFrame:
    """``pairs`` joined with the ``rows`` (by id) of one of their ends; an id of very many pairs is met by several tasks."""
    rows = rows.withColumnRenamed("id", end)
    if heavy is None:
        return pairs.join(rows, end)
    other = "b" if end == "a" else "a"
    some = F.broadcast(heavy.withColumnRenamed("heavy_id", end))  # two hundred rows at most
    dealt = pairs.join(some, end, "left").withColumn("share", F.pmod(F.xxhash64(other), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    many = rows.join(some, end, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return dealt.join(many, [end, "share"]).drop("share")


def _verified(pairs: DataFrame, cells: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """The stored ``pairs`` (a, b) whose sets are similar enough, by full overlap counts.

    Overlaps are first bounded cell by cell: what two sets share in one of the CELLS
    blocks of columns is at most the smaller of their counts there.  Pairs whose bounds
    add up to too little are discarded before any set is fetched.  For the others the
    overlap is accumulated over PARTS blocks; ``most`` is what is counted so far plus
    the bounds of the blocks to come, and the overlap itself in the end.
    """
    spark = docs.sparkSession
    heavy = _heavy(pairs)
    left = _met(pairs, cells.select("id", F.col("n").alias("p"), F.col("cells").alias("x")), "a", heavy)
    bounded = _met(left, cells.select("id", F.col("n").alias("q"), F.col("cells").alias("y")), "b", heavy)
    most = F.aggregate(F.zip_with("x", "y", lambda u, v: F.least(u, v).cast("int")), F.lit(0), lambda t, u: t + u)
    most = F.when(F.greatest("p", "q") > 0x7FFF, F.least("p", "q")).otherwise(most)
    enough = lambda m: 100 * m >= percent * (F.col("p") + F.col("q") - m)
    pairs = stored(bounded.where(enough(most)).select("a", "b", "p", "q"), "bounded")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.xxhash64("id").alias("h"))
    wanted = spark.sparkContext.broadcast(bit_table(ends, "h", COMMON_BITS))
    sets = stored(_sets(docs, doc_id, text, size, wanted), "sets")
    heavy = _heavy(pairs)
    left = _met(pairs, sets.select("id", F.col("grams").alias("x")), "a", heavy)
    both = _met(left, sets.select("id", F.col("grams").alias("y")), "b", heavy)
    both = both.select("a", "b", "p", "q", F.zip_with("x", "y", lambda u, v: F.struct(u.alias("u"), v.alias("v"))).alias("blocks"))
    bound = F.aggregate("blocks", F.lit(0).cast("long"), lambda t, z: t + F.least(F.size(z["u"]), F.size(z["v"])))
    add = lambda m, z: F.when(enough(m), m - F.least(F.size(z["u"]), F.size(z["v"])) + F.size(F.array_intersect(z["u"], z["v"]))).otherwise(m)
    links = stored(both.where(enough(F.aggregate("blocks", bound, add))).select("a", "b").distinct(), "verified")
    discard(sets, pairs)
    return links


@contextmanager
def _few_texts_at_a_time(spark):
    """Python workers get ``TEXTS`` rows at a time in the steps that are stored here; the session gets its own number back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(TEXTS, int(before)) if int(before) > 0 else TEXTS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row; see ``_components_of`` for options."""
    with _few_texts_at_a_time(docs.sparkSession):
        return _components_of(docs, **options)


def _components_of(docs: DataFrame, *, doc_id="doc_id", text="text", size=5, percent=80, common=32) -> DataFrame:
    """All steps that read texts are stored before this returns."""
    spark = docs.sparkSession
    profile = stored(_profiles(docs, doc_id, text, size), "profiles")
    sizes = sorted({common, *(c for c in COMMON if c > common)})
    often = profile.where("gram is not null").groupBy("gram").agg(F.sum("copies").alias("copies")).where(F.col("copies") >= common)
    bit = F.expr("shiftleft(1L, cast(gram & 63 as int))")
    words = often.groupBy(F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << COMMON_BITS) - 1)), 6).alias("word")).agg(*(F.coalesce(F.bit_or(F.when(F.col("copies") >= c, bit)), F.lit(0).cast("long")).alias(f"from_{c}") for c in sizes))
    late = spark.sparkContext.broadcast(bit_tables(words, [f"from_{c}" for c in sizes], COMMON_BITS))

    # one row of the matrix per distinct set; the smallest id stands for it
    rows = _prefixes(docs.where(F.col(doc_id).isNotNull()), doc_id, text, size, percent, late)
    classes = stored(rows.groupBy("one", "two", "n").agg(F.min(F.struct("id", "grams", "cells")).alias("r")).select("one", "two", "n", "r.id", "r.grams", "r.cells"), "classes")
    cells = classes.select("id", "n", "cells")

    repeated = classes.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1")
    entries = _entries(classes, spark.sparkContext.broadcast(bit_table(repeated, "gram", COLUMN_BITS)))
    blocks = entries.groupBy("gram").agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max(F.struct("central", "n", "id")).alias("best"), F.max(F.struct(F.xxhash64("id", "gram").alias("h"), "n", "id")).alias("other")).where("rows > 1")
    entries = stored(entries.join(blocks.drop("rows"), "gram"), "entries")  # blocks of one row yield no pair

    # hubs, the row that shares most columns and any other: linear in the entries; what they join needs no further look
    hub = entries.select("id", "n", F.explode(F.array(F.struct("best.n", "best.id"), F.struct("other.n", "other.id"))).alias("hub"))
    sized = f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n) and hub.id <> id"
    star = hub.where(sized).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
    star = stored(star.groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared > 1").drop("shared"), "stars")
    links = _verified(star, cells, docs, doc_id, text, size, percent)
    joined = components(links)

    # the product between different groups; entries too far back for any partner in their block are left out
    overlap = lambda p, q: f"(({percent} * ({p} + {q}) + {99 + percent}) div {100 + percent})"
    least = f"greatest(low, ({percent} * n + 99) div 100)"
    viable = entries.where(f"n - at >= {overlap('n', 'n')} or n - at >= {overlap(least, 'n')}")
    bounds = (
        f"x.part <> y.part and (x.n < y.n or x.n = y.n and x.id < y.id) and 100 * x.n >= {percent} * y.n "
        f"and x.n - x.at >= {overlap('x.n', 'x.n')} and least(x.n - x.at, y.n - y.at) >= {overlap('x.n', 'y.n')} "
        "and not arrays_overlap(x.before, y.before)"  # both rows are in that earlier block too, at earlier places
    )

    def mixed(rows, parts):
        """Entries with the group of their row, of the blocks that have several groups."""
        grouped = rows.select("gram", "id", "n", "at", "before").join(parts, "id", "left").select("gram", "id", "n", "at", "before", F.coalesce("label", "id").alias("part"))
        several = grouped.groupBy("gram").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("shares")).where("p <> q").select("gram", "shares")
        return stored(grouped.join(several, "gram"), "blocks")

    def product(blocks):
        # the rows of a large block are dealt over several tasks, each of which meets all of the block
        x = blocks.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).alias("x")
        y = blocks.withColumn("share", F.explode(F.expr("sequence(0, shares - 1)"))).alias("y")
        pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.share") == F.col("y.share")) & F.expr(bounds)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        return stored(pairs.distinct(), "pairs")

    # first one row of every group in a block, which joins most groups that belong together; then all rows of those still apart
    blocks = mixed(viable, joined)
    heads = blocks.groupBy("gram", "part", "shares").agg(F.min(F.struct("at", "n", "id", "before")).alias("r")).select("gram", "part", "shares", "r.*")
    links = stored(links.unionByName(_verified(product(heads), cells, docs, doc_id, text, size, percent)), "links")
    pairs = product(mixed(blocks, components(links)))
    labels = components(links.unionByName(_verified(pairs, cells, docs, doc_id, text, size, percent)))

    named = classes.join(labels, "id", "left").select("one", "two", "n", F.coalesce("label", "id").alias("component_id"))
    known = profile.where("gram is null").select("id", "n", "one", "two")
    some = known.where("n > 0").join(named, ["one", "two", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    none = known.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def one_per_component(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """One row of each group of linked documents, all columns kept: that of the smallest integer id.

    Rows that repeat an id or have none are judged by their own text; of those with one
    id and one text one stays, and in a group the others come after all rows that have an
    id of their own.
    """
    key, mark, own_id = (_fresh(docs, name) for name in ("row_key", "key_hash", "own_id"))
    own = F.col(f"`{doc_id}`").cast("long")
    repeated = stored(docs.groupBy(own.alias("id")).count().where("`count` > 1 or id is null").select("id"), "repeated-ids")
    if repeated.isEmpty():
        keyed = docs.withColumn(key, own)
    else:
        # keys beyond all usual ids
        made = F.lit(1 << 62) + F.xxhash64(own, F.col(f"`{text}`")).bitwiseAND(F.lit((1 << 61) - 1))
        joined = docs.withColumn(key, own).join(repeated.withColumnRenamed("id", mark), F.col(key).eqNullSafe(F.col(mark)), "left")
        plain = joined.where(F.col(key).isNotNull() & F.col(mark).isNull()).drop(mark)
        others = joined.where(F.col(key).isNull() | F.col(mark).isNotNull()).drop(mark).withColumn(mark, made).dropDuplicates([mark])
        # the row that keeps the id
        owners = others.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(mark).alias(mark)).withColumn(own_id, F.col(key))
        others = others.join(owners.drop(key), mark, "left").withColumn(key, F.coalesce(own_id, mark)).drop(mark, own_id)
        keyed = stored(plain.unionByName(others), "keyed")
    found = jaccard_components(keyed, doc_id=key, text=text, **options)
    gone = stored(found.where(F.col(key) != F.col("component_id")).select(key), "gone")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(gone.select(F.xxhash64(key).alias("h")), "h", COMMON_BITS))

    @F.arrow_udf("boolean")
    def may_go(h: pa.Array) -> pa.Array:
        return pa.array(in_table(table.value, h.to_numpy().view(np.uint64)))

    marked = keyed.withColumn(mark, may_go(F.xxhash64(key)))  # texts stay where they are
    stay, doubtful = marked.where(~F.col(mark)).drop(mark), marked.where(mark).drop(mark)
    # only rows whose key may be gone travel to the join
    return stay.unionByName(doubtful.join(gone, key, "left_anti")).select(*(f"`{c}`" for c in docs.columns))


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    used = {c.lower() for c in df.columns}
    while name in used:
        name += "_"
    return name
