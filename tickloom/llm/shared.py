"""Session helpers for multi-pass operators."""

from __future__ import annotations

import sys
import types
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder as shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = (weakref.ref(out), path)
    return out


_STORED: dict[int, tuple] = {}


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that came from them is stored itself."""
    for frame in frames:
        ref, path = _STORED.pop(id(frame), (lambda: None, None))
        if ref() is frame:
            jvm = frame.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def heavy_keys_aside(rows: DataFrame, key: str, having: Column, best: Column, total: int, facts: DataFrame | None = None) -> DataFrame:
    """``rows`` with an aggregate of all rows of their ``key``, null where ``having`` is false or the key has one row.

    Keys with more than a hundredth of all ``total`` rows are under a hundred, so they
    are broadcast and their rows dealt evenly; only the others meet by key.
    ``facts``: the rows to aggregate, if they are not ``rows`` themselves.
    """
    groups = (rows.where(having) if facts is None else facts).groupBy(key).agg(best, F.count("*").alias("copies")).where("copies > 1")
    name = next(c for c in groups.columns if c not in (key, "copies"))
    groups = stored(groups, "groups")
    heavy = groups.where(F.col("copies") > max(total // 100, 1)).select(key, F.col(name).alias("heavy_best"))
    rest = groups.where(F.col("copies") <= max(total // 100, 1)).select(F.col(key).alias("light_key"), F.col(name).alias("light_best"))
    out = rows.join(F.broadcast(heavy), key, "left")
    # rows that have nothing to look for are dealt evenly
    own = F.when(having & F.col("heavy_best").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string")))
    out = out.withColumn("light_key", own).join(rest.withColumn("light_key", F.col("light_key").cast("string")), "light_key", "left")
    return out.select(*rows.columns, F.when(having, F.coalesce("heavy_best", "light_best")).alias(name))


def worker_cache() -> dict:
    """A dictionary that lives as long as this Python process; Spark reuses its workers for many tasks."""
    name = "tickloom_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null keys have remainder 0 of an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sampled(df: DataFrame, key: str, most: int, total: int, salt: int = 7) -> DataFrame:
    """About ``most`` rows of ``total``, chosen by a hash of the key; ``limit`` bounds the surprise."""
    if total <= most:
        return df
    keep = int(most / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < keep).limit(2 * most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_tables(words: DataFrame, columns: list[str], size: int) -> list[np.ndarray]:
    """Tables of 2 ** ``size`` packed bits from rows (word, <column of 64 bits>...).

    Executors pack chunks of 32 KB, so the driver gets at most 2 ** (size - 18) rows
    and 2 ** (size - 3) bytes a column, whatever the input.
    """

    def pack(rows: pa.Table) -> pa.Table:
        word = rows.column("word").to_numpy()
        out = {"chunk": pa.array([int(word[0]) >> 12], pa.int64())}
        for c in columns:
            table = np.zeros(4096, np.int64)
            table[word & 4095] = rows.column(c).to_numpy()
            out[c] = pa.array([table.tobytes()], pa.binary())
        return pa.table(out)

    chunks = words.select("word", *columns).groupBy(F.shiftright("word", 12).alias("part")).applyInArrow(pack, "chunk long, " + ", ".join(f"{c} binary" for c in columns))
    tables = [np.zeros(1 << (size - 3), np.uint8) for _ in columns]
    for row in chunks.toLocalIterator():
        for table, c in zip(tables, columns, strict=True):
            table[row["chunk"] << 15 : (row["chunk"] + 1) << 15] = np.frombuffer(row[c], np.uint8)
    return tables


def bit_table(df: DataFrame, value: str, size: int = 24) -> np.ndarray:
    """A bit for the lower ``size`` bits (18 at least) of every 64-bit ``value``."""
    word = F.shiftright(F.col(value).bitwiseAND(F.lit((1 << size) - 1)), 6)
    words = df.select(word.alias("word"), F.expr(f"shiftleft(1L, cast({value} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return bit_tables(words, ["bits"], size)[0]


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values have their bit in a table of packed bits."""
    at = (values & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
