"""Snapshot files as a checkpointed source: every file is read once, over any number of runs.

Spark's file stream keeps the offsets: a run takes the files that came since the last one with
the same checkpoint, adds their rows to the sink and ends; after a failure the next run
resumes where the last committed batch ended.  Readers take the newest row of a key while it is
younger than its time to live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def refresh(spark: SparkSession, folder: str, sink: str, checkpoint: str, schema: T.StructType | str, *, fmt: str = "csv", files_at_once: int = 1000, **options) -> None:
    """Add the rows of all new files below ``folder`` to the Parquet ``sink``, with the file they come from."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_at_once)
    for name, value in (({"header": True} if fmt == "csv" else {}) | options).items():
        reader = reader.option(name, value)
    rows = reader.load(folder).withColumn("snapshot", F.element_at(F.split(F.input_file_name(), "/"), -1))
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def newest(rows: DataFrame, key: str = "ticker", ts: str = "ts", *, at=None, seconds: int | None = None) -> DataFrame:
    """The newest row of every key at a time (by default of all), if it is at most ``seconds`` old then."""
    known = rows if at is None else rows.where(F.col(ts) <= F.lit(at).cast("timestamp"))
    best = known.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), ts).alias("r")).select(key, "r.*")
    if seconds is None:
        return best
    now = F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()
    return best.where(F.unix_micros(now) - F.unix_micros(ts) <= seconds * 1_000_000)
