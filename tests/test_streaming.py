import pandas as pd

from tickloom.streaming import ohlcv


def test_positions_keep_state_between_batches(spark, tmp_path):
    schema = "ticker string, ts timestamp, close double, vote int"
    for i, rows in enumerate([[("A", 1, 10.0, 1)], [("A", 2, 10.0, 0)], [("A", 3, 9.0, 0)]]):
        pdf = pd.DataFrame([(t, pd.Timestamp(2024, 1, d), c, v) for t, d, c, v in rows], columns=["ticker", "ts", "close", "vote"])
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = ohlcv.streaming_positions(stream).writeStream.format("memory").queryName("positions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.ts.day, r.action) for r in spark.table("positions").collect())
    assert got == [(1, "entry"), (3, "stop_loss")]
