"""As-of join: every row of one table with the last (next, nearest) row of another by time, key by key.

Both tables are unioned and a row's partner is carried along the time order within
(key, time bucket).  What stands before a bucket is carried over the buckets, one row for
each, and joined back by (key, bucket), which is how the rows are dealt already.  So a hot
key is many tasks and nothing is joined pair by pair.  Buckets hold about ``bucket_rows``
rows of the whole input: their edges come from counts in ``CELLS`` equal cells of the time
range, the only thing that is broadcast.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

col = F.col
#: Equal cells of the time range whose counts set the buckets.
CELLS = 4096


def as_number(df: DataFrame, name: str) -> Column:
    """Times in microseconds, dates in days, numbers as they are."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(col(f"`{name}`").cast("timestamp"))
    return F.unix_date(col(f"`{name}`")) if kind == "date" else col(f"`{name}`")


def _bucketed(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """``rows`` with the bucket of their time ``at``."""
    low, high, n = rows.agg(F.min("at"), F.max("at"), F.count("*")).first()
    if n <= bucket_rows or low is None or low == high:
        return rows.withColumn("bucket", F.lit(0).cast("long"))
    cell = F.least(F.floor((col("at") - low) / ((high - low) / CELLS)), F.lit(CELLS - 1)).cast("int")
    counts = dict(rows.select(cell.alias("cell")).where("cell is not null").groupBy("cell").count().collect())
    before = [0, *itertools.accumulate(counts.get(i, 0) for i in range(CELLS))]
    buckets = rows.sparkSession.createDataFrame([(i, before[i] // bucket_rows) for i in range(CELLS)], "cell int, bucket long")
    return rows.withColumn("cell", cell).join(F.broadcast(buckets), "cell", "left").drop("cell")


def asof_join(
    left: DataFrame, right: DataFrame, *, by: list[str], left_on: str, right_on: str, columns: list[str], direction: str = "backward",
    tolerance: float | None = None, exact: bool = True, tie: str | None = None, bucket_rows: int = 1_000_000,
) -> DataFrame:
    """``left`` with ``right_on`` and ``columns`` of its partner in ``right``; null where there is none.

    ``direction``: backward takes the last row at or before, forward the first at or after,
    nearest the closer of both (the earlier one if they are as close).  ``exact``: whether an
    equal time counts.  ``tolerance``: the largest distance, in microseconds of times, days of
    dates, units of numbers.  Of right rows with one time the last by ``tie`` counts (forward:
    the first).  The names of right columns must not be names of ``left``.  Null keys and
    null times find nothing; left rows are kept as often as they occur.
    """
    names = [right_on, *columns]
    if direction == "nearest":
        return _nearest(left, right, names, by=by, left_on=left_on, tolerance=tolerance, exact=exact, tie=tie, bucket_rows=bucket_rows)
    sign = -1 if direction == "forward" else 1
    keys = [f"k{i}" for i in range(len(by))]
    named = [col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    rights = right.where(" and ".join(f"`{c}` is not null" for c in [*by, right_on]))
    # the order within a time: partners first if an equal time counts
    r = rights.select(*named, (sign * as_number(right, right_on)).alias("at"), F.lit(0 if exact else 1).alias("side"), (col(f"`{tie}`") if tie else F.lit(0)).alias("tie"), F.struct(*(col(f"`{c}`") for c in names)).alias("r"))
    l = left.select(*named, (sign * as_number(left, left_on)).alias("at"), F.lit(1 if exact else 0).alias("side"), F.struct("*").alias("l"))
    both = _bucketed(l.unionByName(r, allowMissingColumns=True), bucket_rows)
    ahead = Window.partitionBy(*keys, "bucket").orderBy("at", "side", F.asc("tie") if sign > 0 else F.desc("tie"))
    carried = both.withColumns({"own": F.last("r", True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(ahead)})
    over_buckets = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = carried.groupBy(*keys, "bucket").agg(F.max_by("own", "place").alias("end"))
    before = ends.select(*keys, "bucket", F.last("end", True).over(over_buckets).alias("before")).where("before is not null")
    out = carried.where("l is not null").join(before, [*keys, "bucket"], "left").select("l", F.when(col("at").isNotNull(), F.coalesce("own", "before")).alias("r"))
    out = out.select("l.*", *(col("r")[c].alias(c) for c in names))
    if tolerance is not None:
        near = F.coalesce(F.abs(as_number(out, left_on) - as_number(out, right_on)) <= tolerance, F.lit(False))
        out = out.select(*left.columns, *(F.when(near, col(f"`{c}`")).alias(c) for c in names))
    return out


def _nearest(left: DataFrame, right: DataFrame, names: list[str], *, by, left_on, tie, **options) -> DataFrame:
    """The closer of the partners of both directions."""
    out = left
    for side, way in (("b", "backward"), ("f", "forward")):
        other = right.select(*by, *(col(f"`{c}`").alias(f"asof_{side}_{c}") for c in names), *([col(f"`{tie}`").alias("asof_tie")] if tie else []))
        first, *rest = (f"asof_{side}_{c}" for c in names)
        out = asof_join(out, other, by=by, left_on=left_on, right_on=first, columns=rest, direction=way, tie="asof_tie" if tie else None, **options)
    back, ahead = (F.abs(as_number(out, left_on) - as_number(out, f"asof_{side}_{names[0]}")) for side in ("b", "f"))
    earlier = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    return out.select(*left.columns, *(F.when(earlier, col(f"`asof_b_{c}`")).otherwise(col(f"`asof_f_{c}`")).alias(c) for c in names))
