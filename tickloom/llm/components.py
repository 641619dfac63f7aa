"""Connected components of an edge list, as joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: A key with more than this share of all rows is looked up by broadcast, as there are at most as many of them.
HEAVY_SHARE = 100


def _heavy_keys(rows: DataFrame, key: str, total: int) -> list:
    """The keys of more than a hundredth of all rows: under a hundred."""
    counts = rows.groupBy(key).count().where(F.col("count") > max(total // HEAVY_SHARE, 16))
    return [r[0] for r in counts.select(key).collect()]


def _looked_up(rows: DataFrame, key: str, table: DataFrame, heavy: list) -> DataFrame:
    """``rows`` joined with ``table`` by ``key``; rows of heavy keys stay where they are and get a broadcast row."""
    if not heavy:
        return rows.join(table, key)
    is_heavy = F.col(key).isin(heavy)
    return rows.where(~is_heavy).join(table.where(~is_heavy), key).unionByName(rows.where(is_heavy).join(F.broadcast(table.where(is_heavy)), key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every id in ``edges``; label is the smallest id reachable.

    Labels take the smallest label among their neighbours, then the label of their
    label, until nothing changes; long paths halve with every round.  Hubs with very many
    neighbours and labels of very large components are looked up by broadcast, so no task
    gets all their rows.  Null ends are ignored, loops and repeated edges harmless, no edges
    give no rows.
    """
    e = edges.select(F.col(a).alias("id"), F.col(b).alias("other")).where("id is not null and other is not null")
    both = stored(e.unionByName(e.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "edges")
    total = both.count()
    hubs = _heavy_keys(both, "other", total)
    labels = stored(both.groupBy("id").agg(F.min("other").alias("near")).select("id", F.least("id", "near").alias("label")), "labels")
    n = labels.count()
    while True:
        seen = _looked_up(both, "other", labels.select(F.col("id").alias("other"), "label"), hubs).groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(seen, "id").select("id", F.least("label", "near").alias("next"), "label")
        step = stored(step, "steps")
        if step.where("label <> next").isEmpty():
            return labels
        # what the few ids that are labels have themselves as a label
        roots = step.select("next").distinct().join(step.select(F.col("id").alias("next"), F.col("next").alias("far")), "next")
        labels = stored(_looked_up(step.select("id", "next"), "next", roots, _heavy_keys(step, "next", n)).select("id", F.least("next", "far").alias("label")), "labels")
