"""Keyed change records: latest state, deletes, orphans, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.operators.ranking import latest_by_key, top_k_per_group
from braid.operators.rules import lookup

OP, DELETED = "__op", "__deleted"
PARTITION, OFFSET = "kafka_partition", "kafka_offset"

# Change codes and the names shown for them (fixed values).
OP_NAMES = {"c": "INSERT", "u": "UPDATE", "d": "DELETE", "r": "SNAPSHOT"}


def is_delete():
    return (F.col(OP) == "d") | (F.lower(F.coalesce(F.col(DELETED).cast("string"), F.lit("false"))) == "true")


def apply_changes(snapshot: DataFrame | None, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows after the changes; deleted keys vanish.

    The snapshot has the columns of the changes. A key's state is that of its
    greatest ``order``, so replaying changes already applied alters nothing.
    """
    both = changes if snapshot is None else snapshot.unionByName(changes)
    return latest_by_key(both, keys, order).filter(~is_delete())


def without_orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key still exists among the parents."""
    return rows.join(parents.select(key), key, "left_semi")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key no longer exists among the parents."""
    return rows.join(parents.select(key), key, "left_anti")


def prune_layers(parents: DataFrame, layers: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    return {name: without_orphans(rows, parents, key) for name, rows in layers.items()}


def tombstones(rows: DataFrame, prefix_column: str, prefix: str) -> DataFrame:
    """Delete records for every row whose reference starts with the prefix."""
    return rows.filter(F.col(prefix_column).startswith(prefix)).withColumn(OP, F.lit("d")).withColumn(DELETED, F.lit("true"))


def offset_stats(stage: DataFrame) -> DataFrame:
    """Per partition: lowest and highest offset and number of messages."""
    return stage.groupBy(PARTITION).agg(
        F.min(OFFSET).alias("low"), F.max(OFFSET).alias("high"), F.count(F.lit(1)).alias("messages")
    )


def topic_stats(stage: DataFrame) -> DataFrame:
    return stage.agg(F.count(F.lit(1)).alias("messages"), F.count_distinct(PARTITION).alias("partitions"))


def past_stored_offsets(incoming: DataFrame, stage: DataFrame) -> DataFrame:
    """Records after the greatest stored offset of their partition; all records of a new partition."""
    stored = stage.groupBy(PARTITION).agg(F.max(OFFSET).alias("_max"))
    return (
        incoming.join(stored, PARTITION, "left")
        .filter(F.col("_max").isNull() | (F.col(OFFSET) > F.col("_max")))
        .select(*incoming.columns)
    )


def tail(stage: DataFrame, ts: str, n: int) -> DataFrame:
    """The newest ``n`` records: the last ``n`` offsets of each partition, newest first by time."""
    last = top_k_per_group(stage, [PARTITION], [F.desc(OFFSET)], n, "_rn").drop("_rn")
    return last.orderBy(F.desc(ts), F.desc(PARTITION), F.desc(OFFSET)).limit(n)


def live_feed(events: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """Newest events without deletes and without anything a delete removed, with readable change names."""
    gone = events.filter(F.col(OP) == "d").select(key).distinct()
    kept = events.filter(F.col(OP) != "d").join(gone, key, "left_anti")
    return (
        kept.withColumn("change", F.coalesce(lookup(F.col(OP), OP_NAMES), F.col(OP)))
        .orderBy(F.desc(ts), F.desc(PARTITION), F.desc(OFFSET))
        .limit(n)
    )


def unmatched_facts(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts that an inner join with the dimension would drop silently."""
    return facts.join(dimension.select(key), key, "left_anti")
