"""Change-record queries: latest state, deletes, orphans, offsets, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from braid.catalog.base import query, with_ctes
from braid.operators import changes as C
from braid.operators.ranking import first_by_key, latest_by_key
from braid.session import read_table

KEY = "txn_id"


def stage(spark, sf):
    """Events as change records of one key per user: an error deletes, a signup inserts, the rest updates."""
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c").otherwise("u")
    return read_table(spark, sf, "events").select(
        F.col("user_id").alias(KEY),
        F.col("value").alias("amount"),
        F.col("event_type").alias("channel"),
        op.alias(C.OP),
        F.when(op == "d", "true").otherwise("false").alias(C.DELETED),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("kafka_ts"),
        (F.col("user_id") % 4).cast("int").alias(C.PARTITION),
        F.col("event_id").alias(C.OFFSET),
    )


_STAGE = """stage AS (SELECT user_id AS txn_id, value AS amount, event_type AS channel, CASE event_type WHEN 'error' THEN 'd' WHEN 'signup' THEN 'c' ELSE 'u' END AS op,
  epoch_us(ts) AS kafka_ts, CAST(user_id % 4 AS INTEGER) AS kafka_partition, event_id AS kafka_offset FROM events)"""
_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY kafka_offset DESC) AS rn FROM stage) WHERE rn = 1)"


@query("latest_by_key", with_ctes(_STAGE, _LAST) + "SELECT txn_id, amount, channel, kafka_offset FROM last")
def latest(spark, sf):
    return latest_by_key(stage(spark, sf), [KEY], [C.OFFSET]).select(KEY, "amount", "channel", C.OFFSET)


@query(
    "first_by_key",
    "SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents) WHERE rn = 1",
)
def first(spark, sf):
    docs = read_table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    return first_by_key(docs, ["source"], ["n_chars", "doc_id"]).select("source", "doc_id", "lang")


@query("apply_changes", with_ctes(_STAGE, _LAST) + "SELECT txn_id, amount, channel, kafka_offset FROM last WHERE op <> 'd'")
def apply_changes(spark, sf):
    """Half the stream applied, then all of it: the overlap is a replay and alters nothing."""
    rows = stage(spark, sf)
    half = rows.agg(F.avg(C.OFFSET)).scalar()
    state = C.apply_changes(None, rows.filter(F.col(C.OFFSET) <= half), [KEY], [C.OFFSET])
    return C.apply_changes(state, rows, [KEY], [C.OFFSET]).select(KEY, "amount", "channel", C.OFFSET)


@query(
    "prune_orphans",
    """SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
)
def prune_orphans(spark, sf):
    parents = read_table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return C.prune_layers(parents, {"lines": lines}, "l_orderkey")["lines"]


@query(
    "orphans",
    "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
)
def orphans(spark, sf):
    parents = read_table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.orphans(read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), parents, "l_orderkey")


@query(
    "reset_by_prefix",
    with_ctes(_STAGE, _LAST) + "SELECT txn_id, amount, channel FROM last WHERE op <> 'd' AND channel NOT LIKE 'sign%'",
)
def reset_by_prefix(spark, sf):
    """Delete records for every current row whose channel starts with a prefix, merged into the state."""
    rows = stage(spark, sf)
    state = C.apply_changes(None, rows, [KEY], [C.OFFSET])
    cut = C.tombstones(state, "channel", "sign").withColumn(C.OFFSET, F.col(C.OFFSET) + 1)
    return C.apply_changes(state, cut, [KEY], [C.OFFSET]).select(KEY, "amount", "channel")


@query(
    "offset_stats",
    with_ctes(_STAGE)
    + "SELECT kafka_partition, min(kafka_offset) AS low, max(kafka_offset) AS high, CAST(count(*) AS BIGINT) AS messages FROM stage GROUP BY 1",
)
def offset_stats(spark, sf):
    return C.offset_stats(stage(spark, sf))


@query(
    "topic_stats",
    with_ctes(_STAGE) + "SELECT CAST(count(*) AS BIGINT) AS messages, CAST(count(DISTINCT kafka_partition) AS BIGINT) AS partitions FROM stage",
)
def topic_stats(spark, sf):
    return C.topic_stats(stage(spark, sf))


@query(
    "past_stored_offsets",
    with_ctes(_STAGE, "held AS (SELECT kafka_partition, max(kafka_offset) AS m FROM stage WHERE channel = 'view' AND kafka_partition <> 3 GROUP BY 1)")
    + "SELECT s.kafka_partition, s.kafka_offset FROM stage s LEFT JOIN held h USING (kafka_partition) WHERE m IS NULL OR s.kafka_offset > m",
)
def past_stored_offsets(spark, sf):
    rows = stage(spark, sf)
    held = rows.filter((F.col("channel") == "view") & (F.col(C.PARTITION) != 3))
    return C.past_stored_offsets(rows, held).select(C.PARTITION, C.OFFSET)


@query(
    "topic_tail",
    with_ctes(_STAGE)
    + """SELECT txn_id, channel, kafka_partition, kafka_offset FROM (
           SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kafka_partition ORDER BY kafka_offset DESC) AS rn FROM stage) WHERE rn <= 6
           ORDER BY kafka_ts DESC, kafka_partition DESC, kafka_offset DESC LIMIT 6)""",
)
def topic_tail(spark, sf):
    return C.tail(stage(spark, sf), "kafka_ts", 6).select(KEY, "channel", C.PARTITION, C.OFFSET)


@query(
    "live_feed",
    """WITH feed AS (SELECT doc_id, turn, role, CASE WHEN role = 'assistant' AND length(text) < 60 THEN 'd' WHEN turn = 0 THEN 'c' ELSE 'u' END AS op
         FROM (SELECT conv_id AS doc_id, turn, role, text FROM conversations))
       SELECT doc_id, turn, CASE op WHEN 'c' THEN 'INSERT' ELSE 'UPDATE' END AS change FROM feed
       WHERE op <> 'd' AND doc_id NOT IN (SELECT doc_id FROM feed WHERE op = 'd') ORDER BY turn DESC, doc_id DESC LIMIT 50""",
)
def live_feed(spark, sf):
    """Conversations as a topic: a very short answer deletes its conversation."""
    op = F.when((F.col("role") == "assistant") & (F.length("text") < 60), "d").when(F.col("turn") == 0, "c").otherwise("u")
    feed = read_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", op.alias(C.OP), F.col("conv_id").alias(C.PARTITION), F.lit(0).alias(C.OFFSET)
    )
    return C.live_feed(feed, "doc_id", "turn", 50).select("doc_id", "turn", "change")
