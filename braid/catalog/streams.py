"""Streaming queries: the events as a change stream, merged and scored batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from braid.catalog.base import query, with_ctes
from braid.catalog.payment_frames import SCORED_CTES, accounts, payments
from braid.operators import changes as C
from braid.plans import payments as P
from braid.session import read_table, run_dir, settle, table_version
from braid.streaming import changefeed as S

COLUMNS = (
    "txn_id BIGINT, account_id BIGINT, initiated_at TIMESTAMP, amount DECIMAL(12,2), mcc STRING, device_id BIGINT, country BIGINT, "
    "merchant STRING, reference_id STRING, status STRING"
)


def _records(spark, sf):
    """Payments as change records. Sign-ups arrive, are corrected and deleted again; every record carries its offset."""
    base = payments(spark, sf).withColumn("kafka_ts", F.col("initiated_at")).withColumn(C.PARTITION, (F.col("account_id") % 4).cast("int"))
    insert = base.select("*", F.lit("c").alias(C.OP), F.lit("false").alias(C.DELETED), (F.col("txn_id") * 3).alias(C.OFFSET))
    gone = base.filter("reference_id LIKE 'SIGNUP-%'")
    wrong = gone.withColumn("amount", F.col("amount") + 1).select(
        "*", F.lit("u").alias(C.OP), F.lit("false").alias(C.DELETED), (F.col("txn_id") * 3 + 1).alias(C.OFFSET)
    )
    delete = gone.select("*", F.lit("d").alias(C.OP), F.lit("true").alias(C.DELETED), (F.col("txn_id") * 3 + 2).alias(C.OFFSET))
    return insert.unionByName(wrong).unionByName(delete)


# Files that each partition of the topic is written to.
SLICES = 16


def _written(records, path):
    """Files by partition of the topic: records of one key lie in one file and arrive in any order."""
    records.repartition(4 * SLICES, C.PARTITION, F.pmod(F.xxhash64("txn_id"), F.lit(SLICES))).write.json(path, compression="gzip")


_DONE: dict[tuple[str, str], tuple[str, S.Topic]] = {}


def streamed(spark, sf):
    """(root, topic) after the whole stream has run, anew when its tables have changed."""
    name = (spark.sparkContext.applicationId, table_version(spark, sf, "events", "customer"))
    if name not in _DONE:
        root = run_dir(spark, "stream")
        _written(_records(spark, sf), f"{root}/topic")
        # Half of the files at once, of any partition.
        topic = S.Topic("payments", "txn_id", COLUMNS, path=f"{root}/topic", options={"maxFilesPerTrigger": str(2 * SLICES)})
        S.run_payments(spark, root, topic, accounts(spark, sf), P.DEMO_MODEL)
        _DONE[name] = (root, topic)
    return _DONE[name]


# The same result in one batch: payments without the deleted ones.
_KEPT = [SCORED_CTES[0].replace("FROM events)", "FROM events WHERE event_type <> 'signup')"), *SCORED_CTES[1:]]


@query(
    "stream_velocity",
    with_ctes(*_KEPT) + "SELECT txn_id, account_id, txn_count_1h, txn_count_24h, amount_sum_24h, is_new_device_30d, fraud_score, decision FROM scored",
)
def stream_velocity(spark, sf):
    root, topic = streamed(spark, sf)
    return S.scores(spark, root, topic).select(
        "txn_id", "account_id", "txn_count_1h", "txn_count_24h", F.col("amount_sum_24h").cast("double").alias("amount_sum_24h"),
        "is_new_device_30d", "fraud_score", "decision",
    )


@query(
    "stream_state",
    with_ctes(_KEPT[0]) + "SELECT txn_id, account_id, CAST(amount AS DOUBLE) AS amount, merchant FROM payments",
)
def stream_state(spark, sf):
    root, topic = streamed(spark, sf)
    return S.current(spark, root, topic).select("txn_id", "account_id", F.col("amount").cast("double").alias("amount"), "merchant")


@query(
    "stream_stage",
    """SELECT CAST(user_id % 4 AS INTEGER) AS kafka_partition, min(event_id * 3) AS low, max(event_id * 3 + CASE WHEN event_type = 'signup' THEN 2 ELSE 0 END) AS high,
              CAST(sum(CASE WHEN event_type = 'signup' THEN 3 ELSE 1 END) AS BIGINT) AS messages FROM events GROUP BY 1""",
)
def stream_stage(spark, sf):
    root, topic = streamed(spark, sf)
    return C.offset_stats(S.staged(spark, root, topic))


_RESET = [SCORED_CTES[0].replace("FROM events)", "FROM events WHERE event_type NOT IN ('signup', 'error'))"), *SCORED_CTES[1:]]


@query(
    "reset_rederived",
    with_ctes(*_RESET)
    + """SELECT txn_id, account_id, txn_count_24h, amount_sum_24h, is_new_device_30d, is_new_country_30d, fraud_score, decision,
         decision <> 'APPROVE' AS has_alert, account_id IS NOT NULL AS in_audit FROM scored""",
)
def reset_rederived(spark, sf):
    """The stream without the payments that a reset took back: features, scores, alerts and the audit trail."""
    root = run_dir(spark, "reset")
    rows = _records(spark, sf)
    topic = S.Topic("payments", "txn_id", COLUMNS, path=f"{root}/topic")
    _written(rows, topic.path)
    S.run_payments(spark, root, topic, accounts(spark, sf), P.DEMO_MODEL)
    S.scores(spark, root, topic).select("txn_id", F.lit("scored").alias("action")).write.parquet(f"{root}/audit")
    S.reset(spark, root, topic, "reference_id", "ERROR-", accounts(spark, sf), P.DEMO_MODEL)
    scored = S.scores(spark, root, topic)
    layers = C.prune_layers(S.current(spark, root, topic), {"audit": spark.read.parquet(f"{root}/audit")}, "txn_id")
    alerted = S.alerts(spark, root, topic).select("txn_id", F.lit(True).alias("has_alert"))
    trail = layers["audit"].select("txn_id", F.lit(True).alias("in_audit"))
    told = scored.join(alerted, "txn_id", "left").join(trail, "txn_id", "full")
    return told.select(
        "txn_id", "account_id", "txn_count_24h", F.col("amount_sum_24h").cast("double").alias("amount_sum_24h"), "is_new_device_30d", "is_new_country_30d",
        "fraud_score", "decision", F.coalesce("has_alert", F.lit(False)).alias("has_alert"), F.coalesce("in_audit", F.lit(False)).alias("in_audit"),
    )


@query(
    "synced_topics",
    """SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS orders, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total
       FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def synced_topics(spark, sf):
    """Customers and orders as two topics, joined as of one cut, while later orders arrive and a batch is replayed."""
    root = run_dir(spark, "synced")

    def records(rows, key):
        return rows.select(
            "*", F.lit("c").alias(C.OP), F.lit("false").alias(C.DELETED), F.lit("2024-01-01T00:00:00Z").alias("kafka_ts"),
            F.pmod(F.col(key), F.lit(4)).cast("int").alias(C.PARTITION), F.col(key).cast("long").alias(C.OFFSET),
        )

    orders = records(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderstatus"), "o_orderkey")
    people = records(read_table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    topics = [
        S.Topic("orders", "o_orderkey", "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DECIMAL(18,2), o_orderstatus STRING", path=f"{root}/orders", buckets=8),
        S.Topic("customer", "c_custkey", "c_custkey BIGINT", path=f"{root}/customer", buckets=8),
    ]
    S.produce(orders.filter("o_orderstatus <> 'P'"), topics[0])
    S.produce(people, topics[1])
    S.sync(spark, root, topics)
    number = S.cut(spark, root, topics)
    S.produce(orders.filter("o_orderstatus = 'P'"), topics[0])
    S.run_merge(spark, root, topics[0])
    replayed = settle(S.staged(spark, root, topics[0]).drop("staged_at").filter("o_orderstatus = 'P'"), "replayed")
    S.merge_batch(root, topics[0], replayed, S.reached(spark, root, topics[0]))
    tables = S.at_cut(spark, root, topics, number)
    bought = tables["orders"].select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    joined = tables["customer"].select("c_custkey").join(bought, "c_custkey", "left")
    total = F.coalesce(F.sum("o_totalprice"), F.lit(0)).cast("double")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), total.alias("total"))
