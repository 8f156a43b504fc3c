"""Change streams merged into keyed tables, with payment features kept current.

Layout under one root in the shared folder:

    stage/<topic>/batch=<n>     every record as it arrived, with partition, offset and broker time
    state/<table>               the latest record of every key, in buckets of the key
    accounts/<table>            current payments with features and scores, in buckets of the account
    cuts/<n>                    batches that several tables had reached at one moment

A batch reads and writes the buckets that its keys and their accounts fall into, nothing else, so that
its cost follows the batch and not the table. Every batch starts from what the batch before
it left, so that a replayed batch changes nothing. Deletes stay in the state as rows, so that an old record
that comes again cannot revive its key.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braid.operators import changes as C
from braid.operators.skew import HOT_KEY_ROWS
from braid.plans import payments as P
from braid.session import settle
from braid.sources import shared
from braid.sources.files import append_runs
from braid.streaming.buckets import Buckets, merge

ENVELOPE = f"{C.OP} STRING, {C.DELETED} STRING, kafka_ts TIMESTAMP, {C.PARTITION} INT, {C.OFFSET} BIGINT"


@dataclass(frozen=True)
class Topic:
    """A stream of change records for one table.

    ``options`` and ``format`` go to the stream reader, so a broker source can take
    the place of files; then ``decode`` turns its rows into the topic's columns.
    """

    table: str
    key: str
    columns: str
    path: str | None = None
    format: str = "json"
    options: dict[str, str] = field(default_factory=dict)
    decode: Callable[[DataFrame], DataFrame] | None = None
    buckets: int = 32

    @property
    def schema(self) -> str:
        return f"{self.columns}, {ENVELOPE}"


def source(spark: SparkSession, topic: Topic) -> DataFrame:
    reader = spark.readStream.format(topic.format).options(**topic.options)
    if topic.decode is None:
        reader = reader.schema(topic.schema)
    rows = reader.load(topic.path) if topic.path else reader.load()
    return topic.decode(rows) if topic.decode else rows


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def state_table(root: str, topic: Topic) -> Buckets:
    return Buckets(f"{root}/state/{topic.table}", topic.key, topic.buckets)


def account_table(root: str, topic: Topic) -> Buckets:
    return Buckets(f"{root}/accounts/{topic.table}", "account_id", topic.buckets)


def _live(rows: DataFrame) -> DataFrame:
    return rows.filter(~C.is_delete())


def current(spark: SparkSession, root: str, topic: Topic, cut: int | None = None) -> DataFrame:
    """The table's rows after every change seen so far; with ``cut`` after that batch."""
    rows = state_table(root, topic).read(spark, before=None if cut is None else cut + 1)
    if rows is None:
        raise ValueError(f"no change of {topic.table} has been merged yet")
    return _live(rows)


def staged(spark: SparkSession, root: str, topic: Topic) -> DataFrame:
    rows = _read(spark, f"{root}/stage/{topic.table}")
    if rows is None:
        raise ValueError(f"nothing of {topic.table} has been staged yet")
    return rows.drop("batch")


def merge_batch(root: str, topic: Topic, batch: DataFrame, batch_id: int) -> DataFrame:
    """Stage the batch as it is, merge it into the state and return its staged rows."""
    path = f"{root}/stage/{topic.table}/batch={batch_id}"
    batch.withColumn("staged_at", F.current_timestamp()).write.mode("overwrite").parquet(path)
    seen = batch.sparkSession.read.parquet(path).drop("staged_at")
    merge(state_table(root, topic), seen, batch_id, C.OFFSET)
    return seen


FEATURES = ("txn_count_1h", "txn_count_24h", "amount_sum_1h", "amount_sum_24h", "amount_vs_avg_ratio", "is_cross_border")
FEATURES += ("is_new_country_30d", "is_new_device_30d", "is_night_txn", "is_weekend_txn", "mcc_base_risk", "fraud_score", "decision")


def _moves(root: str, topic: Topic, keys: DataFrame, batch_id: int) -> DataFrame:
    """Rows of the changed keys before and after the batch, where the batch made a difference."""
    spark = keys.sparkSession
    table = state_table(root, topic)
    numbers = table.touched(keys)
    now = table.read(spark, numbers, before=batch_id + 1)
    held = table.read(spark, numbers, before=batch_id)
    if held is None:
        # The buckets hold nothing but the batch.
        return now.withColumn("_after", F.lit(True))
    after = now.join(keys, topic.key, "left_semi").withColumn("_after", F.lit(True))
    before = held.join(keys, topic.key, "left_semi").withColumn("_after", F.lit(False))
    both = before.unionByName(after)
    changed = both.groupBy(topic.key).agg(F.min(C.OFFSET).alias("_low"), F.max(C.OFFSET).alias("_high"), F.count("*").alias("_n"))
    changed = changed.filter((F.col("_n") == 1) | (F.col("_low") < F.col("_high"))).select(topic.key)
    return both.join(changed, topic.key, "left_semi")


def refresh_scores(spark: SparkSession, root: str, topic: Topic, keys: DataFrame, accounts: DataFrame, model: P.LinearModel, batch_id: int) -> list[str]:
    """Recompute features and scores of the accounts that changed, from the first changed payment on.

    ``keys`` are the keys of the batch. A payment's old place counts as changed where it moved or was
    deleted. Later payments are recomputed because their windows may hold the changed rows; a late
    record is therefore in place once its batch is done. Payments of accounts without a key or of
    unknown accounts have no score. Returns the folders that were read.
    """
    table = account_table(root, topic)
    moves = settle(_moves(root, topic, keys, batch_id), "moves")
    places = moves.filter("account_id IS NOT NULL")
    numbers = table.touched(places)
    if not numbers:
        # Heads of a batch without changes, so that a reader of this batch finds them.
        table.publish(spark, batch_id, [])
        return []
    since = places.groupBy("account_id").agg(F.min("initiated_at").alias("_since"))
    payments = [c for c in moves.columns if c != "_after"]
    new = _live(places.filter("_after")).select(*payments, *[F.lit(None).alias(name) for name in FEATURES])
    held = table.read(spark, numbers, before=batch_id)
    rows = new
    if held is not None:
        same = held.join(moves.select(topic.key).distinct(), topic.key, "left_anti")
        rows = same.unionByName(new.select(*[F.col(c).cast(same.schema[c].dataType) for c in same.columns]))
    rows = rows.join(since, "account_id", "left")
    again = F.col("initiated_at") >= F.col("_since")
    near = settle(rows.filter(F.col("initiated_at") >= F.col("_since") - F.expr("INTERVAL 30 DAY")).select(*payments, again.alias("_again")), "near")
    hot_rows = None if near.count() <= HOT_KEY_ROWS else HOT_KEY_ROWS
    found = P.score(P.features(near.drop("_again"), accounts, hot_rows=hot_rows), model).select(topic.key, *FEATURES)
    scored = near.filter("_again").drop("_again").join(found, topic.key, "left")
    kept = rows.filter(F.coalesce(~again, F.lit(True))).drop("_since")
    out = scored if held is None else scored.unionByName(kept.select(*scored.columns))
    table.write(out, batch_id, numbers)
    return table.paths(spark, numbers, before=batch_id)


def scores(spark: SparkSession, root: str, topic: Topic) -> DataFrame:
    """The newest score of every payment that still exists."""
    rows = account_table(root, topic).read(spark)
    if rows is None:
        raise ValueError("no payment has been scored yet")
    return rows.filter("fraud_score IS NOT NULL").select(
        "txn_id", "account_id", "initiated_at", F.col("amount").alias("amount_usd"), *FEATURES
    )


def run_merge(spark: SparkSession, root: str, topic: Topic, after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Merge everything available on the topic, then stop. Call again for what has arrived since.

    ``after`` gets the keys of each batch and its number.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        begin = time.time()
        seen = merge_batch(root, topic, batch, batch_id)
        merged = time.time()
        if after:
            after(seen.select(topic.key).distinct(), batch_id)
        done = time.time()
        _record(spark, root, topic, batch_id, {"raw": merged - begin, "features": done - merged})

    (
        source(spark, topic)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{root}/checkpoint/{topic.table}")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _record(spark: SparkSession, root: str, topic: Topic, batch_id: int, hops: dict[str, float]) -> None:
    """One run-log line per batch with the time of every hop."""
    ms = {k: round(v * 1000, 1) for k, v in hops.items()}
    row = [("event", f"{topic.table}/{batch_id}", round(sum(ms.values()), 1), ms["features"], ms)]
    runs = spark.createDataFrame(row, "kind STRING, label STRING, total_ms DOUBLE, analytics_ms DOUBLE, hops MAP<STRING, DOUBLE>")
    append_runs(runs, f"{root}/runs")


def run_payments(spark: SparkSession, root: str, topic: Topic, accounts: DataFrame, model: P.LinearModel) -> None:
    """The payment stream: stage, merge, refresh features and scores, batch by batch."""
    run_merge(spark, root, topic, lambda keys, batch_id: refresh_scores(spark, root, topic, keys, accounts, model, batch_id) and None)


def reached(spark: SparkSession, root: str, topic: Topic) -> int | None:
    """The newest batch merged into the topic's state."""
    known = state_table(root, topic).batches(spark)
    return known[-1] if known else None


def sync(spark: SparkSession, root: str, topics: list[Topic], passes: int = 1) -> dict[str, DataFrame]:
    """Bring every topic up to date, ``passes`` times, and return their tables as of one cut.

    The cut is written once all topics have been merged and names a batch for each, so that tables
    joined with each other show one moment while further batches are merged. A topic without
    changes has no place in it and no table.
    """
    for _ in range(passes):
        for topic in topics:
            run_merge(spark, root, topic)
    return at_cut(spark, root, topics, cut(spark, root, topics))


def cut(spark: SparkSession, root: str, topics: list[Topic]) -> int:
    """Fix the batches that the topics have reached; returns the cut's number."""
    number = len(shared.names(spark, f"{root}/cuts"))
    at = {t.table: batch for t in topics if (batch := reached(spark, root, t)) is not None}
    shared.put_json(spark, f"{root}/cuts/{number}", at)
    return number


def at_cut(spark: SparkSession, root: str, topics: list[Topic], number: int) -> dict[str, DataFrame]:
    """The tables of a cut, which stay readable for as many batches as the tables keep heads."""
    at = shared.get_json(spark, f"{root}/cuts/{number}")
    return {t.table: current(spark, root, t, at[t.table]) for t in topics if t.table in at}


def produce(rows: DataFrame, topic: Topic) -> None:
    """Append change records to a topic of files."""
    rows.write.mode("append").format(topic.format).save(topic.path)


def reset(spark: SparkSession, root: str, topic: Topic, column: str, prefix: str, accounts: DataFrame, model: P.LinearModel) -> None:
    """Take back every current payment whose ``column`` starts with ``prefix``, with all that follows from it.

    A delete record per payment goes through the topic as any other change. State, features, scores
    and what is derived from them (alerts) then are as if the payments had never been: only
    the buckets of the accounts they belonged to are read and written, and only from the first
    of these payments on. Stored layers beside them are cut with
    ``operators.changes.prune_layers``.
    """
    last = staged(spark, root, topic).groupBy(C.PARTITION).agg(F.max(C.OFFSET).alias("_last"))
    gone = C.tombstones(current(spark, root, topic), column, prefix)
    order = W.partitionBy(C.PARTITION, "_part").orderBy(topic.key)
    # Offsets behind the last one of the partition; numbered in parts, so that no task holds a whole partition.
    placed = gone.withColumn("_part", F.pmod(F.xxhash64(topic.key), F.lit(topic.buckets))).withColumn("_n", F.row_number().over(order))
    placed = placed.join(last, C.PARTITION).withColumn(C.OFFSET, F.col("_last") + F.col("_n") * topic.buckets + F.col("_part"))
    produce(settle(placed.select(*gone.columns), "gone"), topic)
    run_payments(spark, root, topic, accounts, model)


def alerts(spark: SparkSession, root: str, topic: Topic) -> DataFrame:
    """Payments whose decision is not to let them pass."""
    return scores(spark, root, topic).filter(F.col("decision") != "APPROVE").select("txn_id", "account_id", "fraud_score", "decision")


def staging_delay(stage: DataFrame) -> DataFrame:
    """Seconds between broker time and staging, per partition."""
    delay = (F.unix_micros("staged_at") - F.unix_micros("kafka_ts")) / 1e6
    return stage.groupBy(C.PARTITION).agg(F.min(delay).alias("min_s"), F.avg(delay).alias("mean_s"), F.max(delay).alias("max_s"))
