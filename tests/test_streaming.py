import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from braid.operators import changes as C
from braid.plans import payments as P
from braid.sources import files
from braid.streaming import changefeed as S

START = dt.datetime(2024, 3, 1, 9)
COLUMNS = (
    "txn_id BIGINT, account_id BIGINT, initiated_at TIMESTAMP, amount DECIMAL(12,2), mcc STRING, device_id BIGINT, country BIGINT, "
    "merchant STRING, reference_id STRING, status STRING"
)


def record(txn, off, op="c", minutes=0, amount="10.00", account=1, device=1):
    at = (START + dt.timedelta(minutes=minutes)).isoformat() + "Z"
    return {
        "txn_id": txn, "account_id": account, "initiated_at": at, "amount": amount, "mcc": "5812", "device_id": device, "country": 1, "merchant": "m",
        "reference_id": f"REF-{txn}", "status": "SETTLED", C.OP: op, C.DELETED: "true" if op == "d" else "false", "kafka_ts": at,
        C.PARTITION: txn % 2, C.OFFSET: off,
    }


class Feed:
    def __init__(self, spark, tmp_path):
        self.spark, self.root, self.n = spark, str(tmp_path / "root"), 0
        self.path = tmp_path / "topic"
        self.path.mkdir()
        self.topic = S.Topic("payments", "txn_id", COLUMNS, path=str(self.path), options={"maxFilesPerTrigger": "1"})
        self.accounts = spark.createDataFrame([(1, 1), (2, 1)], "account_id long, home_country long")

    def put(self, *records):
        self.n += 1
        (self.path / f"part-{self.n:03d}.json").write_text("\n".join(json.dumps(r) for r in records))

    def run(self):
        S.run_payments(self.spark, self.root, self.topic, self.accounts, P.DEMO_MODEL)

    def state(self):
        return {r["txn_id"]: r for r in S.current(self.spark, self.root, self.topic).collect()}

    def scores(self):
        return {r["txn_id"]: r for r in S.scores(self.spark, self.root, self.topic).collect()}

    def batch_scores(self):
        """The features computed at once from the current rows."""
        rows = P.score(P.features(S.current(self.spark, self.root, self.topic), self.accounts), P.DEMO_MODEL)
        return {r["txn_id"]: r for r in rows.collect()}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_insert_update_delete_and_late_rows(feed):
    feed.put(record(1, 0), record(2, 1, minutes=10), record(3, 2, minutes=20, account=2))
    feed.put(record(2, 3, "u", minutes=10, amount="99.00"), record(3, 4, "d", minutes=20, account=2), record(9, 5, "d", minutes=1))
    feed.run()
    assert set(feed.state()) == {1, 2} and feed.state()[2]["amount"] == Decimal("99.00")
    assert {t: r["txn_count_1h"] for t, r in feed.scores().items()} == {1: 0, 2: 1}
    # A payment of before arrives late: the rows after it are scored again.
    feed.put(record(4, 6, minutes=5, amount="50.00"))
    feed.run()
    assert {t: r["txn_count_1h"] for t, r in feed.scores().items()} == {1: 0, 2: 2, 4: 1}
    assert feed.scores() == feed.batch_scores()


def test_replay_changes_nothing_and_old_records_do_not_revive_a_key(feed):
    feed.put(record(1, 0), record(2, 1, minutes=3))
    feed.put(record(1, 2, "d"))
    feed.run()
    before = feed.state(), feed.scores()
    feed.put(record(1, 0), record(2, 1, minutes=3))
    feed.run()
    assert (feed.state(), feed.scores()) == before


def test_random_stream_equals_one_batch(feed):
    rnd = random.Random(3)
    off, live = 0, {}
    for _ in range(4):
        out = []
        for _ in range(12):
            txn = rnd.randrange(14)
            op = rnd.choice(["c", "u", "u", "d"])
            out.append(record(txn, off, op, rnd.randrange(60 * 24 * 3), f"{rnd.randrange(1, 900)}.50", rnd.choice([1, 2]), rnd.randrange(3)))
            off += 1
            live[txn] = op != "d"
        rnd.shuffle(out)
        feed.put(*out)
    feed.run()
    assert set(feed.state()) == {t for t, alive in live.items() if alive}
    assert feed.scores() == feed.batch_scores()
    stats = C.offset_stats(S.staged(feed.spark, feed.root, feed.topic)).agg(F.sum("messages"), F.max("high")).first()
    assert tuple(stats) == (48, 47)
    runs = files.read_runs(feed.spark, f"{feed.root}/runs").collect()
    assert len(runs) == 4 and set(runs[0]["hops"]) == {"raw", "features"}
    assert S.staging_delay(S.staged(feed.spark, feed.root, feed.topic)).count() == 2


def test_sync_of_several_topics(spark, tmp_path):
    topics = []
    for table in ("alerts", "accounts"):
        path = tmp_path / table
        path.mkdir()
        rows = [{"id": i, "v": f"{table}{i}", C.OP: "c", C.DELETED: "false", "kafka_ts": "2024-01-01T00:00:00Z", C.PARTITION: 0, C.OFFSET: i} for i in range(3)]
        (path / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
        topics.append(S.Topic(table, "id", "id BIGINT, v STRING", path=str(path)))
    tables = S.sync(spark, str(tmp_path / "root"), topics, passes=2)
    assert {n: t.count() for n, t in tables.items()} == {"alerts": 3, "accounts": 3}
    with pytest.raises(ValueError):
        S.current(spark, str(tmp_path / "root"), S.Topic("none", "id", "id BIGINT"))


def test_prefix_reset_and_pruning(spark):
    rows = spark.createDataFrame([(1, "STORY-1", "c", "false", 5), (2, "OTHER", "c", "false", 6)], "txn_id int, reference_id string, __op string, __deleted string, kafka_offset long")
    gone = C.tombstones(rows, "reference_id", "STORY-").withColumn(C.OFFSET, F.col(C.OFFSET) + 1)
    left = C.apply_changes(rows, gone, ["txn_id"], [C.OFFSET])
    assert [r["txn_id"] for r in left.collect()] == [2]
    layers = C.prune_layers(left, {"features": rows.select("txn_id"), "alerts": rows.select("txn_id")}, "txn_id")
    assert {n: df.count() for n, df in layers.items()} == {"features": 1, "alerts": 1}


def test_live_feed_hides_deletes_and_what_they_removed(spark):
    rows = [(1, "c", 1, 0, 0), (1, "d", 2, 0, 1), (2, "r", 3, 0, 2), (3, "u", 4, 0, 3), (4, "x", 5, 0, 4)]
    feed = spark.createDataFrame(rows, "txn_id int, __op string, ts int, kafka_partition int, kafka_offset int")
    got = [(r["txn_id"], r["change"]) for r in C.live_feed(feed, "txn_id", "ts", 10).collect()]
    assert got == [(4, "x"), (3, "UPDATE"), (2, "SNAPSHOT")]


def written(table, spark):
    """Bucket numbers by the batch that holds them."""
    return dict(table.heads(spark))


def test_a_batch_on_one_key_rewrites_one_bucket(feed):
    feed.put(*[record(i, i, minutes=i, account=1 + i % 40) for i in range(200)])
    feed.run()
    tables = S.state_table(feed.root, feed.topic), S.account_table(feed.root, feed.topic)
    before = [written(t, feed.spark) for t in tables]
    assert all(len(b) > 10 for b in before)
    feed.put(record(7, 900, "u", minutes=7, amount="77.00", account=8))
    feed.run()
    for table, old in zip(tables, before, strict=True):
        now = written(table, feed.spark)
        assert len([b for b in now if now[b] != old.get(b)]) == 1
    assert feed.state()[7]["amount"] == Decimal("77.00")
    assert feed.scores() == feed.batch_scores()


def test_files_read_do_not_grow_with_untouched_accounts(spark, tmp_path):
    read = []
    for many in (30, 300):
        path = tmp_path / str(many)
        path.mkdir()
        feed = Feed(spark, path)
        feed.accounts = spark.createDataFrame([(i, 1) for i in range(many)], "account_id long, home_country long")
        feed.put(*[record(i, i, minutes=i, account=i % many) for i in range(2 * many)])
        feed.run()
        feed.put(record(3, 5000, "u", minutes=3, amount="1.00", account=3))
        feed.run()
        keys = spark.createDataFrame([(3,)], "txn_id long")
        read.append(len(S.refresh_scores(spark, feed.root, feed.topic, keys, feed.accounts, P.DEMO_MODEL, 1)))
    assert read == [1, 1]


def test_a_payment_that_moves_to_another_account(feed):
    feed.put(record(1, 0), record(2, 1, minutes=5), record(3, 2, minutes=9, account=2), record(4, 3, minutes=12))
    feed.run()
    feed.put(record(2, 4, "u", minutes=5, account=2))
    feed.run()
    assert {t: (r["account_id"], r["txn_count_1h"]) for t, r in feed.scores().items()} == {1: (1, 0), 2: (2, 0), 3: (2, 1), 4: (1, 1)}
    assert feed.scores() == feed.batch_scores()


def test_a_batch_that_dies_between_buckets_is_not_seen_and_can_be_run_again(feed, monkeypatch):
    feed.put(*[record(i, i, minutes=i) for i in range(20)])
    feed.run()
    before = feed.state(), feed.scores()
    feed.put(*[record(i, 100 + i, "u", minutes=i, amount="5.00") for i in range(20)])
    publish = S.Buckets.publish

    def dies(self, spark, batch, numbers):
        # Some buckets are there, one is not, and the heads are not written.
        S.shared.remove(spark, f"{self.root}/data/{batch}/bucket={numbers[0]}")
        raise RuntimeError("lost")

    for broken in ("state", "accounts"):
        monkeypatch.setattr(S.Buckets, "publish", lambda self, *a, b=broken: (dies if f"/{b}/" in self.root else publish)(self, *a))
        with pytest.raises(Exception, match="lost"):
            feed.run()
        assert feed.scores() == before[1]
    monkeypatch.setattr(S.Buckets, "publish", publish)
    feed.run()
    assert {r["amount"] for r in feed.state().values()} == {Decimal("5.00")}
    assert feed.scores() == feed.batch_scores() != before[1]


def test_old_folders_are_removed_and_kept_heads_stay_readable(feed):
    for n in range(7):
        feed.put(record(1, n, "u", amount=f"{n}.00"))
    S.run_merge(feed.spark, feed.root, feed.topic)
    table = S.state_table(feed.root, feed.topic)
    assert table.batches(feed.spark) == [4, 5, 6]
    amounts = [table.read(feed.spark, before=b + 1).first()["amount"] for b in (4, 5, 6)]
    assert amounts == sorted(amounts) and amounts[-1] == 6
    held = [d for v in S.shared.names(feed.spark, f"{table.root}/data") for d in S.shared.names(feed.spark, f"{table.root}/data/{v}") if d.startswith("bucket")]
    assert len(held) == 3


def test_tables_of_a_cut_show_one_moment(spark, tmp_path):
    def rows(table, n, at, op="c"):
        return "\n".join(json.dumps({"id": i, "v": f"{table}{at}", C.OP: op, C.DELETED: "false", "kafka_ts": "2024-01-01T00:00:00Z", C.PARTITION: 0, C.OFFSET: at + i}) for i in range(n))

    topics, root = [], str(tmp_path / "root")
    for table in ("alerts", "labels"):
        path = tmp_path / table
        path.mkdir()
        (path / "a.json").write_text(rows(table, 3, 0))
        topics.append(S.Topic(table, "id", "id BIGINT, v STRING", path=str(path)))
    S.sync(spark, root, topics)
    number = S.cut(spark, root, topics)
    # One topic goes on, and its batch is replayed, while the cut is being read.
    (tmp_path / "alerts" / "b.json").write_text(rows("alerts", 5, 100))
    S.run_merge(spark, root, topics[0])
    seen = S.staged(spark, root, topics[0]).filter(f"{C.OFFSET} >= 100")
    S.merge_batch(root, topics[0], spark.createDataFrame(seen.drop("staged_at").collect(), seen.drop("staged_at").schema), 1)
    tables = S.at_cut(spark, root, topics, number)
    assert {n: sorted((r["id"], r["v"]) for r in t.collect()) for n, t in tables.items()} == {n: [(i, f"{n}0") for i in range(3)] for n in ("alerts", "labels")}
    assert sorted(r["v"] for r in S.sync(spark, root, topics)["alerts"].collect()) == ["alerts100"] * 5


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "table")
    files.refresh(spark.createDataFrame([(1,)], "x int"), root, 1)
    # As a writer leaves it that dies before it publishes.
    spark.createDataFrame([(9,)], "x int").write.parquet(f"{root}/{files.VERSION}=2")
    assert [r["x"] for r in files.current(spark, root).collect()] == [1]
    with pytest.raises(ValueError):
        files.current(spark, str(tmp_path / "none"))


def test_a_partition_of_the_topic_is_written_by_several_tasks(spark, tmp_path):
    from braid.catalog import streams

    rows = spark.range(2_000).select(F.col("id").alias("txn_id"), F.lit(1).alias(C.PARTITION)).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    streams._written(rows, f"{tmp_path}/topic")
    found = spark.read.json(f"{tmp_path}/topic").select("txn_id", F.input_file_name().alias("at"))
    assert found.count() == 4_000 and found.select("at").distinct().count() > 8
    assert found.groupBy("txn_id").agg(F.count_distinct("at").alias("files")).filter("files > 1").isEmpty()
