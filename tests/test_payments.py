import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from braid.plans import governance as G
from braid.plans import payments as P
from braid.plans import runlog
from braid.sources import files

NOON = dt.datetime(2026, 9, 22, 12, 0)
ACCOUNTS = "account_id long, home_country long"


def payment(i, at, amount, mcc="5812", device=1, country=1, merchant="m", status="SETTLED", account=1):
    return (i, account, at, Decimal(str(amount)), mcc, device, country, merchant, f"REF-{i}", status)


def history():
    """38 payments of the last 30 days worth 1117.47 in all, none of the last day, then three more within the hour."""
    past = [payment(i, NOON - dt.timedelta(days=2, hours=17 * i % 600), "29.41") for i in range(37)] + [payment(37, NOON - dt.timedelta(days=25), "29.30")]
    old = [payment(90 + i, NOON - dt.timedelta(days=31 + i), "80.00") for i in range(9)]
    new = [
        payment(101, NOON, "5.40"),
        payment(102, NOON + dt.timedelta(minutes=1), "475.00", "4829"),
        payment(103, NOON + dt.timedelta(minutes=2), "8750.00", "7995", device=9, country=7),
    ]
    return past + old + new


@pytest.fixture(scope="module")
def feature_rows(spark):
    pay = spark.createDataFrame(history(), P.PAYMENT_SCHEMA)
    return P.features(pay, spark.createDataFrame([(1, 1)], ACCOUNTS))


@pytest.fixture(scope="module")
def scored(feature_rows):
    return P.score(feature_rows, P.DEMO_MODEL).cache()


def test_golden_features(feature_rows):
    got = {r["txn_id"]: r for r in feature_rows.filter("txn_id > 100").collect()}
    assert [round(got[i]["amount_vs_avg_ratio"], 4) for i in (101, 102, 103)] == [0.1836, 16.4979, 219.0416]
    assert [got[i]["txn_count_1h"] for i in (101, 102, 103)] == [0, 1, 2]
    assert [float(got[i]["amount_sum_24h"]) for i in (101, 102, 103)] == [0.0, 5.4, 480.4]
    flags = ("is_cross_border", "is_new_country_30d", "is_new_device_30d", "is_night_txn", "is_weekend_txn")
    assert [tuple(got[i][f] for f in flags) for i in (101, 103)] == [(False,) * 5, (True, True, True, False, False)]
    assert [got[i]["mcc_base_risk"] for i in (101, 102, 103)] == [0.05, 0.6, 0.75]


def test_first_payment_uses_the_fallback_mean(spark):
    pay = spark.createDataFrame([payment(1, NOON, "60.00")], P.PAYMENT_SCHEMA)
    who = spark.createDataFrame([(1, 1)], ACCOUNTS)
    assert P.features(pay, who).first()["amount_vs_avg_ratio"] == 2.0
    assert P.features(pay, who, fallback=None).first()["amount_vs_avg_ratio"] is None


@pytest.mark.parametrize("score, want", [(0.0, "APPROVE"), (0.29999, "APPROVE"), (0.30, "REVIEW"), (0.48519, "REVIEW"), (0.7, "BLOCK"), (1.0, "BLOCK")])
def test_decision_bands(spark, score, want):
    assert spark.range(1).select(P.decision(F.lit(score))).first()[0] == want


def test_contributions_reproduce_the_score(scored):
    rows = P.attribution(scored, P.DEMO_MODEL, ["txn_id", "fraud_score"]).collect()
    by = {}
    for r in rows:
        by.setdefault((r["txn_id"], r["fraud_score"]), []).append(r)
    assert len(by) == 50
    for (_, s), parts in by.items():
        logit = P.DEMO_MODEL.intercept + sum(p["contribution"] for p in parts)
        assert abs(1 / (1 + math.exp(-logit)) - s) < 1e-5
        sizes = [abs(p["contribution"]) for p in sorted(parts, key=lambda p: p["rank"])]
        assert all(a >= b - 1e-8 for a, b in zip(sizes, sizes[1:])) and len(sizes) == 12


def test_drivers_and_actions(scored):
    shares = P.driver_shares(scored.filter("txn_id = 103"), P.DEMO_MODEL).orderBy("rank").collect()
    assert [r["feature"] for r in shares][:2] == ["amount_vs_avg_ratio", "amount_usd"] and len(shares) == 4
    actions = {}
    for r in P.next_actions(scored, P.DEMO_MODEL).orderBy("txn_id", "rank").collect():
        actions.setdefault(r["txn_id"], []).append(r["action"])
    assert all(len(a) <= 3 and len(set(a)) == len(a) for a in actions.values())
    assert actions[103][0] == "Call the customer on file"
    # Nothing raised the risk of the small payment beyond at most two rules, so a case is opened.
    assert all(a[-1] == P.DEFAULT_ACTION for a in actions.values() if len(a) < 3)


def test_borderline_payment(spark):
    pay = spark.createDataFrame(history(), P.PAYMENT_SCHEMA)
    at = P.history_at(pay, F.lit(NOON + dt.timedelta(minutes=3)))
    row = at.first()
    assert (row["c1h"], float(row["s24h"]), row["c30d"]) == (3, 9230.4, 41)
    calm = P.history_at(pay, F.lit(NOON))
    best = P.borderline_payment(calm, P.DEMO_MODEL).first()
    assert 0.32 <= best["expected"] <= 0.68 and best["merchant"] == P.PROFILES[0][0]
    hot = P.LinearModel(P.DEMO_MODEL.names, P.DEMO_MODEL.means, P.DEMO_MODEL.scales, P.DEMO_MODEL.weights, 50.0)
    assert P.borderline_payment(calm, hot).count() == 0


def test_review_round_trip(spark, scored):
    now = F.lit(NOON)
    status, opened = P.open_review(scored, now)
    held = {r["txn_id"] for r in scored.filter("decision = 'REVIEW'").collect()}
    assert held and {r["txn_id"] for r in opened.collect()} == held == {r["txn_id"] for r in status.collect()}
    first = min(held)
    decisions = spark.createDataFrame([(first, True, "ann"), (101, False, "bob")], "txn_id long, confirm_fraud boolean, investigator string")
    moved, paid = P.resolve_review(decisions, opened, now)
    assert [(r["txn_id"], r["status"]) for r in moved.collect()] == [(first, "CONFIRMED_FRAUD")]
    assert {r["txn_id"]: (r["status"], r["decline_reason"]) for r in paid.collect()} == {first: ("DECLINED", "ANALYST_CONFIRMED_FRAUD"), 101: ("SETTLED", None)}
    later = moved.select("alert_id", "txn_id", "status", F.lit(NOON + dt.timedelta(hours=1)).alias("created_at"))
    alerts = opened.select("alert_id", "txn_id", "status", "created_at").unionByName(later)
    labels = {r["txn_id"]: r["fraud_label"] for r in P.labels_from_alerts(scored.select("txn_id"), alerts).collect()}
    assert labels[first] is True and all(labels[t] is None for t in held - {first})
    again, _ = P.resolve_review(decisions, moved, now)
    assert again.count() == 0


def test_training_recovers_a_separable_rule(spark, scored):
    labelled = scored.withColumn("fraud_label", F.col("amount_usd") > 100)
    model = P.train(labelled, reg=0.01)
    again = P.score(labelled, model).filter("(fraud_score > 0.5) != fraud_label").count()
    assert again == 0
    with pytest.raises(ValueError):
        P.train(labelled.withColumn("fraud_label", F.lit(True)))


def test_card_testing_and_spread(spark, scored):
    pay = spark.createDataFrame(history(), P.PAYMENT_SCHEMA)
    found = P.card_testing(pay, 10, 400, 600).collect()
    assert [(r["txn_id"], r["next_txn_id"], r["gap_seconds"]) for r in found] == [(101, 102, 60.0)]
    spread = P.merchant_spread(scored, pay).first()
    assert spread["accounts"] == 1 and spread["reading"] == "card"


def test_entitlements_do_not_leak_or_repeat(spark):
    accounts = spark.createDataFrame([(1,), (2,), (3,)], "account_id long")
    units = G.business_units(accounts, {"US": F.col("account_id") == 2}, "EU")
    grants = spark.createDataFrame([("us", "US"), ("us", "US"), ("lead", "US"), ("lead", "EU"), ("none", "XX")], "db_user string, business_unit string")
    rows = spark.createDataFrame([(10, 1), (11, 2), (12, 2), (13, 3)], "txn_id long, account_id long")
    assert sorted(r["txn_id"] for r in G.entitled(rows, units, grants, "us").collect()) == [11, 12]
    assert G.entitled(rows, units, grants, "lead").count() == 4 and G.entitled(rows, units, grants, "none").count() == 0
    assert G.entitled(rows, units, grants).count() == 0
    check = {r["db_user"]: (r["rows"], r["units"]) for r in G.entitlement_check(rows, units, grants).collect()}
    assert check == {"us": (2, 1), "lead": (4, 2), "none": (0, 0)}


def test_audit(spark, tmp_path):
    calls = spark.createDataFrame([(1, "ann", "q" * 900, "s" * 3000, 7, 12.345), (2, "bob", None, "x", 0, 1.0)], "asked_at int, db_user string, question string, sql_text string, rows_returned int, duration_ms double")
    G.append_audit(calls, str(tmp_path / "audit"))
    G.append_audit(calls.filter("db_user = 'bob'"), str(tmp_path / "audit"))
    trail = spark.read.parquet(str(tmp_path / "audit"))
    ann = G.own_audit(trail, "ann").first()
    assert (len(ann["question"]), len(ann["sql_text"]), ann["duration_ms"]) == (500, 2000, Decimal("12.3"))
    assert G.own_audit(trail, "bob").count() == 2 and G.audit_trail(trail, 2).first()["asked_at"] == 2


def test_run_log_skips_broken_lines(spark, tmp_path):
    lines = ['{"kind":"event","total_ms":%d,"analytics_ms":5.0,"hops":{"raw":%d}}' % (t, t) for t in (30, 10, 20, 40)]
    (tmp_path / "runs.jsonl").write_text("\n".join([*lines, '{"kind":"event","total', '{"kind":"investigation"}']))
    runs = files.read_runs(spark, str(tmp_path / "runs.jsonl"))
    got = runlog.latency_summary(runs).first()
    assert (got["runs"], got["min_ms"], got["max_ms"], got["median_ms"], got["mean_ms"]) == (4, 10.0, 40.0, 30.0, 25.0)
    assert runlog.hop_means(runs).first()["mean_ms"] == 25.0
