import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from braid.operators.windows import DAY, HOUR, PastWindow, next_within, past_features

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, account string, ts timestamp, amount decimal(12,2), device int"


def skewed_rows(n=600, seed=7):
    """One account holds two thirds of all rows, many of them at the same second."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        account = "hot" if rnd.random() < 0.66 else f"a{rnd.randrange(8)}"
        at = START + dt.timedelta(seconds=rnd.randrange(40 * 24) * 3600 if rnd.random() < 0.5 else rnd.randrange(40 * DAY))
        rows.append((i, account, at, Decimal(rnd.randrange(1, 90_000)) / 100, rnd.randrange(6)))
    return rows


def brute(rows, seconds):
    out = {}
    for i, acc, at, _, _ in rows:
        past = [r for r in rows if r[1] == acc and at - dt.timedelta(seconds=seconds) <= r[2] < at]
        out[i] = (len(past), sum((r[3] for r in past), Decimal(0)))
    return out


def brute_unseen(rows, seconds):
    return {
        i: not any(r[1] == acc and r[4] == dev and at - dt.timedelta(seconds=seconds) <= r[2] < at for r in rows)
        for i, acc, at, _, dev in rows
    }


@pytest.mark.parametrize("hot_rows", [10_000, 100, 0])
def test_past_features_match_brute_force_for_ordinary_and_hot_keys(spark, hot_rows):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    spans = {"h": HOUR, "d": DAY, "m": 30 * DAY}
    windows = [w for n, s in spans.items() for w in (PastWindow(f"n_{n}", s, "count"), PastWindow(f"s_{n}", s, "sum"))]
    got = past_features(df, "account", "ts", "amount", "id", windows, {"fresh": ("device", DAY)}, hot_rows, bucket_seconds=1800)
    got = {r["id"]: r for r in got.collect()}
    assert len(got) == len(rows)
    for n, s in spans.items():
        want = brute(rows, s)
        assert {i: (r[f"n_{n}"], r[f"s_{n}"]) for i, r in got.items()} == want
    assert {i: r["fresh"] for i, r in got.items()} == brute_unseen(rows, DAY)


def test_lower_bound_belongs_to_the_window_and_the_row_itself_does_not(spark):
    rows = [(1, "a", START, Decimal(5), 1), (2, "a", START + dt.timedelta(hours=1), Decimal(7), 1), (3, "a", START + dt.timedelta(hours=1), Decimal(9), 1)]
    for hot_rows in (100, 0):
        df = spark.createDataFrame(rows, SCHEMA)
        got = past_features(df, "account", "ts", "amount", "id", [PastWindow("n", HOUR, "count")], hot_rows=hot_rows)
        assert {r["id"]: r["n"] for r in got.collect()} == {1: 0, 2: 1, 3: 1}


def test_inexact_amounts_are_refused(spark):
    df = spark.createDataFrame([(1, "a", START, 1.5)], "id long, account string, ts timestamp, amount double")
    with pytest.raises(ValueError):
        past_features(df, "account", "ts", "amount", "id", [PastWindow("n", HOUR, "sum")])


def test_null_keys_stay(spark):
    rows = [(i, None, START + dt.timedelta(minutes=i), Decimal(1), 1) for i in range(5)]
    for hot_rows in (100, 2):
        got = past_features(
            spark.createDataFrame(rows, SCHEMA), "account", "ts", "amount", "id", [], {"fresh": ("device", DAY)}, hot_rows
        )
        assert sorted(r["fresh"] for r in got.collect()) == [False] * 4 + [True]


def test_next_within_matches_brute_force(spark):
    rows = skewed_rows(400, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = next_within(df, "account", "ts", F.col("amount") <= 100, F.col("amount") >= 500, ["id"], 6 * HOUR)
    want = {}
    for i, acc, at, amount, _ in rows:
        later = [r for r in rows if r[1] == acc and r[3] >= 500 and at < r[2] <= at + dt.timedelta(hours=6)]
        if amount <= 100 and later:
            first = min(later, key=lambda r: (r[2], r[0]))
            want[i] = (first[0], (first[2] - at).total_seconds())
    assert {r["id"]: (r["next_id"], r["gap_seconds"]) for r in got.collect()} == want


def test_windows_and_next_rows_stay_linear(spark):
    """No moving frame is left in the plans: every frame begins at the partition's edge."""
    df = spark.createDataFrame([(1, "a", START, Decimal(5), 1)], SCHEMA)
    past = past_features(df, "account", "ts", "amount", "id", [PastWindow("n", HOUR, "count"), PastWindow("s", DAY, "sum")])
    ahead = next_within(df, "account", "ts", F.col("device") == 1, F.col("device") == 2, ["id"], HOUR)
    for frame in (past, ahead):
        plan = frame._jdf.queryExecution().analyzed().toString()
        assert "windowframe" in plan.lower() or "specifiedwindowframe" in plan.lower()
        for part in plan.lower().split("specifiedwindowframe(")[1:]:
            assert "unboundedpreceding" in part.split(")")[0] + part.split(")")[1]
