import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braid.operators import ranking as R
from braid.operators.matching import contains_join, has_words
from braid.operators.rules import apply_filter, typed_filter
from braid.operators.shares import distribution, linked_gap, linked_gap_per_link, term_set_diff, with_share


def values_frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("sortable", [5, 65_536])
@pytest.mark.parametrize("kind", ["uniform", "ties", "outlier", "single"])
def test_quantiles_equal_numpy(spark, monkeypatch, kind, sortable):
    monkeypatch.setattr(R, "SORTABLE", sortable)
    monkeypatch.setattr(R, "BINS", 8)
    rnd = random.Random(1)
    values = {
        "uniform": [rnd.random() for _ in range(301)],
        "ties": [float(rnd.randrange(4)) for _ in range(200)] + [2.0] * 150,
        "outlier": [float(rnd.randrange(300)) for _ in range(250)] + [1e6, 1e12],
        "single": [4.5],
    }[kind]
    df = values_frame(spark, values + [None])
    for q in (0.0, 0.31, 0.5, 0.99, 1.0):
        assert R.quantile_cont(df, "v", q) == pytest.approx(float(np.quantile(values, q)), rel=1e-12)
    assert R.upper_median(df, "v") == sorted(values)[len(values) // 2]


def test_quantile_of_nothing_is_none(spark):
    assert R.quantile_cont(values_frame(spark, [None]), "v", 0.5) is None


def test_global_rank_with_ties(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1.0, 1.0, 1.0, rnd.random()]) if i % 50 else None) for i in range(500)]
    got = R.global_rank(spark.createDataFrame(rows, "id int, s double"), [F.desc_nulls_last("s"), F.col("id")], partitions=5)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r["id"]: r["rank"] for r in got.collect()} == {r[0]: i for i, r in enumerate(order, 1)}


def test_latest_first_and_top_k(spark):
    rows = [("k" if i % 3 else f"k{i}", i, f"p{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "key string, off int, payload string")
    latest = {r["key"]: r["payload"] for r in R.latest_by_key(df, ["key"], ["off"]).collect()}
    first = {r["key"]: r["payload"] for r in R.first_by_key(df, ["key"], ["off"]).collect()}
    assert latest["k"] == "p59" and first["k"] == "p1" and len(latest) == 21
    top = R.top_k_per_group(df, ["key"], [F.desc("off")], 2)
    assert [r["payload"] for r in top.filter("key = 'k'").orderBy("rank").collect()] == ["p59", "p58"]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_typed_filter_is_all_or_nothing(spark):
    df = spark.createDataFrame([("PHASE3", 10), ("PHASE1", 20), ("PHASE3", 30)], "phase string, n int")
    assert apply_filter(df, [("phase", "=", "PHASE3"), ("n", ">", 15)], {"phase", "n"}).count() == 1
    assert apply_filter(df, [], {"phase"}).count() == 3
    for bad in [("other", "=", 1), ("n", "~", 1), ("n", "=", [1])]:
        with pytest.raises(ValueError):
            typed_filter([("phase", "=", "PHASE3"), bad], {"phase", "n"})
    # A literal is a value, whatever it looks like.
    assert apply_filter(df, [("phase", "=", "x' OR '1'='1")], {"phase"}).count() == 0


def test_contains_join_equals_all_pairs(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc %_") for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    phrases = ["a", "ab", "abc", "cab ", "%", "_b", "bb ca", "zzz", ""]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    right = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = sorted((r["id"], r["phrase"]) for r in contains_join(left, "text", right, "phrase").collect())
    assert got == sorted((i, p) for i, t in enumerate(texts) for p in phrases if p and p in t)


def test_words_need_boundaries_in_any_script(spark):
    rows = [("phase ii study", "phase i", False), ("in phase i.", "phase i", True), ("élan", "lan", False), ("a.b (c)", "(c)", True)]
    df = spark.createDataFrame(rows, "t string, p string, want boolean")
    assert df.filter(has_words(F.col("t"), F.col("p")) != F.col("want")).count() == 0


def test_share_and_set_difference(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "k string")
    assert {r["k"]: (r["n"], r["pct"]) for r in with_share(distribution(df, ["k"])).collect()} == {"a": (3, 75.0), "b": (1, 25.0)}
    pair = spark.createDataFrame([(1, ["x", "y", "x"], ["y", "z"]), (2, ["q"], ["q", "q"])], "id int, a array<string>, b array<string>")
    got = {r["id"]: r for r in term_set_diff(pair, "a", "b").collect()}
    assert (got[1]["shared"], got[1]["only_a"], got[1]["only_b"], got[1]["identical"]) == (["y"], ["x"], ["z"], False)
    assert got[2]["identical"]


def test_publication_gap_counts_trials_not_links(spark):
    trials = spark.createDataFrame([(1, "P"), (2, "P"), (3, "P")], "nct_id int, phase string")
    links = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "nct_id int, pmid string")
    names = ("n", "have", "missing", "pct")
    assert linked_gap(trials, links, "nct_id", ["phase"], names).first()[1:] == (3, 1, 2, 66.7)
    # Counting after the join takes the trial with three papers for three trials.
    assert linked_gap_per_link(trials, links, "nct_id", ["phase"], names).first()[1:] == (5, 1, 4, 80.0)


@pytest.mark.parametrize("sortable", [3, 65_536])
def test_quantiles_with_infinite_and_huge_values(spark, monkeypatch, sortable):
    monkeypatch.setattr(R, "SORTABLE", sortable)
    monkeypatch.setattr(R, "BINS", 4)
    inf = float("inf")
    for values in ([0.0, 1.0, 2.0, inf], [-inf, -inf, 0.0, 5.0, inf], [-1.7e308, -1.0, 0.0, 1.0, 1.7e308, 1.7e308], [5e-324, 1e-323, 0.0, 1.5e-323, 2e-323]):
        for k in range(len(values)):
            n, got = R.order_statistic(values_frame(spark, values), "v", lambda _, k=k: k)
            assert (n, got) == (len(values), sorted(values)[k])


@pytest.mark.parametrize("k", [2, 1_200])
def test_top_k_equals_a_full_ranking(spark, k):
    rows = [(g, (i * 7919) % 5003, i) for g in range(2) for i in range(1_500)]
    df = spark.createDataFrame(rows, "g int, score int, id int")
    got = R.top_k_per_group(df, ["g"], [F.desc("score"), F.col("id")], k).collect()
    for g in range(2):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:k]
        assert sorted((r["rank"], r["id"]) for r in got if r["g"] == g) == [(n + 1, r[2]) for n, r in enumerate(want)]


def test_latest_row_keeps_one_of_ties_and_null_keys(spark):
    rows = [("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 1, "z"), (None, 5, 0, "n"), (None, 4, 9, "m"), ("b", None, 1, "q")]
    df = spark.createDataFrame(rows, "k string, at int, part int, v string")
    for order in (["at"], ["at", "part"]):
        got = {r["k"]: r["v"] for r in R.latest_by_key(df, ["k"], order).collect()}
        assert got["a"] in ("y", "z") and got[None] == "n" and got["b"] == "q" and len(got) == 3
    assert {r["k"]: r["v"] for r in R.first_by_key(df, ["k"], ["at"]).collect()} == {"a": "x", None: "m", "b": "q"}
    assert "SortAggregate" not in df.groupBy("k").agg(F.max("at"))._jdf.queryExecution().executedPlan().toString()


def test_containment_in_a_long_text_and_quoting(spark):
    long = "x " * 50_000 + "needle" + " y" * 10
    texts = spark.createDataFrame([(1, long), (2, "nothing"), (3, r"a \E needle b")], "id int, text string")
    phrases = spark.createDataFrame([("needle",), (r"\E n",), ("zz",)], "phrase string")
    pairs = contains_join(texts, "text", phrases, "phrase")
    assert sorted((r["id"], r["phrase"]) for r in pairs.collect()) == [(1, "needle"), (3, r"\E n"), (3, "needle")]
    assert {r["id"] for r in pairs.filter(has_words(F.col("text"), F.col("phrase"))).collect()} == {1, 3}


@pytest.mark.parametrize("kind", ["all exponents", "around zero", "negative", "close together"])
def test_an_order_statistic_takes_few_passes(spark, monkeypatch, kind):
    dice = random.Random(5)
    make = {
        "all exponents": lambda: dice.choice([-1, 1]) * math.ldexp(1 + dice.random(), dice.randrange(-1070, 1020)),
        "around zero": lambda: dice.choice([0.0, -0.0, 5e-324, -5e-324, 1e-300, 1.0, dice.random()]),
        "negative": lambda: -math.ldexp(1 + dice.random(), dice.randrange(-200, 200)),
        "close together": lambda: 1.0 + dice.randrange(1 << 20) * 2.0**-52,
    }[kind]
    values = [make() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    monkeypatch.setattr(R, "SORTABLE", 3)
    passes, plain = [], R._holding_rank
    monkeypatch.setattr(R, "_holding_rank", lambda *a: passes.append(1) or plain(*a))
    for k in (0, 1700, 2999):
        passes.clear()
        assert R.order_statistic(df, "x", lambda n, k=k: k) == (3000, sorted(values)[k])
        assert len(passes) <= 7
