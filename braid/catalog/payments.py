"""Payment queries: features, scores, explanations, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from braid.catalog.base import query, with_ctes
from braid.catalog.payment_frames import (
    ACCOUNTS, ALERTS, NOVELTY, PAYMENTS, SCORED_CTES, VELOCITY, accounts, alerts, features, payments, scaled_sql,
    scored,
)
from braid.operators.changes import unmatched_facts
from braid.operators.shares import distribution, with_share
from braid.plans import payments as P

_NAMES = P.DEMO_MODEL.names


def _plain(df):
    """Amounts as doubles; the totals behind them are exact decimals."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


@query(
    "velocity_1h_24h_30d",
    with_ctes(PAYMENTS, VELOCITY)
    + """SELECT txn_id, account_id, CAST(txn_count_1h AS BIGINT) AS txn_count_1h, CAST(txn_count_24h AS BIGINT) AS txn_count_24h,
                CAST(amount_sum_1h AS DOUBLE) AS amount_sum_1h, CAST(amount_sum_24h AS DOUBLE) AS amount_sum_24h,
                CAST(amount AS DOUBLE) / coalesce(nullif(CAST(s30 AS DOUBLE) / CAST(nullif(n30, 0) AS DOUBLE), 0.0), 30.0) AS amount_vs_avg_ratio
         FROM velocity""",
)
def velocity_1h_24h_30d(spark, sf):
    v = P.velocity(payments(spark, sf))
    ratio = P.ratio_to_mean(F.col("amount"), F.col("_s30"), F.col("_n30"))
    return _plain(
        v.select(
            "txn_id", "account_id", "txn_count_1h", "txn_count_24h", "amount_sum_1h", "amount_sum_24h",
            ratio.alias("amount_vs_avg_ratio"),
        )
    )


@query("new_device_country_30d", with_ctes(PAYMENTS, NOVELTY) + "SELECT * FROM novelty")
def new_device_country_30d(spark, sf):
    return P.novelty(payments(spark, sf)).select("txn_id", "is_new_device_30d", "is_new_country_30d")


@query(
    "time_flags",
    with_ctes(PAYMENTS)
    + """SELECT txn_id, (hour(initiated_at) >= 22 OR hour(initiated_at) < 6) AS is_night_txn,
                dayofweek(initiated_at) IN (0, 6) AS is_weekend_txn FROM payments""",
)
def time_flags(spark, sf):
    ts = F.col("initiated_at")
    return payments(spark, sf).select(
        "txn_id", P.is_night(ts).alias("is_night_txn"), P.is_weekend(ts).alias("is_weekend_txn")
    )


@query("fraud_features", with_ctes(*SCORED_CTES[:5]) + "SELECT * EXCLUDE (initiated_at) FROM features")
def fraud_features(spark, sf):
    return _plain(features(spark, sf).drop("initiated_at"))


@query(
    "dimension_completeness",
    with_ctes(PAYMENTS, ACCOUNTS)
    + """SELECT p.txn_id, p.account_id FROM payments p
         WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_id = p.account_id AND a.c_acctbal >= 0)""",
)
def dimension_completeness(spark, sf):
    known = accounts(spark, sf).filter("c_acctbal >= 0")
    return unmatched_facts(payments(spark, sf), known, "account_id").select("txn_id", "account_id")


@query("score_and_decide", with_ctes(*SCORED_CTES) + "SELECT txn_id, account_id, fraud_score, decision FROM scored")
def score_and_decide(spark, sf):
    return scored(spark, sf).select("txn_id", "account_id", "fraud_score", "decision")


@query(
    "decision_mix",
    with_ctes(*SCORED_CTES)
    + """SELECT decision, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM scored), 1) AS pct
         FROM scored GROUP BY decision""",
)
def decision_mix(spark, sf):
    return with_share(distribution(scored(spark, sf), ["decision"]))


@query(
    "kpi_flags",
    with_ctes(*SCORED_CTES)
    + """SELECT txn_id, amount_vs_avg_ratio >= 5 AS hot_ratio, txn_count_1h >= 3 AS hot_count, mcc_base_risk >= 0.5 AS hot_risk
         FROM features""",
)
def kpi_flags(spark, sf):
    return P.kpi_flags(features(spark, sf)).select("txn_id", "hot_ratio", "hot_count", "hot_risk")


_CONTRIB = "contrib AS (" + " UNION ALL ".join(
    f"SELECT txn_id, {i} AS pos, '{n}' AS feature, '{P.FEATURES[n]}' AS label, CAST({n} AS DOUBLE) AS value, {scaled_sql(i)} AS contribution FROM features"
    for i, n in enumerate(_NAMES)
) + ")"
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(round(contribution, 9)) DESC, pos) AS rank FROM contrib)"""
_DRIVERS = """drivers AS (
  SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY rank) AS drank, sum(contribution) OVER (PARTITION BY txn_id) AS total
  FROM ranked WHERE contribution > 0 AND (value = 1.0 OR feature NOT IN
    ('is_new_country_30d', 'is_new_device_30d', 'is_cross_border', 'is_night_txn')))"""
_EXPLAIN = (*SCORED_CTES[:5], _CONTRIB, _RANKED)


@query(
    "attribution_all",
    with_ctes(*_EXPLAIN) + "SELECT txn_id, CAST(rank AS INTEGER) AS rank, feature, label, value, round(contribution, 9) AS contribution FROM ranked",
)
def attribution_all(spark, sf):
    rows = P.attribution(features(spark, sf), P.DEMO_MODEL)
    return rows.withColumn("contribution", F.round("contribution", 9))


@query(
    "attribution_identity",
    with_ctes(*SCORED_CTES) + "SELECT txn_id, fraud_score, true AS reproduced FROM scored",
)
def attribution_identity(spark, sf):
    """The contributions of each payment add up to its unrounded score."""
    rows = scored(spark, sf).withColumn("exact", P.DEMO_MODEL.score({n: F.col(n) for n in P.DEMO_MODEL.names}))
    parts = P.attribution(rows, P.DEMO_MODEL, ["txn_id", "fraud_score", "exact"])
    logit = F.sum("contribution") + F.lit(P.DEMO_MODEL.intercept)
    again = 1 / (1 + F.exp(-logit))
    return parts.groupBy("txn_id", "fraud_score", "exact").agg((F.abs(again - F.col("exact")) < 1e-6).alias("reproduced")).drop("exact")


@query(
    "attribution_top4",
    with_ctes(*_EXPLAIN, _DRIVERS)
    + "SELECT txn_id, CAST(drank AS INTEGER) AS rank, feature, label, round(100.0 * contribution / total, 6) AS share_pct FROM drivers WHERE drank <= 4",
)
def attribution_top4(spark, sf):
    rows = P.driver_shares(features(spark, sf), P.DEMO_MODEL)
    return rows.withColumn("share_pct", F.round("share_pct", 6))


_ACTION_CASE = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{a}'" for f, a in P.ACTIONS.items()) + " END"


@query(
    "next_best_action",
    with_ctes(
        *_EXPLAIN,
        _DRIVERS,
        f"titled AS (SELECT txn_id, drank, {_ACTION_CASE} AS action FROM drivers)",
        "firsts AS (SELECT txn_id, action, min(drank) AS pos FROM titled WHERE action IS NOT NULL GROUP BY txn_id, action)",
        "picked AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY pos) AS rn FROM firsts)",
        "kept AS (SELECT * FROM picked WHERE rn <= 3)",
        "counted AS (SELECT f.txn_id, count(k.action) AS n FROM features f LEFT JOIN kept k USING (txn_id) GROUP BY f.txn_id)",
    )
    + """SELECT txn_id, CAST(rn AS INTEGER) AS rank, action FROM kept
         UNION ALL SELECT txn_id, CAST(n + 1 AS INTEGER), 'Open a fraud case' FROM counted WHERE n < 3""",
)
def next_best_action(spark, sf):
    return P.next_actions(features(spark, sf), P.DEMO_MODEL)


def _latest_time(pay):
    return pay.agg(F.max("initiated_at").alias("t")).scalar()


_HISTORY = """history AS (
  SELECT account_id, max(now) AS now, count(*) FILTER (initiated_at >= now - INTERVAL '1 hour') AS c1h,
         coalesce(sum(amount) FILTER (initiated_at >= now - INTERVAL '1 hour'), 0) AS s1h,
         count(*) FILTER (initiated_at >= now - INTERVAL '24 hours') AS c24h,
         coalesce(sum(amount) FILTER (initiated_at >= now - INTERVAL '24 hours'), 0) AS s24h,
         count(*) FILTER (initiated_at >= now - INTERVAL '30 days') AS c30d,
         sum(amount) FILTER (initiated_at >= now - INTERVAL '30 days') AS s30d
  FROM (SELECT *, (SELECT max(initiated_at) FROM payments) AS now FROM payments) WHERE initiated_at < now GROUP BY account_id)"""


@query(
    "history_at_now",
    with_ctes(PAYMENTS, _HISTORY)
    + """SELECT account_id, CAST(c1h AS BIGINT) AS c1h, CAST(s1h AS DOUBLE) AS s1h, CAST(c24h AS BIGINT) AS c24h,
                CAST(s24h AS DOUBLE) AS s24h, CAST(c30d AS BIGINT) AS c30d, CAST(s30d AS DOUBLE) AS s30d FROM history""",
)
def history_at_now(spark, sf):
    pay = payments(spark, sf)
    return _plain(P.history_at(pay, _latest_time(pay)).drop("now"))


def _whatif_sql() -> str:
    m = P.DEMO_MODEL
    values = {
        "amount_usd": "a", "txn_count_1h": "c1h", "txn_count_24h": "c24h", "amount_sum_1h": "s1h", "amount_sum_24h": "s24h",
        "amount_vs_avg_ratio": "(a / mean)", "is_cross_border": "0", "is_new_country_30d": "0", "is_new_device_30d": "0",
        "is_night_txn": "(hour(now) >= 22 OR hour(now) < 6)", "is_weekend_txn": "(dayofweek(now) IN (0, 6))",
        "mcc_base_risk": "risk",
    }
    logit = f"CAST({m.intercept} AS DOUBLE)"
    for n, mean, scale, w in zip(m.names, m.means, m.scales, m.weights):
        logit = f"({logit} + (CAST({w} AS DOUBLE) * ((CAST({values[n]} AS DOUBLE) - CAST({mean} AS DOUBLE)) / CAST({scale} AS DOUBLE))))"
    grid = ", ".join(f"({a})" for a in P.GRID)
    profiles = ", ".join(f"({i}, '{n}', '{mcc}', {r})" for i, (n, mcc, r) in enumerate(P.PROFILES))
    return (
        with_ctes(
            PAYMENTS,
            _HISTORY,
            f"grid(a0) AS (VALUES {grid})",
            f"profiles(p, merchant, mcc, risk) AS (VALUES {profiles})",
            "base AS (SELECT *, coalesce(nullif(CAST(s30d AS DOUBLE) / CAST(nullif(c30d, 0) AS DOUBLE), 0.0), 30.0) AS mean FROM history)",
            f"""tried AS (SELECT account_id, p, merchant, mcc, a, round(1.0 / (1.0 + exp(-{logit})), 5) AS s
                FROM base, (SELECT CAST(a0 AS DOUBLE) AS a FROM grid), profiles)""",
        )
        + """SELECT account_id, merchant, mcc, a AS amount, s AS expected FROM (
               SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY p, round(abs(s - 0.5), 5), a) AS rn
               FROM tried WHERE s BETWEEN 0.32 AND 0.68) WHERE rn = 1"""
    )


@query("whatif_borderline", _whatif_sql())
def whatif_borderline(spark, sf):
    pay = payments(spark, sf)
    return P.borderline_payment(P.history_at(pay, _latest_time(pay)), P.DEMO_MODEL)


_LATEST_ALERT = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY created_at DESC, alert_id DESC) AS rn FROM alerts) WHERE rn = 1)"""
_LABEL = "CASE a.status WHEN 'CONFIRMED_FRAUD' THEN true WHEN 'FALSE_POSITIVE' THEN false END"


@query(
    "labels_from_alerts",
    with_ctes(PAYMENTS, ALERTS, _LATEST_ALERT)
    + f"SELECT p.txn_id, {_LABEL} AS fraud_label FROM payments p LEFT JOIN latest a ON a.txn_id = p.txn_id",
)
def labels_from_alerts(spark, sf):
    return P.labels_from_alerts(payments(spark, sf).select("txn_id"), alerts(spark, sf))


@query(
    "review_queue",
    with_ctes(PAYMENTS, ALERTS)
    + """SELECT alert_id, txn_id, a.fraud_score, a.status AS alert_status, investigator, merchant, CAST(amount AS DOUBLE) AS amount,
                p.status AS txn_status FROM alerts a JOIN payments p USING (txn_id) ORDER BY created_at DESC, alert_id DESC LIMIT 6""",
)
def review_queue(spark, sf):
    return _plain(P.review_queue(alerts(spark, sf), payments(spark, sf)).drop("created_at"))


@query(
    "review_state",
    with_ctes(PAYMENTS, ALERTS, _LATEST_ALERT)
    + f"""SELECT p.txn_id, a.status AS alert_status, p.status AS txn_status, {_LABEL} AS fraud_label
          FROM payments p LEFT JOIN latest a ON a.txn_id = p.txn_id""",
)
def review_state(spark, sf):
    pay, al = payments(spark, sf), alerts(spark, sf)
    return P.review_state(pay, al, P.labels_from_alerts(pay.select("txn_id"), al))


@query(
    "open_review_changes",
    with_ctes(*SCORED_CTES)
    + """SELECT 'alert-' || CAST(txn_id AS VARCHAR) AS alert_id, txn_id, 'FLAGGED' AS txn_status, 'OPEN' AS alert_status,
                fraud_score AS alert_score FROM scored WHERE decision = 'REVIEW'""",
)
def open_review_changes(spark, sf):
    status, opened = P.open_review(scored(spark, sf), F.current_timestamp(), digits=5)
    return opened.join(status.select("txn_id", F.col("status").alias("txn_status")), "txn_id").select(
        "alert_id", "txn_id", "txn_status", F.col("status").alias("alert_status"), F.col("fraud_score").alias("alert_score")
    )


@query(
    "resolve_review_changes",
    with_ctes(PAYMENTS, ALERTS)
    + """SELECT p.txn_id, CASE WHEN p.mcc IN ('7995', '4829') THEN 'DECLINED' ELSE 'SETTLED' END AS txn_status,
                CASE WHEN p.mcc IN ('7995', '4829') THEN 'ANALYST_CONFIRMED_FRAUD' END AS decline_reason,
                CASE WHEN a.alert_id IS NULL THEN NULL WHEN p.mcc IN ('7995', '4829') THEN 'CONFIRMED_FRAUD' ELSE 'FALSE_POSITIVE' END AS alert_status
         FROM payments p LEFT JOIN alerts a ON a.txn_id = p.txn_id AND a.status = 'OPEN'""",
)
def resolve_review_changes(spark, sf):
    decisions = payments(spark, sf).select(
        "txn_id", F.col("mcc").isin("7995", "4829").alias("confirm_fraud"), F.lit("analyst").alias("investigator")
    )
    moved, paid = P.resolve_review(decisions, alerts(spark, sf), F.current_timestamp())
    return (
        paid.withColumnRenamed("status", "txn_status")
        .join(moved.select("txn_id", F.col("status").alias("alert_status")), "txn_id", "left")
        .select("txn_id", "txn_status", "decline_reason", "alert_status")
    )


@query(
    "scored_newest_8",
    with_ctes(*SCORED_CTES, ALERTS, _LATEST_ALERT)
    + f"""SELECT account_id, CAST(s.rn AS INTEGER) AS rank, s.txn_id, merchant, amount_usd, txn_count_1h, amount_vs_avg_ratio, mcc_base_risk, s.fraud_score, decision,
                 CASE {_LABEL} WHEN true THEN 'CONFIRMED FRAUD' WHEN false THEN 'CLEARED' END AS analyst
          FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY initiated_at DESC, txn_id DESC) AS rn FROM scored) s
          JOIN (SELECT txn_id, merchant FROM payments) p USING (txn_id) LEFT JOIN latest a USING (txn_id) WHERE s.rn <= 8""",
)
def scored_newest_8(spark, sf):
    rows = P.labels_from_alerts(scored(spark, sf), alerts(spark, sf))
    return _plain(P.scored_newest(rows, payments(spark, sf)))


@query(
    "card_testing",
    with_ctes(PAYMENTS)
    + """SELECT account_id, txn_id, CAST(amount AS DOUBLE) AS amount, next_txn_id, CAST(next_amount AS DOUBLE) AS next_amount, gap_seconds FROM (
           SELECT t.account_id, t.txn_id, t.amount, l.txn_id AS next_txn_id, l.amount AS next_amount,
                  (epoch_us(l.initiated_at) - epoch_us(t.initiated_at)) / 1000000 AS gap_seconds,
                  row_number() OVER (PARTITION BY t.txn_id ORDER BY l.initiated_at, l.txn_id) AS rn
           FROM payments t JOIN payments l ON l.account_id = t.account_id AND l.initiated_at > t.initiated_at
            AND l.initiated_at <= t.initiated_at + INTERVAL '6 hours' AND l.amount >= 100 AND t.amount <= 10) WHERE rn = 1""",
)
def card_testing(spark, sf):
    return _plain(P.card_testing(payments(spark, sf), tiny=10, large=100, within_seconds=6 * 3600))


@query(
    "merchant_spread",
    with_ctes(*SCORED_CTES)
    + """SELECT merchant, CAST(count(*) AS BIGINT) AS blocked, CAST(count(DISTINCT s.account_id) AS BIGINT) AS accounts,
                CASE WHEN count(DISTINCT s.account_id) > 1 THEN 'merchant' ELSE 'card' END AS reading
         FROM scored s JOIN payments p USING (txn_id) WHERE decision = 'BLOCK' GROUP BY merchant""",
)
def merchant_spread(spark, sf):
    return P.merchant_spread(scored(spark, sf), payments(spark, sf))


@query("lr_train")
def lr_train(spark, sf):
    """Weights fitted on the analyst labels; one row per input."""
    rows = P.labels_from_alerts(features(spark, sf), alerts(spark, sf))
    model = P.train(rows)
    out = [(n, m, s, w, model.intercept) for n, m, s, w in zip(model.names, model.means, model.scales, model.weights)]
    return spark.createDataFrame(out, "feature string, mean double, scale double, weight double, intercept double")
