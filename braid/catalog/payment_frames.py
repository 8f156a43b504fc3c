"""The payments domain read from the benchmark tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.operators.rules import lookup
from braid.plans import payments as P
from braid.session import read_table

# Merchant category that stands for each event type.
EVENT_MCC = {"signup": "5812", "click": "5411", "view": "5045", "purchase": "4829", "error": "7995"}


def payments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (
        read_table(spark, sf, "events")
        .withColumn("_k", k)
        .select(
            F.col("event_id").alias("txn_id"),
            F.col("user_id").alias("account_id"),
            F.col("ts").cast("timestamp").alias("initiated_at"),
            F.col("value").cast("decimal(12,2)").alias("amount"),
            lookup(F.col("event_type"), EVENT_MCC).alias("mcc"),
            F.col("_k").alias("device_id"),
            (F.col("_k") % 7).alias("country"),
            F.concat_ws("-", "event_type", (F.col("_k") % 20).cast("string")).alias("merchant"),
            F.concat(F.upper("event_type"), F.lit("-"), F.col("event_id").cast("string")).alias("reference_id"),
            F.lit("SETTLED").alias("status"),
        )
    )


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"),
        (F.col("c_nationkey") % 7).cast("bigint").alias("home_country"),
        "c_name",
        "c_nationkey",
        "c_acctbal",
        "c_mktsegment",
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    return P.features(payments(spark, sf), accounts(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return P.score(features(spark, sf), P.DEMO_MODEL)


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Analyst work: a labelled document is the alert on the payment with its number."""
    labels, docs = read_table(spark, sf, "labels"), read_table(spark, sf, "documents")
    status = (
        F.when(F.col("toxic") == 1, "CONFIRMED_FRAUD").when(F.col("quality") == 1, "FALSE_POSITIVE").otherwise("OPEN")
    )
    return labels.join(docs.select("doc_id", "source", "n_chars"), "doc_id").select(
        F.concat(F.lit("alert-"), F.col("doc_id").cast("string")).alias("alert_id"),
        F.col("doc_id").alias("txn_id"),
        F.round(F.col("quality") * 0.25 + 0.4, 4).alias("fraud_score"),
        status.alias("status"),
        F.when(status != "OPEN", F.col("source")).alias("investigator"),
        F.col("n_chars").alias("created_at"),
    )


_MCC_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_MCC.items()) + " END"

PAYMENTS = f"""payments AS (
  SELECT event_id AS txn_id, user_id AS account_id, ts AS initiated_at, CAST(value AS DECIMAL(12,2)) AS amount,
         {_MCC_CASE} AS mcc, k AS device_id, k % 7 AS country,
         event_type || '-' || CAST(k % 20 AS VARCHAR) AS merchant,
         upper(event_type) || '-' || CAST(event_id AS VARCHAR) AS reference_id, 'SETTLED' AS status
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""

ACCOUNTS = """accounts AS (
  SELECT c_custkey AS account_id, CAST(c_nationkey % 7 AS BIGINT) AS home_country, c_name, c_nationkey, c_acctbal, c_mktsegment
  FROM customer)"""


def past(expr: str, span: str, by: str = "account_id") -> str:
    return (
        f"{expr} OVER (PARTITION BY {by} ORDER BY initiated_at "
        f"RANGE BETWEEN INTERVAL '{span}' PRECEDING AND INTERVAL '1 microsecond' PRECEDING)"
    )


VELOCITY = f"""velocity AS (
  SELECT *, {past("count(*)", "1 hour")} AS txn_count_1h,
         {past("count(*)", "24 hours")} AS txn_count_24h,
         coalesce({past("sum(amount)", "1 hour")}, 0) AS amount_sum_1h,
         coalesce({past("sum(amount)", "24 hours")}, 0) AS amount_sum_24h,
         {past("count(*)", "30 days")} AS n30,
         coalesce({past("sum(amount)", "30 days")}, 0) AS s30
  FROM payments)"""

NOVELTY = f"""novelty AS (
  SELECT txn_id, {past("count(*)", "30 days", "account_id, device_id")} = 0 AS is_new_device_30d,
         {past("count(*)", "30 days", "account_id, country")} = 0 AS is_new_country_30d
  FROM payments)"""

# Base risks as the documentation of the feature lists them.
MCC_CASE = "CASE mcc WHEN '5812' THEN 0.05 WHEN '5411' THEN 0.05 WHEN '5045' THEN 0.2 WHEN '4829' THEN 0.6 WHEN '7995' THEN 0.75 ELSE 0 END"

FEATURES = f"""features AS (
  SELECT v.txn_id, v.account_id, v.initiated_at, CAST(v.amount AS DOUBLE) AS amount_usd,
         CAST(v.txn_count_1h AS BIGINT) AS txn_count_1h, CAST(v.txn_count_24h AS BIGINT) AS txn_count_24h,
         CAST(v.amount_sum_1h AS DOUBLE) AS amount_sum_1h, CAST(v.amount_sum_24h AS DOUBLE) AS amount_sum_24h,
         CAST(v.amount AS DOUBLE)
           / coalesce(nullif(CAST(v.s30 AS DOUBLE) / CAST(nullif(v.n30, 0) AS DOUBLE), 0.0), 30.0) AS amount_vs_avg_ratio,
         v.country <> a.home_country AS is_cross_border, n.is_new_country_30d, n.is_new_device_30d,
         (hour(v.initiated_at) >= 22 OR hour(v.initiated_at) < 6) AS is_night_txn,
         dayofweek(v.initiated_at) IN (0, 6) AS is_weekend_txn,
         CAST({MCC_CASE} AS DOUBLE) AS mcc_base_risk
  FROM velocity v JOIN novelty n USING (txn_id) JOIN accounts a USING (account_id))"""


def scaled_sql(i: int) -> str:
    m = P.DEMO_MODEL
    return f"(CAST({m.weights[i]} AS DOUBLE) * ((CAST({m.names[i]} AS DOUBLE) - CAST({m.means[i]} AS DOUBLE)) / CAST({m.scales[i]} AS DOUBLE)))"


LOGIT = f"CAST({P.DEMO_MODEL.intercept} AS DOUBLE)"
for _i in range(len(P.DEMO_MODEL.names)):
    LOGIT = f"({LOGIT} + {scaled_sql(_i)})"

SCORED = f"""scored AS (
  SELECT *, CASE WHEN fraud_score >= 0.70 THEN 'BLOCK' WHEN fraud_score >= 0.30 THEN 'REVIEW' ELSE 'APPROVE' END AS decision
  FROM (SELECT *, round(1.0 / (1.0 + exp(-{LOGIT})), 5) AS fraud_score FROM features))"""

ALERTS = """alerts AS (
  SELECT 'alert-' || CAST(l.doc_id AS VARCHAR) AS alert_id, l.doc_id AS txn_id,
         round(quality * 0.25 + 0.4, 4) AS fraud_score,
         CASE WHEN toxic = 1 THEN 'CONFIRMED_FRAUD' WHEN quality = 1 THEN 'FALSE_POSITIVE' ELSE 'OPEN' END AS status,
         CASE WHEN toxic = 1 OR quality = 1 THEN d.source END AS investigator, d.n_chars AS created_at
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""

SCORED_CTES = (PAYMENTS, ACCOUNTS, VELOCITY, NOVELTY, FEATURES, SCORED)
