"""Governance queries: entitlements and the audit trail."""

from __future__ import annotations

from pyspark.sql import functions as F

from braid.catalog.base import query, with_ctes
from braid.catalog.payment_frames import ACCOUNTS, PAYMENTS, SCORED_CTES, accounts, payments, scored
from braid.plans import governance as G
from braid.session import read_table, run_dir

# Principals and the units they may see; one entitlement is repeated and one principal has none that exists.
GRANTS = [
    ("FRAUD_ANALYST_US", "RETAIL_US"),
    ("FRAUD_ANALYST_US", "RETAIL_US"),
    ("FRAUD_ANALYST_EU", "RETAIL_EU"),
    ("FRAUD_LEAD", "RETAIL_US"),
    ("FRAUD_LEAD", "RETAIL_EU"),
    ("VISITOR", "WHOLESALE"),
]


def entitlements(spark):
    return spark.createDataFrame(GRANTS, "db_user string, business_unit string")


def units(spark, sf):
    return G.business_units(accounts(spark, sf), {"RETAIL_US": F.col("c_mktsegment") == "BUILDING"}, "RETAIL_EU")


_UNITS = "units AS (SELECT account_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'RETAIL_US' ELSE 'RETAIL_EU' END AS business_unit FROM accounts)"
_GRANTS = "grants(db_user, business_unit) AS (VALUES " + ", ".join(f"('{u}', '{b}')" for u, b in dict.fromkeys(GRANTS)) + ")"


@query(
    "account_units",
    with_ctes(ACCOUNTS, _UNITS) + "SELECT * FROM units",
)
def account_units(spark, sf):
    return units(spark, sf)


@query(
    "entitled_rows",
    with_ctes(*SCORED_CTES, _UNITS, _GRANTS)
    + """SELECT db_user, s.txn_id, merchant, s.fraud_score, s.decision, u.business_unit FROM scored s JOIN payments p USING (txn_id)
         JOIN units u ON u.account_id = s.account_id JOIN grants g ON g.business_unit = u.business_unit""",
)
def entitled_rows(spark, sf):
    rows = scored(spark, sf).join(payments(spark, sf).select("txn_id", "merchant"), "txn_id")
    return G.entitled_by_user(rows, units(spark, sf), entitlements(spark)).select(
        "db_user", "txn_id", "merchant", "fraud_score", "decision", "business_unit"
    )


@query(
    "entitled_customers",
    with_ctes(ACCOUNTS, _UNITS)
    + "SELECT account_id, c_name, c_acctbal, business_unit FROM accounts JOIN units USING (account_id) WHERE business_unit = 'RETAIL_US'",
)
def entitled_customers(spark, sf):
    rows = G.entitled(accounts(spark, sf), units(spark, sf), entitlements(spark), "FRAUD_ANALYST_US")
    return rows.select("account_id", "c_name", "c_acctbal", "business_unit")


@query(
    "entitled_session",
    with_ctes(ACCOUNTS, _UNITS)
    + "SELECT account_id, c_name, business_unit FROM accounts JOIN units USING (account_id) WHERE business_unit = 'RETAIL_US'",
)
def entitled_session(spark, sf):
    """What the session's own user may see, by a grant of its own among those of others."""
    own = spark.range(1).select(F.current_user().alias("db_user"), F.lit("RETAIL_US").alias("business_unit"))
    grants = entitlements(spark).select("db_user", "business_unit").union(own)
    return G.entitled(accounts(spark, sf), units(spark, sf), grants).select("account_id", "c_name", "business_unit")


@query(
    "entitlement_check",
    with_ctes(PAYMENTS, ACCOUNTS, _UNITS, _GRANTS)
    + """SELECT g.db_user, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, CAST(count(n) AS BIGINT) AS units FROM grants g
         LEFT JOIN (SELECT business_unit, count(*) AS n FROM payments JOIN units USING (account_id) GROUP BY 1) x USING (business_unit) GROUP BY 1""",
)
def entitlement_check(spark, sf):
    return G.entitlement_check(payments(spark, sf), units(spark, sf), entitlements(spark))


def calls(spark, sf):
    """One call per conversation turn, asked by its role."""
    return read_table(spark, sf, "conversations").select(
        F.col("turn").alias("asked_at"),
        F.upper("role").alias("db_user"),
        F.col("text").alias("question"),
        F.concat(F.lit("SELECT * FROM conversations WHERE text = "), "text").alias("sql_text"),
        F.length("text").alias("rows_returned"),
        (F.length("text") / 8).alias("duration_ms"),
    )


_AUDIT = """audit AS (SELECT turn AS asked_at, upper(role) AS db_user, substr(text, 1, 500) AS question,
  substr('SELECT * FROM conversations WHERE text = ' || text, 1, 2000) AS sql_text, CAST(length(text) AS BIGINT) AS rows_returned,
  CAST(CAST(round(length(text) / 8.0 + 0.0001, 1) AS DECIMAL(10, 1)) AS DOUBLE) AS duration_ms FROM conversations)"""


def stored_audit(spark, sf):
    path = run_dir(spark, "audit")
    G.append_audit(calls(spark, sf), path)
    return spark.read.parquet(path).withColumn("duration_ms", F.col("duration_ms").cast("double"))


@query("audit_records", with_ctes(_AUDIT) + "SELECT * FROM audit")
def audit_records(spark, sf):
    return stored_audit(spark, sf)


@query("own_audit", with_ctes(_AUDIT) + "SELECT * FROM audit WHERE db_user = 'ASSISTANT'")
def own_audit(spark, sf):
    return G.own_audit(stored_audit(spark, sf), "ASSISTANT")


@query(
    "audit_trail",
    with_ctes(_AUDIT) + "SELECT * FROM audit ORDER BY asked_at DESC, db_user, sql_text LIMIT 12",
)
def audit_trail(spark, sf):
    return G.audit_trail(stored_audit(spark, sf))


@query(
    "session_view",
    "SELECT event_id AS session_id, user_id AS user_name, event_type AS client, epoch_us(ts) AS login_time, 'OPEN' AS status FROM events",
)
def session_view(spark, sf):
    sessions = read_table(spark, sf, "events").select(
        F.col("event_id").alias("session_id"), F.col("user_id").alias("user_name"), F.col("event_type").alias("client"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("login_time"), F.lit("OPEN").alias("status"),
    )
    return G.session_view(sessions)
