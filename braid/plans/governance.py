"""Row filters by entitlement, and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUESTION_CHARS, SQL_CHARS = 500, 2_000


def business_units(accounts: DataFrame, special: dict[str, Column], default: str) -> DataFrame:
    """Assign every account to a unit: the first condition that holds, else the default."""
    unit = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in special.items()], F.lit(default))
    return accounts.select("account_id", unit.alias("business_unit"))


def entitled(rows: DataFrame, units: DataFrame, entitlements: DataFrame, principal: str | Column | None = None) -> DataFrame:
    """Rows whose account lies in a unit the principal may see, each once.

    Without a principal the session's own user is taken. A repeated entitlement
    adds no rows. Units are few and hold many rows each: adaptive execution sends the
    grants to the rows while they are small, and splits hot units otherwise.
    """
    who = F.current_user() if principal is None else (F.lit(principal) if isinstance(principal, str) else principal)
    mine = entitlements.filter(F.col("db_user") == who).select("business_unit").distinct()
    return rows.join(units, "account_id").join(mine, "business_unit", "left_semi")


def entitled_by_user(rows: DataFrame, units: DataFrame, entitlements: DataFrame) -> DataFrame:
    """What each principal sees, with the principal as a column."""
    grants = entitlements.select("db_user", "business_unit").distinct()
    return rows.join(units, "account_id").join(grants, "business_unit")


def entitlement_check(rows: DataFrame, units: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Rows and units visible to each principal; a principal without rows is listed with zero.

    Rows are counted per unit first, so the join meets one row per unit.
    """
    per_unit = rows.join(units, "account_id").groupBy("business_unit").agg(F.count(F.lit(1)).alias("n"))
    grants = entitlements.select("db_user", "business_unit").distinct()
    return (
        grants.join(per_unit, "business_unit", "left")
        .groupBy("db_user")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("n").alias("units"))
    )


def audit_records(calls: DataFrame) -> DataFrame:
    """Audit rows: question and statement cut to the stored length, duration to a tenth of a millisecond."""
    return calls.select(
        "asked_at",
        "db_user",
        F.substring(F.coalesce("question", F.lit("")), 1, QUESTION_CHARS).alias("question"),
        F.substring(F.coalesce("sql_text", F.lit("")), 1, SQL_CHARS).alias("sql_text"),
        F.col("rows_returned").cast("bigint").alias("rows_returned"),
        F.round(F.col("duration_ms"), 1).cast("decimal(10,1)").alias("duration_ms"),
    )


def append_audit(calls: DataFrame, path: str) -> None:
    audit_records(calls).write.mode("append").parquet(path)


def own_audit(audit: DataFrame, principal: str | Column | None = None) -> DataFrame:
    who = F.current_user() if principal is None else (F.lit(principal) if isinstance(principal, str) else principal)
    return audit.filter(F.col("db_user") == who)


def audit_trail(audit: DataFrame, limit: int = 12) -> DataFrame:
    """The whole trail, newest first."""
    return audit.orderBy(F.desc("asked_at"), "db_user", "sql_text").limit(limit)


def session_view(sessions: DataFrame) -> DataFrame:
    """Sessions newest first: id, user, client, login time, status."""
    return sessions.select("session_id", "user_name", "client", "login_time", "status").orderBy(F.desc("login_time"), "session_id")
