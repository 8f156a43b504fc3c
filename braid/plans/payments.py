"""Payment features, linear scoring, explanation and review."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braid.functions.scalars import (
    analyst_outcome, decision, is_night, is_weekend, label_from_alert, mcc_risk,
)
from braid.operators.ranking import latest_by_key, top_k_per_group
from braid.operators.rules import lookup
from braid.operators.skew import HOT_KEY_ROWS
from braid.operators.windows import DAY, HOUR, PastWindow, next_within, past_features

# Model inputs, in model order, with the label shown for each (fixed values).
FEATURES = {
    "amount_usd": "Amount",
    "txn_count_1h": "Transactions in the last hour",
    "txn_count_24h": "Transactions in the last 24 hours",
    "amount_sum_1h": "Spend in the last hour",
    "amount_sum_24h": "Spend in the last 24 hours",
    "amount_vs_avg_ratio": "Size vs her normal spend",
    "is_cross_border": "Outside her home country",
    "is_new_country_30d": "Country never seen before",
    "is_new_device_30d": "Device never seen before",
    "is_night_txn": "Middle of the night",
    "is_weekend_txn": "Weekend",
    "mcc_base_risk": "Merchant category risk",
}

# Mean spend assumed for an account without history.
FALLBACK_MEAN = 30.0

_WINDOWS = [
    PastWindow("txn_count_1h", HOUR, "count"),
    PastWindow("txn_count_24h", DAY, "count"),
    PastWindow("amount_sum_1h", HOUR, "sum"),
    PastWindow("amount_sum_24h", DAY, "sum"),
    PastWindow("_n30", 30 * DAY, "count"),
    PastWindow("_s30", 30 * DAY, "sum"),
]


_UNSEEN = {"is_new_device_30d": ("device_id", 30 * DAY), "is_new_country_30d": ("country", 30 * DAY)}


def _past(payments: DataFrame, windows, unseen, hot_rows: int | None) -> DataFrame:
    return past_features(payments, "account_id", "initiated_at", "amount", "txn_id", windows, unseen, hot_rows)


def velocity(payments: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Counts and totals of the last hour, 24 hours and 30 days before each payment."""
    return _past(payments, _WINDOWS, {}, hot_rows)


def novelty(payments: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Device and country not seen on the account in the 30 days before."""
    return _past(payments, [], _UNSEEN, hot_rows)


def ratio_to_mean(amount: Column, total: Column, n: Column, fallback: float | None = FALLBACK_MEAN) -> Column:
    mean = F.nullif(total.cast("double") / F.nullif(n, F.lit(0)), F.lit(0.0))
    return amount.cast("double") / F.coalesce(mean, F.lit(fallback).cast("double"))


def features(payments: DataFrame, accounts: DataFrame, fallback: float | None = FALLBACK_MEAN, hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """The feature table: one row per payment whose account is known.

    ``payments``: txn_id, account_id, initiated_at, amount (decimal), mcc, device_id, country.
    ``accounts``: account_id, home_country.
    """
    with_history = _past(payments, _WINDOWS, _UNSEEN, hot_rows)
    joined = with_history.join(accounts.select("account_id", "home_country"), "account_id")
    ts = F.col("initiated_at").cast("timestamp")
    return joined.select(
        "txn_id",
        "account_id",
        "initiated_at",
        F.col("amount").alias("amount_usd"),
        "txn_count_1h",
        "txn_count_24h",
        "amount_sum_1h",
        "amount_sum_24h",
        ratio_to_mean(F.col("amount"), F.col("_s30"), F.col("_n30"), fallback).alias("amount_vs_avg_ratio"),
        (F.col("country") != F.col("home_country")).alias("is_cross_border"),
        "is_new_country_30d",
        "is_new_device_30d",
        is_night(ts).alias("is_night_txn"),
        is_weekend(ts).alias("is_weekend_txn"),
        mcc_risk(F.col("mcc")).alias("mcc_base_risk"),
    )


# ------------------------------------------------------------------- scoring


@dataclass(frozen=True)
class LinearModel:
    """Logistic regression on standardised inputs."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def scaled(self, values: dict[str, Column]) -> list[Column]:
        """Weight times standardised value of each input; a missing value counts as zero."""
        return [
            F.lit(w) * ((F.coalesce(values[n].cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s))
            for n, m, s, w in zip(self.names, self.means, self.scales, self.weights)
        ]

    def logit(self, values: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a + b, self.scaled(values), F.lit(self.intercept))

    def score(self, values: dict[str, Column]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit(values)))


# A small model for demonstrations; real weights come from ``train``.
DEMO_MODEL = LinearModel(
    names=tuple(FEATURES),
    means=(50.0, 0.2, 0.3, 1.0, 12.0, 1.0, 0.8, 0.2, 0.8, 0.3, 0.28, 0.33),
    scales=(50.0, 0.5, 0.8, 10.0, 40.0, 1.1, 0.4, 0.4, 0.4, 0.46, 0.45, 0.28),
    weights=(0.9, 0.4, 0.3, 0.2, 0.3, 1.1, 0.3, 0.5, 0.4, 0.1, 0.05, 0.8),
    intercept=-0.9,
)


def _columns(model: LinearModel) -> dict[str, Column]:
    return {n: F.col(n) for n in model.names}


def score(rows: DataFrame, model: LinearModel, digits: int = 5) -> DataFrame:
    """Add ``fraud_score`` and ``decision``."""
    return rows.withColumn("fraud_score", F.round(model.score(_columns(model)), digits)).withColumn(
        "decision", decision(F.col("fraud_score"))
    )


def train(labelled: DataFrame, label: str = "fraud_label", max_iter: int = 50, reg: float = 0.0) -> LinearModel:
    """Fit the logistic regression with class-balanced weights n / (2 n_class)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    names = list(FEATURES)
    rows = labelled.filter(F.col(label).isNotNull()).select(
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names],
        F.col(label).cast("double").alias("label"),
    )
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    n, pos = sizes["n"], sizes["pos"] or 0.0
    if not 0 < pos < n:
        raise ValueError("training needs rows of both classes")
    weighted = rows.withColumn("w", F.when(F.col("label") == 1.0, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))
    stages = [
        VectorAssembler(inputCols=names, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="x", labelCol="label", weightCol="w", maxIter=max_iter, regParam=reg, standardization=False
        ),
    ]
    fitted = Pipeline(stages=stages).fit(weighted)
    scaler, model = fitted.stages[1], fitted.stages[2]
    return LinearModel(
        names=tuple(names),
        means=tuple(float(x) for x in scaler.mean.toArray()),
        scales=tuple(float(x) or 1.0 for x in scaler.std.toArray()),
        weights=tuple(float(x) for x in model.coefficients.toArray()),
        intercept=float(model.intercept),
    )


# --------------------------------------------------------------- explanation


def _contributions(model: LinearModel, values: dict[str, Column]) -> Column:
    """Array of (feature, label, value, contribution), largest magnitude first."""
    items = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                F.lit(FEATURES.get(n, n)).alias("label"),
                values[n].cast("double").alias("value"),
                c.alias("contribution"),
                F.lit(i).alias("pos"),
            )
            for i, (n, c) in enumerate(zip(model.names, model.scaled(values)))
        ]
    )
    keyed = F.transform(items, lambda x: F.struct((-F.abs(F.round(x["contribution"], 9))).alias("k"), x["pos"].alias("p"), x.alias("item")))
    return F.transform(F.sort_array(keyed), lambda x: x["item"])


def attribution(rows: DataFrame, model: LinearModel, keep: list[str] = ["txn_id"]) -> DataFrame:
    """One row per payment and feature: exact contribution to the logit, ranked by magnitude."""
    listed = rows.select(*keep, F.posexplode(_contributions(model, _columns(model))).alias("pos", "i"))
    return listed.select(
        *keep,
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("i.feature").alias("feature"),
        F.col("i.label").alias("label"),
        F.col("i.value").alias("value"),
        F.col("i.contribution").alias("contribution"),
    )


# Yes/no drivers are only worth showing when the flag is set.
_FLAG_DRIVERS = ("is_new_country_30d", "is_new_device_30d", "is_cross_border", "is_night_txn")


def _drivers(model: LinearModel, values: dict[str, Column]) -> Column:
    return F.filter(
        _contributions(model, values),
        lambda x: (x["contribution"] > 0) & (~x["feature"].isin(*_FLAG_DRIVERS) | (x["value"] == 1.0)),
    )


def driver_shares(rows: DataFrame, model: LinearModel, k: int = 4, keep: list[str] = ["txn_id"]) -> DataFrame:
    """The ``k`` largest positive drivers with their share of the total positive contribution."""
    total = F.aggregate("d", F.lit(0.0), lambda acc, x: acc + x["contribution"])
    listed = (
        rows.select(*keep, _drivers(model, _columns(model)).alias("d"))
        .withColumn("t", total)
        .select(*keep, "t", F.posexplode(F.slice("d", 1, k)).alias("pos", "i"))
    )
    return listed.select(
        *keep,
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("i.feature").alias("feature"),
        F.col("i.label").alias("label"),
        (F.lit(100.0) * F.col("i.contribution") / F.col("t")).alias("share_pct"),
    )


# Recommended step for each driver (fixed values). Two drivers share one step.
ACTIONS = {
    "is_new_device_30d": "Verify on her own phone",
    "is_new_country_30d": "Freeze the card abroad",
    "is_cross_border": "Freeze the card abroad",
    "mcc_base_risk": "Flag the merchant",
    "amount_vs_avg_ratio": "Call the customer on file",
    "txn_count_1h": "Lower the hourly card limit",
}
DEFAULT_ACTION = "Open a fraud case"
MAX_ACTIONS = 3


def next_actions(rows: DataFrame, model: LinearModel, keep: list[str] = ["txn_id"]) -> DataFrame:
    """Up to three distinct steps in driver order; a case is opened when there are fewer."""
    titles = F.filter(
        F.transform(_drivers(model, _columns(model)), lambda x: lookup(x["feature"], ACTIONS)), lambda t: t.isNotNull()
    )
    picked = F.slice(F.array_distinct(titles), 1, MAX_ACTIONS)
    steps = F.when(F.size("p") < MAX_ACTIONS, F.concat("p", F.array(F.lit(DEFAULT_ACTION)))).otherwise(F.col("p"))
    listed = rows.select(*keep, picked.alias("p")).select(*keep, F.posexplode(steps).alias("pos", "action"))
    return listed.select(*keep, (F.col("pos") + 1).cast("int").alias("rank"), "action")


def kpi_flags(rows: DataFrame) -> DataFrame:
    """Add the three "hot" flags of the panel."""
    return (
        rows.withColumn("hot_ratio", F.col("amount_vs_avg_ratio") >= 5)
        .withColumn("hot_count", F.col("txn_count_1h") >= 3)
        .withColumn("hot_risk", F.col("mcc_base_risk") >= 0.5)
    )


# ------------------------------------------------------------------ what-if

# Amounts tried, and the profiles in order of preference (fixed values).
GRID = [*range(10, 100, 5), *range(100, 1000, 25), *range(1000, 9001, 250)]
PROFILES = [
    ("Summit Wire Transfer", "4829", 0.60),
    ("PixelStore Digital", "5816", 0.30),
    ("Metro Electronics", "5045", 0.20),
]
BAND = (0.32, 0.68)
TARGET = 0.5


def history_at(payments: DataFrame, now: Column) -> DataFrame:
    """Per account: counts and totals before ``now``, all in one scan."""
    ts = F.col("initiated_at").cast("timestamp")
    past = payments.withColumn("_now", now.cast("timestamp")).filter(ts < F.col("_now"))

    def since(text):
        return ts >= F.col("_now") - F.expr(f"INTERVAL {text}")

    return past.groupBy("account_id").agg(
        F.max("_now").alias("now"),
        F.count_if(since("1 HOUR")).alias("c1h"),
        F.coalesce(F.sum(F.when(since("1 HOUR"), F.col("amount"))), F.lit(0)).alias("s1h"),
        F.count_if(since("24 HOUR")).alias("c24h"),
        F.coalesce(F.sum(F.when(since("24 HOUR"), F.col("amount"))), F.lit(0)).alias("s24h"),
        F.count_if(since("30 DAY")).alias("c30d"),
        F.sum(F.when(since("30 DAY"), F.col("amount"))).alias("s30d"),
    )


def borderline_payment(history: DataFrame, model: LinearModel, target: float = TARGET, band: tuple[float, float] = BAND) -> DataFrame:
    """Per account the payment the model is least sure about; accounts without one have no row.

    The first profile with a candidate inside the band wins; within it the score
    nearest the target, then the smaller amount. Candidates live in an array on
    the account's row, so nothing is multiplied out between tasks.
    """
    mean = F.coalesce(F.nullif(F.col("s30d").cast("double") / F.nullif(F.col("c30d"), F.lit(0)), F.lit(0.0)), F.lit(FALLBACK_MEAN))
    no = F.lit(0.0)

    def candidate(profile: int, risk: float):
        def build(amount: Column) -> Column:
            values = {
                "amount_usd": amount,
                "txn_count_1h": F.col("c1h"),
                "txn_count_24h": F.col("c24h"),
                "amount_sum_1h": F.col("s1h"),
                "amount_sum_24h": F.col("s24h"),
                "amount_vs_avg_ratio": amount / F.col("_mean"),
                "is_cross_border": no,
                "is_new_country_30d": no,
                "is_new_device_30d": no,
                "is_night_txn": F.col("_night"),
                "is_weekend_txn": F.col("_weekend"),
                "mcc_base_risk": F.lit(risk),
            }
            s = F.round(model.score(values), 5)
            return F.struct(
                F.lit(profile).alias("profile"),
                F.round(F.abs(s - F.lit(target)), 5).alias("distance"),
                amount.alias("amount"),
                s.alias("expected"),
            )

        return build

    prepared = (
        history.withColumn("_mean", mean)
        .withColumn("_night", is_night(F.col("now")).cast("double"))
        .withColumn("_weekend", is_weekend(F.col("now")).cast("double"))
        .withColumn("_grid", F.array(*[F.lit(float(a)) for a in GRID]))
    )
    lo, hi = band
    best = F.coalesce(
        *[
            F.array_min(
                F.filter(F.transform("_grid", candidate(i, risk)), lambda c: (c["expected"] >= lo) & (c["expected"] <= hi))
            )
            for i, (_, _, risk) in enumerate(PROFILES)
        ]
    )
    names = F.array(*[F.lit(p[0]) for p in PROFILES])
    codes = F.array(*[F.lit(p[1]) for p in PROFILES])
    return (
        prepared.withColumn("b", best)
        .filter("b is not null")
        .select(
            "account_id",
            names[F.col("b.profile")].alias("merchant"),
            codes[F.col("b.profile")].alias("mcc"),
            F.col("b.amount").alias("amount"),
            F.col("b.expected").alias("expected"),
        )
    )


# ------------------------------------------------------------------- review

ALERT_TYPE = "MODEL_REVIEW"
ALERT_NOTE = "Score in the review band: held for an analyst"


def open_review(scored: DataFrame, at: Column, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(payment status changes, alerts to insert) for the payments in the review band."""
    held = scored.filter(F.col("decision") == "REVIEW")
    status = held.select("txn_id", F.lit("FLAGGED").alias("status"), at.alias("updated_at"))
    alerts = held.select(
        F.concat(F.lit("alert-"), F.col("txn_id").cast("string")).alias("alert_id"),
        "txn_id",
        F.lit(ALERT_TYPE).alias("alert_type"),
        F.round("fraud_score", digits).alias("fraud_score"),
        F.lit("OPEN").alias("status"),
        F.lit(ALERT_NOTE).alias("notes"),
        at.alias("created_at"),
    )
    return status, alerts


def resolve_review(decisions: DataFrame, alerts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(alert changes, payment changes) for analyst decisions; only open alerts move.

    ``decisions``: txn_id, confirm_fraud, investigator. The payment follows the
    decision whether or not an alert was open.
    """
    fraud = F.col("confirm_fraud")
    moved = alerts.filter(F.col("status") == "OPEN").select("alert_id", "txn_id").join(decisions, "txn_id")
    alert_changes = moved.select(
        "alert_id",
        "txn_id",
        F.when(fraud, "CONFIRMED_FRAUD").otherwise("FALSE_POSITIVE").alias("status"),
        "investigator",
        F.when(fraud, "Analyst confirmed fraud").otherwise("Analyst cleared the payment").alias("notes"),
        at.alias("resolved_at"),
    )
    payment_changes = decisions.select(
        "txn_id",
        F.when(fraud, "DECLINED").otherwise("SETTLED").alias("status"),
        F.when(fraud, "ANALYST_CONFIRMED_FRAUD").alias("decline_reason"),
        at.alias("updated_at"),
    )
    return alert_changes, payment_changes


def labels_from_alerts(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Add ``fraud_label`` from the latest alert of each payment."""
    latest = latest_by_key(alerts.select("txn_id", "status", "created_at", "alert_id"), ["txn_id"], ["created_at", "alert_id"])
    return rows.join(latest.select("txn_id", label_from_alert(F.col("status")).alias("fraud_label")), "txn_id", "left")


def review_queue(alerts: DataFrame, payments: DataFrame, limit: int | None = 6) -> DataFrame:
    """Alerts with their payment, newest first."""
    joined = alerts.select(
        "alert_id", "txn_id", "fraud_score", F.col("status").alias("alert_status"), "investigator", "created_at"
    ).join(payments.select("txn_id", "merchant", "amount", F.col("status").alias("txn_status")), "txn_id")
    ordered = joined.orderBy(F.desc("created_at"), F.desc("alert_id"))
    return ordered.limit(limit) if limit else ordered


def review_state(payments: DataFrame, alerts: DataFrame, labelled: DataFrame) -> DataFrame:
    """Alert status, payment status and label of each payment."""
    latest = latest_by_key(alerts.select("txn_id", "status", "created_at", "alert_id"), ["txn_id"], ["created_at", "alert_id"])
    return (
        payments.select("txn_id", F.col("status").alias("txn_status"))
        .join(latest.select("txn_id", F.col("status").alias("alert_status")), "txn_id", "left")
        .join(labelled.select("txn_id", "fraud_label"), "txn_id", "left")
        .select("txn_id", "alert_status", "txn_status", "fraud_label")
    )


def scored_newest(scored: DataFrame, payments: DataFrame, limit: int = 8, account=None) -> DataFrame:
    """The newest scored payments of each account (or of one) with decision and analyst outcome."""
    rows = scored.filter(F.col("fraud_score").isNotNull())
    if account is not None:
        rows = rows.filter(F.col("account_id") == account)
    newest = top_k_per_group(rows, ["account_id"], [F.desc("initiated_at"), F.desc("txn_id")], limit)
    return newest.join(payments.select("txn_id", "merchant"), "txn_id").select(
        "account_id", "rank", "txn_id", "merchant", "amount_usd", "txn_count_1h", "amount_vs_avg_ratio", "mcc_base_risk",
        "fraud_score", "decision", analyst_outcome(F.col("fraud_label")).alias("analyst"),
    )


# ------------------------------------------------------------ investigations


def card_testing(payments: DataFrame, tiny: float, large: float, within_seconds: int) -> DataFrame:
    """A tiny charge followed on the same account by a large one within the gap."""
    pairs = next_within(
        payments.select("txn_id", "account_id", "initiated_at", "amount"),
        "account_id",
        "initiated_at",
        F.col("amount") <= F.lit(tiny),
        F.col("amount") >= F.lit(large),
        ["txn_id", "amount"],
        within_seconds,
    )
    return pairs.select("account_id", "txn_id", "amount", "next_txn_id", "next_amount", "gap_seconds")


def merchant_spread(scored: DataFrame, payments: DataFrame) -> DataFrame:
    """Blocked payments and distinct accounts per merchant: many accounts point at the merchant, one at a card."""
    blocked = scored.filter(F.col("decision") == "BLOCK").select("txn_id", "account_id")
    return (
        blocked.join(payments.select("txn_id", "merchant"), "txn_id")
        .groupBy("merchant")
        .agg(F.count(F.lit(1)).alias("blocked"), F.count_distinct("account_id").alias("accounts"))
        .withColumn("reading", F.when(F.col("accounts") > 1, "merchant").otherwise("card"))
    )


PAYMENT_SCHEMA = T.StructType(
    [
        T.StructField("txn_id", T.LongType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("initiated_at", T.TimestampType()),
        T.StructField("amount", T.DecimalType(12, 2)),
        T.StructField("mcc", T.StringType()),
        T.StructField("device_id", T.LongType()),
        T.StructField("country", T.LongType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("reference_id", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
