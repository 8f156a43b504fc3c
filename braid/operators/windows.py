"""Strictly-past windows over time, per key, with a plan for hot keys.

"Strictly past" means the frame ``[t - span, t)``: the row itself and every row
with the same timestamp are outside. A window is the difference of two prefix
totals, which is linear in the rows; a moving frame would be computed anew for
every row. A key that holds a large share of the table would put all its rows in
one task, so hot keys are cut into short time buckets, and a prefix total is one
inside a bucket and the sum of all earlier buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from braid.operators.skew import HOT_KEY_ROWS, split_hot

MICROS = 1_000_000
BUCKET_SECONDS = 60

HOUR = 3_600
DAY = 24 * HOUR


@dataclass(frozen=True)
class PastWindow:
    """One output column: ``agg`` is "count" or "sum" over the last ``seconds``."""

    name: str
    seconds: int
    agg: str


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _check_exact(df: DataFrame, value: str) -> None:
    kind = df.schema[value].dataType
    if not isinstance(kind, (T.DecimalType, T.IntegralType)):
        raise ValueError(f"{value} must be decimal or integral so that totals are exact, not {kind.simpleString()}")


def _past_cold(df, key, row_id, value, windows):
    """Each window as the difference of two prefix totals: up to the row, and up to its span before.

    A growing frame is linear in the rows of a key, whatever the number of rows in a window.
    A row stands for itself once and, without counting, for the begin of each of its spans;
    its totals come together again inside the partition of its key, without a shuffle.
    """
    spans = sorted({w.seconds for w in windows})
    own = F.col("_lag") == 0
    points = (
        df.withColumn("_lag", F.explode(F.array(*[F.lit(s).cast("long") for s in [0, *spans]])))
        .withColumn("_pt", F.col("_us") - F.col("_lag") * MICROS)
        .select(key, row_id, "_lag", "_pt", F.when(own, F.struct(*df.columns)).alias("_row"), F.when(own, F.col(value)).alias("_v"))
    )
    frame = W.partitionBy(key).orderBy("_pt").rangeBetween(W.unboundedPreceding, -1)
    points = points.withColumn("_n", F.sum(F.when(own, 1).otherwise(0)).over(frame)).withColumn("_s", F.sum("_v").over(frame))
    at = lambda column, lag: F.coalesce(F.max(F.when(F.col("_lag") == lag, F.col(column))), F.lit(0))
    totals = [(at(c, 0) - at(c, w.seconds)).alias(w.name) for w in windows for c in ["_n" if w.agg == "count" else "_s"]]
    rows = points.groupBy(key, row_id).agg(F.first("_row", ignorenulls=True).alias("_row"), *totals)
    return rows.select("_row.*", *[w.name for w in windows])


def _past_hot(df, key, value, row_id, windows, bucket_seconds):
    width = bucket_seconds * MICROS
    spans = sorted({w.seconds for w in windows})
    points = (
        df.select(key, row_id, "_us", F.col(value).alias("_v"))
        .withColumn("_lag", F.explode(F.array(*[F.lit(s).cast("long") for s in [0, *spans]])))
        .withColumn("_pt", F.col("_us") - F.col("_lag") * MICROS)
        .withColumn("_b", F.floor(F.col("_pt") / width))
        .withColumn("_is", F.when(F.col("_lag") == 0, F.lit(1)).otherwise(F.lit(0)))
        .withColumn("_v", F.when(F.col("_lag") == 0, F.col("_v")))
    )
    inside = W.partitionBy(key, "_b").orderBy("_pt").rangeBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        points.groupBy(key, "_b")
        .agg(F.sum("_is").alias("_bn"), F.sum("_v").alias("_bs"))
        .select(
            key,
            "_b",
            F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_cn"),
            F.coalesce(F.sum("_bs").over(earlier), F.lit(0)).alias("_cs"),
        )
    )
    prefix = (
        points.withColumn("_in", F.coalesce(F.sum("_is").over(inside), F.lit(0)))
        .withColumn("_is_", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .join(totals, [key, "_b"])
        .select(
            row_id,
            "_lag",
            (F.col("_in") + F.col("_cn")).alias("_pn"),
            (F.col("_is_") + F.col("_cs")).alias("_ps"),
        )
    )
    aggs = []
    for w in windows:
        col = "_pn" if w.agg == "count" else "_ps"
        at = F.max(F.when(F.col("_lag") == 0, F.col(col)))
        before = F.max(F.when(F.col("_lag") == w.seconds, F.col(col)))
        aggs.append((at - before).alias(w.name))
    return df.join(prefix.groupBy(row_id).agg(*aggs), row_id)


def past_features(
    df: DataFrame,
    key: str,
    ts: str,
    value: str,
    row_id: str,
    windows: list[PastWindow],
    unseen: dict[str, tuple[str, int]] | None = None,
    hot_rows: int | None = HOT_KEY_ROWS,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Add one column per window and one flag per ``unseen`` entry.

    ``unseen`` is {flag: (column, seconds)}: true when the column's value did not
    occur for the key in ``[t - seconds, t)``. ``value`` must be decimal or
    integral and ``row_id`` unique. The rows are split into ordinary and hot keys
    once; the ordinary ones are shuffled once, by key, for all windows and flags.
    ``hot_rows`` None says that there are too few rows for a hot key, which halves the plan.
    """
    unseen = unseen or {}
    if windows:
        _check_exact(df, value)
    timed = df.withColumn("_us", micros(ts))
    cold, hot = (timed, None) if hot_rows is None else split_hot(timed, [key], hot_rows)
    if windows:
        cold = _past_cold(cold, key, row_id, value, windows)
    cold = _unseen(cold, key, unseen, None)
    wide = {w.name: _total_type(df, value, w) for w in windows}
    out = [*[F.col(c) for c in df.columns], *[F.col(n).cast(t).alias(n) for n, t in wide.items()], *[F.col(f) for f in unseen]]
    if hot is None:
        return cold.select(*out)
    if windows:
        hot = _past_hot(hot, key, value, row_id, windows, bucket_seconds)
    hot = _unseen(hot, key, unseen, bucket_seconds)
    return cold.select(*out).unionByName(hot.select(*out))


def _total_type(df: DataFrame, value: str, window: PastWindow):
    kind = df.schema[value].dataType
    if window.agg == "sum" and isinstance(kind, T.DecimalType):
        return T.DecimalType(38, kind.scale)
    return T.LongType()


def _unseen(rows: DataFrame, key: str, unseen: dict[str, tuple[str, int]], bucket_seconds: int | None) -> DataFrame:
    for flag, (column, seconds) in unseen.items():
        fresh = F.col("_prev").isNull() | (F.col("_prev") < F.col("_us") - seconds * MICROS)
        rows = previous_time(rows, [key, column], bucket_seconds).withColumn(flag, fresh).drop("_prev")
    return rows


def previous_time(df: DataFrame, keys: list[str], bucket_seconds: int | None = None) -> DataFrame:
    """Add ``_prev``: the latest ``_us`` before this row's among rows with equal keys.

    With ``bucket_seconds`` the keys may be hot: a task then sees one key for one
    bucket, plus one row per bucket for the carry.
    """
    if bucket_seconds is None:
        frame = W.partitionBy(*keys).orderBy("_us").rangeBetween(W.unboundedPreceding, -1)
        return df.withColumn("_prev", F.max("_us").over(frame))
    cut = df.withColumn("_b", F.floor(F.col("_us") / (bucket_seconds * MICROS)))
    inside = W.partitionBy(*keys, "_b").orderBy("_us").rangeBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = cut.groupBy(*keys, "_b").agg(F.max("_us").alias("_bm")).select(*keys, "_b", F.max("_bm").over(earlier).alias("_carry"))
    joined = cut.withColumn("_in", F.max("_us").over(inside))
    carried = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), "_carry")
    on = [joined[k].eqNullSafe(carried[f"_k_{k}"]) for k in keys] + [joined["_b"] == carried["_kb"]]
    return (
        joined.join(carried, on)
        .withColumn("_prev", F.coalesce("_in", "_carry"))
        .drop("_in", "_carry", "_b", "_kb", *[f"_k_{k}" for k in keys])
    )


def next_within(
    df: DataFrame,
    key: str,
    ts: str,
    probe,
    target,
    payload: list[str],
    seconds: int,
) -> DataFrame:
    """Pair every probe row with the first later target row of the same key at most ``seconds`` away.

    Rows are cut into buckets of the gap's length and target rows are copied into
    the bucket before theirs, so each probe finds its target inside one bucket.
    Returns the probe's columns, ``next_<payload>`` and ``gap_seconds``.
    """
    width = seconds * MICROS
    marked = (
        df.withColumn("_us", micros(ts))
        .withColumn("_p", probe)
        .withColumn("_t", target)
        .filter("_p or _t")
        .withColumn("_home", F.floor(F.col("_us") / width))
        .withColumn("_b", F.explode(F.when(F.col("_t"), F.array(F.col("_home") - 1, F.col("_home"))).otherwise(F.array("_home"))))
    )
    # Latest first, so that what lies ahead is a growing frame.
    after = W.partitionBy(key, "_b").orderBy(F.desc("_us")).rangeBetween(W.unboundedPreceding, -1)
    nxt = F.min(F.when(F.col("_t"), F.struct("_us", *payload))).over(after)
    return (
        marked.withColumn("_next", nxt)
        .filter(F.col("_p") & (F.col("_b") == F.col("_home")) & (F.col("_next._us") - F.col("_us") <= width))
        .select(
            *df.columns,
            *[F.col(f"_next.{c}").alias(f"next_{c}") for c in payload],
            ((F.col("_next._us") - F.col("_us")) / MICROS).alias("gap_seconds"),
        )
    )
