"""Ranks, top-k, latest-per-key and exact order statistics without single-task sorts."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braid.session import settle


def latest_by_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row with the greatest ``order`` per key; one of them where several have it."""
    return _edge_by_key(df, keys, order, F.max)


def first_by_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row with the smallest ``order`` per key; one of them where several have it."""
    return _edge_by_key(df, keys, order, F.min)


def _edge_by_key(df, keys, order, pick):
    """Only keys and order are aggregated; the wide rows meet the winners, and losers go there.

    A single order column of a fixed width is aggregated by hash. The join is on the keys
    alone, so that the last step, which settles ties, needs no further shuffle.
    """
    exprs = [F.col(o) if isinstance(o, str) else o for o in order]
    marked = df.withColumns({f"_o{i}": e for i, e in enumerate(exprs)})
    at = F.struct(*[F.col(f"_o{i}") for i in range(len(exprs))]) if len(exprs) > 1 else F.col("_o0")
    edge = marked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick(at).alias("_edge"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    won = marked.join(edge, reduce(lambda a, b: a & b, same)).filter(at.eqNullSafe(F.col("_edge")))
    rest = [c for c in df.columns if c not in keys]
    one = won.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_r")) if rest else won.select(*keys).distinct()
    return one.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


# Up to this k Spark keeps k rows per group and map task by itself (its windowGroupLimitThreshold).
PRUNED_K = 1_000
SALTS = 64


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per group, with their rank; ``order`` must be total.

    Spark keeps only ``k`` rows per group and map task before the shuffle
    (WindowGroupLimit). For a ``k`` beyond its threshold each group is first ranked in
    parts, so that no task holds a whole group; the result is the same.
    """
    number = F.row_number()
    if k > PRUNED_K:
        dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        best = dealt.withColumn("_at", number.over(W.partitionBy(*group, "_salt").orderBy(*order))).filter(F.col("_at") <= k)
        df = best.drop("_salt", "_at")
    return df.withColumn(rank, number.over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """Exact row_number over the whole set; ``order`` must end in a unique column.

    Rows are range-partitioned on the full order and written with their partition
    number, which fixes it. Each partition is then numbered by itself and shifted
    by the sizes of the partitions before it.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "rank")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a table of at most n rows.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(offsets), "_part").withColumn(rank, local + F.col("_off")).drop("_part", "_off")


# Values left when the search for a rank stops narrowing and sorts them in one task.
SORTABLE = 65_536
BINS = 1_024


def order_statistic(df: DataFrame, column: str, rank: Callable[[int], int]) -> tuple[int, float | None]:
    """(number of non-null values, the exact value at 0-based ``rank(n)``).

    The range of the values is cut into bins and only the bin that holds the rank is
    kept, again and again, until at most ``SORTABLE`` values are left. A range over
    many orders of magnitude is cut by exponents, one within a factor of four into equal
    parts, so that every round takes about ten bits of a double and seven rounds take all.
    Every round is one pre-aggregated count that returns a single row; its bounds
    are literals, so the next round skips data outside them while reading. A round parts
    the smallest from the greatest value, so the search ends; infinite values are counted
    beforehand.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    top = float("inf")
    finite = F.when(F.abs("v") < top, F.col("v"))
    n, under, over, lo, hi = values.agg(
        F.count("v"), F.count_if(F.col("v") == -top), F.count_if(F.col("v") == top), F.min(finite), F.max(finite)
    ).first()
    if not n:
        return 0, None
    k = rank(n)
    if k < under or k >= n - over:
        return n, -top if k < under else top
    values = values.filter(F.abs("v") < top)
    below, left = under, n - under - over
    while lo < hi and left > SORTABLE:
        place = _bin(lo, hi)
        if place is None:
            break
        inside = values.filter(F.col("v").between(lo, hi))
        bins = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        lo, hi, below, left = _holding_rank(bins, "b", below, k).select("lo", "hi", F.col("upto") - F.col("n"), "n").first()
    if lo < hi:
        counts = values.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        lo = _holding_rank(counts, "v", below, k).select("v").first()[0]
    return n, lo


def _magnitude(v: Column) -> Column:
    """Grows with a value, by its exponent: a double's least magnitude is at 1, and 0 at 0."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1075))


def _bin(lo: float, hi: float) -> Column | None:
    """The bin of ``v``, in the order of the values; None where the range can't be cut."""
    v = F.col("v")
    if lo > 0 and hi / 4 <= lo or hi < 0 and lo / 4 >= hi:
        width = (hi - lo) / BINS
        return None if width == 0 else F.least(F.floor((v - lo) / width), F.lit(BINS - 1))
    low, high = (math.copysign(math.log2(abs(x)) + 1075, x) if x else 0.0 for x in (lo, hi))
    at = F.floor((_magnitude(v) - low) / ((high - low) / BINS))
    return F.greatest(F.lit(0), F.least(at, F.lit(BINS - 1)))


def _holding_rank(counts: DataFrame, order: str, below: int, k: int) -> DataFrame:
    """The row of a bounded count table whose running total reaches rank ``k``."""
    running = F.sum("n").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("upto", running + F.lit(below)).filter(
        (F.lit(k) < F.col("upto")) & (F.lit(k) >= F.col("upto") - F.col("n"))
    )


def quantile_cont(df: DataFrame, column: str, q: float) -> float | None:
    """The exact continuous quantile, interpolated between the two nearest values; None without values."""
    n, v0 = order_statistic(df, column, lambda size: math.floor((size - 1) * q))
    if not n:
        return None
    pos = (n - 1) * q
    if pos == math.floor(pos):
        return v0
    # The next value is the same one when it repeats, otherwise the smallest greater value.
    v = F.col(column).cast("double")
    upto, above = df.agg(F.count_if(v <= F.lit(v0)), F.min(F.when(v > F.lit(v0), v))).first()
    v1 = v0 if upto > math.ceil(pos) else above
    return v0 + (v1 - v0) * (pos - math.floor(pos))


def upper_median(df: DataFrame, column: str) -> float | None:
    """The value at position n // 2 of the sorted values."""
    return order_statistic(df, column, lambda n: n // 2)[1]
