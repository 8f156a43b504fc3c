"""Separating hot keys from the rest, so that no task holds an unbounded group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this leaves the plain per-key plan.
HOT_KEY_ROWS = 200_000


def _same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_hot_{k}"]) for k in keys])


def split_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_KEY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys).

    There are at most ``rows / hot_rows`` hot keys, so the list of them may be
    broadcast whatever the size of the input. The count itself is pre-aggregated
    before its shuffle and reads only the key columns.
    """
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    )
    small = F.broadcast(hot)
    cold = df.join(small, _same_key(df, hot, keys), "left_anti")
    warm = df.join(small, _same_key(df, hot, keys), "left_semi")
    return cold, warm
