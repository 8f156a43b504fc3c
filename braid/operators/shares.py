"""Distributions, shares, labelled counts, set differences and data checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(df: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))


def distribution_distinct(df: DataFrame, by: list[str], what: str, n: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(what).alias(n))


def with_share(counts: DataFrame, n: str = "n", pct: str = "pct", digits: int = 1) -> DataFrame:
    """Percent of the total, the total being a scalar subquery instead of an unpartitioned window."""
    total = counts.agg(F.sum(n).alias("t")).scalar()
    return counts.withColumn(pct, F.round(F.lit(100.0) * F.col(n) / total, digits))


def labelled_counts(parts: dict[str, DataFrame], label: str = "fact", n: str = "n") -> DataFrame:
    """One row per labelled relation with its row count."""
    rows = [df.agg(F.count(F.lit(1)).alias(n)).select(F.lit(name).alias(label), n) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def conditional_counts(df: DataFrame, parts: dict[str, Column], label: str = "fact", n: str = "n") -> DataFrame:
    """Labelled counts of several conditions in one pass over ``df``."""
    names = list(parts)
    one = df.agg(*[F.count_if(parts[name]).alias(f"c{i}") for i, name in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(name).alias(label), F.col(f"c{i}").alias(n)) for i, name in enumerate(names)])
    return one.select(F.inline(pairs))


def linked_gap(items: DataFrame, links: DataFrame, key: str, by: list[str], names: tuple[str, str, str, str]) -> DataFrame:
    """Items per group, how many have a link, how many have none and the percentage missing.

    Links are reduced to distinct keys first, so an item with several links is
    one item.
    """
    total, have, none, pct = names
    flagged = items.join(links.select(key).distinct().withColumn("_l", F.lit(1)), key, "left")
    missing = F.col(total) - F.col(have)
    counted = flagged.groupBy(*by).agg(F.count(F.lit(1)).alias(total), F.count("_l").alias(have))
    return counted.withColumn(none, missing).withColumn(
        pct, F.when(F.col(total) > 0, F.round(F.lit(100.0) * missing / F.when(F.col(total) > 0, F.col(total)), 1))
    )


def linked_gap_per_link(items: DataFrame, links: DataFrame, key: str, by: list[str], names: tuple[str, str, str, str]) -> DataFrame:
    """The same figures counted after the join, one row per link: inflated by items with several links."""
    total, have, none, pct = names
    joined = items.join(links.select(key, F.col(key).alias("_k")), key, "left")
    missing = F.col(total) - F.col(have)
    counted = joined.groupBy(*by).agg(F.count(F.lit(1)).alias(total), F.count_distinct("_k").alias(have))
    return counted.withColumn(none, missing).withColumn(pct, F.round(F.lit(100.0) * missing / F.col(total), 1))


def term_set_diff(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Compare two array columns as sets: shared, only A, only B, identical."""
    sa, sb = F.sort_array(F.array_distinct(a)), F.sort_array(F.array_distinct(b))
    return pairs.select(
        *[c for c in pairs.columns if c not in (a, b)],
        F.sort_array(F.array_intersect(sa, sb)).alias("shared"),
        F.sort_array(F.array_except(sa, sb)).alias("only_a"),
        F.sort_array(F.array_except(sb, sa)).alias("only_b"),
        (sa == sb).alias("identical"),
    )


def checks(spark, parts: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """Data checks as rows: (check, passed, observed).

    Every part is (name, relation, observed aggregate, condition on ``observed``).
    """
    rows = [
        df.agg(observed.cast("double").alias("observed")).select(
            F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), "observed"
        )
        for name, df, observed, passed in parts
    ]
    return reduce(DataFrame.unionByName, rows)
