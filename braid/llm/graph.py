"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.session import settle


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Large-star and small-star rounds: every round moves the larger neighbours of a node to
    its smallest neighbour, so the number of rounds grows with the logarithm of a path's
    length. Minima are combined before the shuffle; each round is written to the shared
    folder, so a lost executor costs one round. Loops, repeated edges and edges with a null
    end add nothing. Without edges the result is empty.
    """
    a, b = F.col(src), F.col(dst)
    kind = edges.schema[src].dataType
    edges = edges.filter(a.isNotNull() & b.isNotNull()).select(a.cast(kind).alias("u"), b.cast(kind).alias("v"))
    # A node's row to itself keeps it in the result and changes nothing else.
    ends = F.explode(F.array(F.col("u"), F.col("v")))
    now = settle(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .union(edges.select(ends.alias("u")).select("u", F.col("u").alias("v")))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = mark
        now = settle(_small_star(_large_star(now)), "edges")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).filter("u != v"))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    moved = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(edges.filter("u = v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.filter("u != v").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    kept = low.select("u", F.col("low").alias("v"))
    return moved.union(kept).union(edges.filter("u = v")).distinct()
