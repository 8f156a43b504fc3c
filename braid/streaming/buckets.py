"""A keyed table in buckets of its key, with one version pointer per bucket.

    <root>/data/<batch>/bucket=<b>/   the rows of bucket b as batch wrote them
    <root>/heads/<batch>              for each bucket the batch whose folder holds it

A batch rewrites the buckets that its keys fall into and leaves the others as they are. It counts
once its heads have been written, in one step for all its buckets, so that readers never see a part
of a batch: a writer that dies between two buckets leaves folders that no head names, and the
batch that is run again replaces them. The heads of the last KEPT batches stay; folders that none
of them names are removed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.sources import shared

BUCKET = "bucket"
KEPT = 3


@dataclass(frozen=True)
class Buckets:
    """``count`` is fixed when the table is begun; about 128 MB of rows per bucket are a good size.

    The driver holds one number per bucket, not more.
    """

    root: str
    key: str
    count: int = 32

    def number(self, key: str | None = None) -> Column:
        """The bucket of a row; a null key has one, too."""
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.count)).cast("int")

    def batches(self, spark: SparkSession) -> list[int]:
        """The batches whose heads are kept, ascending."""
        return sorted(int(n) for n in shared.names(spark, f"{self.root}/heads") if n.isdigit())

    def heads(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The batch that holds each bucket, as of the newest batch (``before`` that one)."""
        known = [b for b in self.batches(spark) if before is None or b < before]
        if not known:
            return {}
        return {int(k): v for k, v in shared.get_json(spark, f"{self.root}/heads/{known[-1]}").items()}

    def paths(self, spark: SparkSession, numbers: Iterable[int] | None = None, before: int | None = None) -> list[str]:
        """Folders that hold these buckets; what is not listed here is not read."""
        heads = self.heads(spark, before)
        wanted = heads if numbers is None else [b for b in numbers if b in heads]
        return [f"{self.root}/data/{heads[b]}/{BUCKET}={b}" for b in sorted(wanted)]

    def read(self, spark: SparkSession, numbers: Iterable[int] | None = None, before: int | None = None) -> DataFrame | None:
        paths = self.paths(spark, numbers, before)
        return spark.read.parquet(*paths) if paths else None

    def touched(self, rows: DataFrame, *keys: str) -> list[int]:
        """Buckets of the rows' keys, at most ``count`` numbers."""
        numbers = [self.number(k) for k in keys or (self.key,)]
        return sorted(r[0] for r in rows.select(F.explode(F.array(*numbers)).alias("b")).distinct().collect())

    def write(self, rows: DataFrame, batch: int, numbers: list[int]) -> None:
        """Put ``rows`` in the place of all rows of these buckets; a bucket without rows becomes empty."""
        spark = rows.sparkSession
        at = f"{self.root}/data/{batch}"
        dealt = rows.withColumn(BUCKET, self.number()).repartition(max(1, min(len(numbers), self.count)), BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(at)
        self.publish(spark, batch, numbers)

    def publish(self, spark: SparkSession, batch: int, numbers: list[int]) -> None:
        """Point the buckets that the batch wrote to it, all at once."""
        written = {int(n.split("=")[1]) for n in shared.names(spark, f"{self.root}/data/{batch}") if n.startswith(f"{BUCKET}=")}
        heads = self.heads(spark, before=batch)
        for b in numbers:
            heads.pop(b, None)
            if b in written:
                heads[b] = batch
        for later in [b for b in self.batches(spark) if b >= batch]:
            shared.remove(spark, f"{self.root}/heads/{later}")
        shared.put_json(spark, f"{self.root}/heads/{batch}", heads)
        self._clean(spark)

    def _clean(self, spark: SparkSession) -> None:
        known = self.batches(spark)
        for old in known[:-KEPT]:
            gone = {(b, v) for b, v in self._named(spark, old)} - {x for k in known[-KEPT:] for x in self._named(spark, k)}
            for b, v in gone:
                shared.remove(spark, f"{self.root}/data/{v}/{BUCKET}={b}")
            shared.remove(spark, f"{self.root}/heads/{old}")

    def _named(self, spark: SparkSession, batch: int) -> list[tuple[int, int]]:
        return [(int(b), v) for b, v in shared.get_json(spark, f"{self.root}/heads/{batch}").items()]


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest ``order`` per key, with one shuffle; one of them where several have it."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*[F.col(c) for c in rest]))).alias("_r"))
    return best.select(key, *[f"_r.{c}" for c in rest]).select(*rows.columns)


def merge(table: Buckets, changes: DataFrame, batch: int, order: str) -> list[int]:
    """Merge changed rows into the buckets they fall into, and return these; deletes stay as rows.

    The greatest ``order`` of a key wins, so that changes that come again alter nothing. A batch that
    is run again starts from the heads before it.
    """
    numbers = table.touched(changes)
    if not numbers:
        return []
    held = table.read(changes.sparkSession, numbers, before=batch)
    both = changes if held is None else held.unionByName(changes)
    table.write(newest(both, table.key, order), batch, numbers)
    return numbers
