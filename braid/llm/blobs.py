"""Exchange of large numbers of fixed-width records between tasks.

A record of a few integers costs a row more in headers than in content. Tasks therefore send
their records in arrays: one row per shard and batch, with one binary column per field. Spark
shuffles these rows by shard as any others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Records that a task gathers before it sends them, and rows whose texts it copies out of a batch at once.
GATHER = 300_000
ROWS = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts are held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def schema(fields: Sequence[str]) -> str:
    return ", ".join(["shard int", *[f"{f} binary" for f in fields]])


def pack(shard: np.ndarray, columns: Sequence[np.ndarray], fields: Sequence[str]) -> pa.RecordBatch:
    """One row per shard that has records."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, int)
    ends = np.append(starts[1:], len(shard)) if len(shard) else starts
    arrays = [pa.array(shard[starts].astype(np.int32), pa.int32())]
    for c in columns:
        c = np.ascontiguousarray(c[order])
        arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["shard", *fields])


def unpack(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """All records of a task, as one array per field."""
    parts: dict[str, list[np.ndarray]] = {f: [] for f in kinds}
    for batch in batches:
        for f, kind in kinds.items():
            parts[f] += [np.frombuffer(x, kind) for x in batch.column(f).to_pylist()]
    return {f: np.concatenate(p) if p else np.zeros(0, kinds[f]) for f, p in parts.items()}


def shards_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
