"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm.words import shingle_set
from braid.session import read_table

K = 128
_WIDTH = 6
MAX_RANGES = 20_000
_SPACE = float(1 << 48)


def sketch(text: bytes | None, k: int = K) -> str:
    """The k smallest 48-bit shingle hashes of a text, ascending, big-endian, in base64.

    A null text or a text without words has the empty sketch. Equal texts have equal
    sketches, and so have texts that differ in white space or in the case of A-Z only.
    """
    return encode(np.unique(shingle_set(text) >> np.uint64(16))[:k])


def encode(hashes: np.ndarray) -> str:
    wide = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return base64.b64encode(np.ascontiguousarray(wide[:, 8 - _WIDTH :]).tobytes()).decode()


def decode(fingerprint: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint or ""), np.uint8).reshape(-1, _WIDTH)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - _WIDTH :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(fingerprints: Iterable[str | None], k: int = K) -> str:
    """The sketch of the union of the parts' shingle sets."""
    parts = [decode(f) for f in fingerprints]
    return encode(np.unique(np.concatenate(parts))[:k]) if parts else ""


def distinct_shingles(fingerprint: str | None, k: int = K) -> float:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    hashes = decode(fingerprint)
    return float(len(hashes)) if len(hashes) < k else (k - 1) * _SPACE / float(hashes[-1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 if only one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.union1d(a, b)[:k]
    return float((np.isin(low, a) & np.isin(low, b)).sum() / len(low))


def containment(a: str | None, b: str | None, k: int = K) -> float:
    """Estimated share of a's shingles that b holds; 1 if a is empty."""
    if not a:
        return 1.0
    near = resemblance(decode(a), decode(b), k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return min(1.0, near * (na + nb) / (1 + near) / na)


def fingerprint_column(text: Column, k: int = K) -> Column:
    """The sketch of a text column, for use in select()."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sketch(t.encode() if t else b"", k))

    return run(text)


def merged(rows: DataFrame, keys: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Only the k smallest hashes of a key leave a task, and a key's hashes are cut to k after
    every shuffle, so that a hot key costs k rows per task.
    """

    @F.pandas_udf("string")
    def union(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: merge(p, k))

    deal = F.pmod(F.spark_partition_id(), F.lit(64))
    half = rows.groupBy(*keys, deal.alias("_deal")).agg(F.collect_set(fingerprint).alias("parts"))
    half = half.select(*keys, union("parts").alias(fingerprint))
    return half.groupBy(*keys).agg(F.collect_set(fingerprint).alias("parts")).select(*keys, union("parts").alias(fingerprint))


def _numbers(values: list[int]) -> Column:
    """A constant array, as one literal however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def in_order(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """(bucket, tail, doc_id, text): ranges of doc_id, each ended by the first row of the next.

    The borders are quantiles of doc_id; only they and the smallest doc_id of each range, a
    few numbers per range, reach the driver. Each text is shuffled once, and the first text
    of a range a second time, to the range before. The first text of all also ends the last
    range. Null ids come first; equal ids are in order of text.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    cuts = ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    cuts = sorted({int(c) for c in cuts})
    # The number of borders at or below the id, found by halving.
    bucket = F.lit(0)
    if cuts:
        steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
        border = _numbers(cuts)
        bucket = F.aggregate(
            _numbers(steps).cast("array<int>"),
            F.lit(0),
            lambda at, s: F.when(
                (at + s <= len(cuts)) & (F.get(border, at + s - 1) <= F.col("doc_id")), at + s
            ).otherwise(at),
        )
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(bucket))
    first = dict(rows.groupBy("bucket").agg(F.min("doc_id")).collect())
    if not first:
        return rows.select("bucket", F.lit(False).alias("tail"), "doc_id", "text")
    # By bucket from -1 on: its smallest id, and the last bucket before it that has rows.
    full = sorted(first)
    before = dict(zip(full, [full[-1], *full], strict=False))
    every = range(-1, len(cuts) + 1)
    low = F.get(_numbers([first[b] if first.get(b) is not None else 0 for b in every]), F.col("bucket") + 1)
    to = F.get(_numbers([before.get(b, -1) for b in every]), F.col("bucket") + 1)
    # Several rows may hold a range's smallest id; all go, and the reader takes the first.
    to = F.when(F.col("doc_id").isNull() | (F.col("doc_id") == low), to.cast("int"))
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(False).alias("tail"))
    copy = F.struct(to.alias("bucket"), F.lit(True).alias("tail"))
    places = F.filter(F.array(own, copy), lambda p: p["bucket"].isNotNull())
    return rows.select(F.explode(places).alias("p"), "doc_id", "text").select("p.bucket", "p.tail", "doc_id", "text")


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 4, k: int = K) -> DataFrame:
    """Per document its sketch, that of an edited text, and likenesses.

    The edited text ends in the beginning of the next document: its last floor(n/share) code
    points are replaced by as many (or all) code points of the next document by doc_id; after
    the last comes the first. A single document is its own next one. Null texts count as empty
    and stay; rows with equal ids follow in order of text; null ids come first; further
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs, doc_id, text, min(4 * parts, MAX_RANGES))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for bucket, tail, doc, body in zip(*columns, strict=True):
                mine = (doc, body, sketch(body.encode(), k))
                if held and held[0] == bucket and not held[1]:
                    out.append(_edited(*held[2], *mine, share, k))
                held = (bucket, tail, mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.mapInArrow(run, _PAIRS)


def _edited(doc, body: str, own: str, _, following: str, next_own: str, share: int, k: int) -> tuple:
    cut = len(body) // share
    edited = body[: len(body) - cut] + following[:cut]
    changed = sketch(edited.encode(), k)
    mine = decode(own)
    return (
        doc,
        len(body),
        hashlib.sha256(edited.encode()).hexdigest(),
        own,
        changed,
        resemblance(mine, decode(changed), k),
        resemblance(mine, decode(next_own), k),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(read_table(spark, sf_dir, "documents"))
