"""File sinks and sources: delimited text, parquet, versioned full refresh, run log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header line, line feeds, nulls as empty fields, quotes doubled."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("lineSep", "\n")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema, multi_line: bool = False) -> DataFrame:
    """Delimited text with a header. Fields with line breaks need ``multi_line``, which reads a file in one task."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


VERSION = "version"


def publish(spark: SparkSession, root: str, version: int) -> None:
    """Mark a version as complete; a version without its mark is never read."""
    spark.range(1).write.mode("overwrite").parquet(f"{root}.published/{VERSION}={version}")


def published(spark: SparkSession, root: str) -> int | None:
    """The newest version marked as complete."""
    try:
        marks = spark.read.parquet(f"{root}.published")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return marks.agg(F.max(VERSION)).first()[0]


def refresh(df: DataFrame, root: str, version: int) -> None:
    """Write a complete new version of a table beside the old ones. Readers keep the version they started with."""
    df.write.mode("overwrite").parquet(f"{root}/{VERSION}={version}")
    publish(df.sparkSession, root, version)


def current(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest complete version of a table written by ``refresh``; no other folder is read."""
    newest = published(spark, root)
    if newest is None:
        raise ValueError(f"no version of {root} is complete")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/{VERSION}={newest}")


# ------------------------------------------------------------------- run log

RUN = """kind STRING, label STRING, txn_id STRING, verdict STRING, score DOUBLE, kafka_offset BIGINT, total_ms DOUBLE,
         analytics_ms DOUBLE, hops MAP<STRING, DOUBLE>, features MAP<STRING, STRING>, at STRING"""


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records; lines that are not complete JSON are skipped."""
    return spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path)
