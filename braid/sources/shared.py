"""Small files and removals in the shared folder, through the file system that Spark itself uses."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def put_json(spark: SparkSession, path: str, value: object) -> None:
    """Write a small file; it is there whole or not at all."""
    fs, at = _place(spark, path)
    _, part = _place(spark, f"{path}.{uuid.uuid4().hex[:8]}.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"could not write {path}")


def get_json(spark: SparkSession, path: str) -> object:
    fs, at = _place(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none where the folder is missing."""
    fs, at = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _place(spark, path)
    fs.delete(at, True)
