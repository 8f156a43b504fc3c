"""Session settings and shared-folder lookup."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "braid", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the plans are written for.

    On a cluster the master and the partition count come from spark-submit; the
    two arguments exist for tests and for the benchmark.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


# Bytes that a byte of a parquet file of repeated values takes as rows in memory: 5 to 15 for the benchmark tables.
UNPACKED = 10


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, whose size is estimated by its rows and not by its compressed file.

    A side of a join that is small on disk only would be broadcast, which takes the driver's memory.
    """
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD = 64


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with few splits out to the waiting task slots.

    One file with one row group is one task however long its texts are. A table of
    many splits, as on a cluster, is returned as it is.
    """
    slots = min(df.sparkSession.sparkContext.defaultParallelism, SPREAD)
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def table_version(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """Changes whenever a file of the tables does; for artefacts that are kept while it stays."""
    parts = []
    for name in names:
        files = read_table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        seen = files.distinct().agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()[0]
        parts.append(f"{sf_dir}/{name}@{seen}")
    return " ".join(parts)


_OWN: dict[str, str] = {}


def _own_dir(spark: SparkSession) -> str:
    """A folder for one local application, removed when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="braid-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: the one named in spark.checkpoint.dir.

    A local master without that setting, as in tests, gets a folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return _own_dir(spark)


def run_dir(spark: SparkSession, label: str) -> str:
    """A new sub-folder of the shared folder for one run of one job."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to a table in the shared folder and go on from there.

    The lineage ends at files that outlive any executor, and whatever follows reads
    the rows instead of computing them again.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
