"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: The JVM never compiles a method of more than 8000 bytes of bytecode. Below this limit Spark
#: keeps whole-stage code; above it, it uses smaller methods instead.
METHOD_CONF, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def build_session(app: str = "fieldstream", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs expect.

    ``shuffle_partitions`` is only an upper starting point: AQE coalesces it. On a
    cluster leave it unset and let the cluster's own configuration decide.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(METHOD_CONF, str(METHOD_BYTES))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only when nothing is configured
    (a local test session) a temporary folder is made and recorded in its place.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    context_dir = spark.sparkContext.getCheckpointDir()
    if context_dir:
        return context_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="fieldstream-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created or removed."""
    return os.path.join(shared_dir(spark), f"fieldstream-{name}-{uuid.uuid4().hex[:12]}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and lets several
    consumers read columns of an expensive result without recomputing it.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_methods(df: DataFrame) -> DataFrame:
    """The rows as they are; from here on the session, whoever made it, generates no method
    that the JVM would only interpret."""
    conf = df.sparkSession.conf
    if int(conf.get(METHOD_CONF)) > METHOD_BYTES:
        conf.set(METHOD_CONF, str(METHOD_BYTES))
    return df


def epoch_us(df: DataFrame, column: str):
    """Microseconds since 1970 of a timestamp column, whatever the session time zone."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        return F.expr(
            f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores at least one partition per core.

    Small files come as one split however costly the work per row is. A table with enough
    splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
