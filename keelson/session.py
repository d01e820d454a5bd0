"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# SQL settings that may be changed on a running session.  AQE splits the hot
# partitions of a shuffle join; forcing it keeps the split even when a later
# operator would have liked the un-split partitioning.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # keyed state of the streams; changes travel as logs, not as whole snapshots
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "keelson", cpus: str | None = None, shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", os.environ.get("KEELSON_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # the supplied tables have one row group each
        .config("keelson.read.partitions", cpus)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.  Only a local session
    (tests, bench), whose tasks all run on this machine, may go without: it gets a fresh folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keelson-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, which the file system removes when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a result that several later branches read to a table in the shared folder.

    The lineage ends at the files, so lost executors cost nothing but a re-read, and each
    branch reads only the columns it needs.  The table goes when the driver ends."""
    spark = df.sparkSession
    path = path or fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
