"""Session construction and shared scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "windowstate") -> SparkSession:
    """Local session for tests and benchmarks. On a cluster, build the session with the cluster's own settings;
    the library only relies on AQE, UTC and the RocksDB state store being available."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and derived tables.

    The cluster names it in ``spark.checkpoint.dir`` (the context then holds a per-application subfolder). Where it
    is unset, a local session, whose executors share the driver's disk, gets a fresh temp folder; any other master
    is an error, as each node would write to a disk of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(f"spark.checkpoint.dir is not set; master {sc.master} needs a folder that all nodes share")
    sc.setCheckpointDir(conf_dir or tempfile.mkdtemp(prefix="windowstate-ckpt-"))
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh, unique folder inside the shared checkpoint folder (never a machine-local temp folder
    unless the session itself names one)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/windowstate/{tag}-{uuid.uuid4().hex[:12]}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of derived data, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for the few places that need os-level access in local tests."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)
