"""Spark session and checkpoint-directory helpers.

Library code never creates its own session: every operator takes the
DataFrames it works on.  ``local_session`` exists for tests and the
benchmark; on a cluster the caller owns the session.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "foldframe") -> SparkSession:
    """Local session for tests / benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    Order: the directory already set on the SparkContext, then the
    ``spark.checkpoint.dir`` setting (the shared folder a cluster names).
    Only a local-mode session without either gets a fresh scratch folder;
    a cluster session without one is an error, because a machine-local
    folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="foldframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the checkpoint directory, deleted by ``delete_path`` or at exit."""
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    _scratch.pop(path, None)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df, tag: str = "table"):
    """Write a table to the shared folder and read it back: computed once, and nothing that has been
    written is computed again when an executor is lost."""
    path, schema = scratch_path(df.sparkSession, tag), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_scratch.items()):
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session is gone
            return
