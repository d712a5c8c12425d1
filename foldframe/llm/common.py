"""Shared helpers of the training-data operators: table access and scratch tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from foldframe.session import ensure_checkpoint_dir

#: ASCII white space; words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"

_live: set = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder of the session (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    try:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:  # noqa: BLE001  the session may already be gone
        pass


def sheltered(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with all columns but ``own`` under names that no operator uses, so that no input column can clash with an
    operator's; ``out.select(*inner.columns).toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*[c if c in own else f"x__{i}" for i, c in enumerate(docs.columns)])


class Scratch:
    """Written tables of one operator call, in the shared folder.

    ``write`` cuts the lineage: the rows are committed as Parquet by Spark's writer, so a lost
    executor costs nothing that has been written.  ``drop`` removes a table that no later step
    reads.  The tables under the returned DataFrame stay until ``clear`` or the end of the process.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, []
        _live.add(self)

    def path(self, name: str) -> str:
        p = scratch_path(self.spark, f"{self.tag}-{name}")
        self.paths.append(p)
        return p

    def write(self, df: DataFrame, name: str) -> DataFrame:
        p = self.path(name)
        schema = df.schema
        df.write.parquet(p)
        out = self.spark.read.schema(schema).parquet(p)
        out._scratch_path = p
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            p = df._scratch_path
            delete_path(self.spark, p)
            self.paths.remove(p)

    def clear(self) -> None:
        for p in self.paths:
            delete_path(self.spark, p)
        self.paths = []
        _live.discard(self)


@atexit.register
def _clear_all() -> None:
    for s in list(_live):
        s.clear()
