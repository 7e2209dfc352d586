"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a local master gets a temporary folder (tests);
    any other master is refused, since executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("dialoom.scratch.dir", "")
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="dialoom-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
        spark.conf.set("dialoom.scratch.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _ROOTS.add(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def close(spark: SparkSession) -> int:
    """Removes all intermediate tables that this process has written, and says how many folders these were.

    Results read them lazily: call this when the results have been written.
    """
    n = len(_ROOTS)
    while _ROOTS:
        remove(spark, _ROOTS.pop())
    return n


class Scratch:
    """The intermediate tables of one run, written as Parquet in the shared folder and read again.

    A written table cuts the lineage: a lost executor costs at most the tasks of
    the step that was running.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = fresh_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.read(df.schema, name)

    def read(self, schema, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names:
            remove(self.spark, self.path(name))
