"""Shared intermediate storage: tables that cut lineage and survive lost executors.

Everything is written under the folder that the cluster names in
``spark.checkpoint.dir``.  Only where that setting is absent on a single
machine (a local master, as in tests) a temporary folder is chosen and set;
a cluster without the setting is an error, as its executors share no folder.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it (same path, or installed)."""
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (root, known.get("PYTHONPATH")) if x)


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one is set where a local master names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _store(spark, path)
    return store.exists(target)


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds."""
    store, target = _store(spark, path)
    return store.getFileStatus(target).getModificationTime()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and all in it, if it is there."""
    if spark.sparkContext._jvm is None or spark.sparkContext._jsc is None:
        return
    store, target = _store(spark, path)
    store.delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # at exit the JVM may already be gone
        pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared root, removed when the driver ends."""
    path = f"{shared_root(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    for made in _scopes:
        made.append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving every intermediate table that was made inside: results must have been written or read by then.

    Without it they stay until they are released or the driver ends, as lazy results still read them.
    """
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            _remove_quietly(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread (lineage is cut)."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return located(spark.read.schema(df.schema).parquet(path), path)


def located(df: DataFrame, path: str) -> DataFrame:
    """The table, knowing its folder, so that it can be released before the driver ends."""
    df._lodestone_path = path
    return df


def release(*tables: DataFrame) -> None:
    """Remove the folders of intermediate tables that nothing will read any more."""
    for t in tables:
        if path := getattr(t, "_lodestone_path", None):
            remove(t.sparkSession, path)
