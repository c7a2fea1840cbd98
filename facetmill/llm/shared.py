"""Helpers that several operators share: the shared folder and written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

_OWN: dict[str, str] = {}
_MADE: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a temporary folder
    serves, but only in a local session: on a cluster other machines wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="facetmill-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; the file system removes it when the driver ends."""
    app = spark.sparkContext.applicationId
    own = f"{shared_folder(spark)}/facetmill/{app}"
    if own not in _MADE:
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _MADE.add(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    This cuts the lineage: a lost executor costs a read, not the work before it.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def step_of(bounds: list, below: Callable, leaf: Callable[[int], Column] = F.lit) -> Column:
    """What ``leaf`` gives for the number of ``bounds`` that aren't above the row: a binary search of nested ``when``.

    ``below(bound)`` is the condition that the row lies before the bound.
    """

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(below(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))
