"""Sessions, and the package on executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: dict[str, str] = {}


def session(name: str = "facetmill", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that results depend on."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the session's ``spark.checkpoint.dir``, or in a local session a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="facetmill-scratch-")
        atexit.register(shutil.rmtree, _SCRATCH[app], True)
    return "file://" + _SCRATCH[app]


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores where it comes in fewer pieces, as a small table in one file does.

    For stages that cost far more than moving their rows. Large tables have pieces enough and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which may not have it on their path; once a session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="facetmill-package-")
    atexit.register(shutil.rmtree, folder, True)
    sources = os.path.join(folder, "tree")
    shutil.copytree(root, os.path.join(sources, root.name), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, root.name), "zip", sources))
