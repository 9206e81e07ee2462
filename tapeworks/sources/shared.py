"""The folder for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local[*] session without that setting (tests) gets a folder of its own, which goes when the program ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _fallback[app], True)
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return "file://" + os.path.abspath(_fallback[app])
