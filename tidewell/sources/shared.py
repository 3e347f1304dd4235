"""Folders that all machines of a session share, for what is written and read again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which all machines share; it goes when the application ends.

    Only where the session names none and runs on one machine (tests) is a temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = base or "file://" + tempfile.mkdtemp(prefix="tidewell-")
        _OWN[app] = f"{base.rstrip('/')}/tidewell-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the JVM is gone; the folder belongs to the ended application
        pass
