"""Shared working folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
_to_remove: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local session without one uses its own `spark.local.dir`."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get(SETTING, None) or conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors share")
    folder = f"file://{conf.get('spark.local.dir', '/tmp').split(',')[0]}/larder-scratch"
    spark.conf.set(SETTING, folder)
    return folder


def app_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/larder-{spark.sparkContext.applicationId}"
    if path not in _to_remove:
        _to_remove.add(path)
        atexit.register(_remove_if_there, path)
    return path


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder not used before, below that of the application."""
    return f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by `new_dir`, in whatever store it lies."""
    _delete(spark.sparkContext._jvm, path, spark.sparkContext._jsc.hadoopConfiguration())


def clean(spark: SparkSession) -> None:
    """Delete everything the application has written so far; its results must not be read after that."""
    remove(spark, app_dir(spark))


def _delete(jvm, path: str, conf) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def _remove_if_there(path: str) -> None:
    """The gateway outlives `spark.stop()`; without it nothing can be removed, nor need be reported."""
    gateway = SparkContext._gateway
    if gateway is not None:
        try:
            _delete(gateway.jvm, path, gateway.jvm.org.apache.hadoop.conf.Configuration())
        except Exception:  # the machine is going down with the driver
            pass
