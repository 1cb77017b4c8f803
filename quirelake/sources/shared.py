"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, tag: str) -> str:
    """URI of a folder of its own below spark.checkpoint.dir; below a temporary folder that goes with the process where that is unset and everything runs in it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local[") and master != "local":
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="quirelake-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        root = f"file://{_OWN[app]}"
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and what is lost with an executor is read again."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds for what the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def cleaned(spark: SparkSession) -> AbstractContextManager[None]:
    """What the block runs gives its shuffle files back at its end, not when the driver happens to collect garbage."""
    return configured(spark, _CLEAN, "true")
