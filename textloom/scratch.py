"""Intermediate tables in the folder that the whole cluster shares.

``materialize`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and reads it
back: the lineage ends there, so a lost executor never forces earlier steps to run again,
and columns that a later step does not need are not read.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str] | None] = []


def base_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only in local mode where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that the driver and all executors share")
    mine = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(mine, exist_ok=True)
    return mine


def new_path(spark: SparkSession, label: str = "t") -> str:
    path = f"{base_dir(spark).rstrip('/')}/textloom/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames; only once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "_textloom_path", None):
            _delete(df.sparkSession, path)


def written() -> int:
    """How many tables have been written so far; a mark for ``release_between``."""
    return len(_written)


def release_between(start: int, stop: int) -> None:
    """Delete the tables written between two marks; only once nothing reads them any more."""
    for i in range(start, stop):
        if _written[i] is not None:
            _delete(*_written[i])
            _written[i] = None


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in filter(None, _written):
        local = path.removeprefix("file://")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)
        else:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the session may be gone at exit
                return
