"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only on a local master may it be unset: then a local folder is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fenbrook-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_STAGED: set[str] = set()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: what several parts of a plan need is made once, and survives the loss
    of executors. All staged tables go with the application."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/fenbrook-staged/{spark.sparkContext.applicationId}"
    if folder not in _STAGED:
        _STAGED.add(folder)
        atexit.register(_forget, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the application may have ended already
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="fenbrook-code-"), "fenbrook_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
