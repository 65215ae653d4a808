"""Silver and gold tables of a source folder, built once and read by every query that needs them."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fenbrook.operators.gold import save_bucketed
from fenbrook.sources.shared import remove, shared_dir
from fenbrook.sources.versions import VersionStore

_STORES: dict[tuple[str, str], tuple[str, VersionStore]] = {}


def _signature(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the source files: tables that were built from others are not read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), fs.getContentSummary(f.getPath()).getLength(), f.getModificationTime()) for f in fs.listStatus(p))
    return hashlib.sha256(repr(found).encode()).hexdigest()[:16]


def store(spark: SparkSession, folder: str) -> VersionStore:
    """The store of the tables of ``folder``, in the shared folder and for this application."""
    at, now = (spark.sparkContext.applicationId, folder), _signature(spark, folder)
    if at not in _STORES or _STORES[at][0] != now:
        name = hashlib.sha256(repr((at, now)).encode()).hexdigest()[:16]
        root = f"{shared_dir(spark)}/fenbrook-lake/{name}"
        if at in _STORES:
            remove(spark, _STORES[at][1].root)  # built from files that are others now
        elif not _STORES:
            atexit.register(_forget)
        _STORES[at] = now, VersionStore(spark, root)
    return _STORES[at][1]


def _forget() -> None:
    """Delete what was built at the end of the application."""
    for _, own in _STORES.values():
        with contextlib.suppress(Exception):  # the application may have ended already
            remove(own.spark, own.root)


def table(spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The current version of a table, which is published from ``build`` where there is none yet."""
    own = store(spark, folder)
    df = own.read(name)
    if df is None:
        own.publish(build(spark, folder), name, "build")
        df = own.read(name)
    return df


def bucketed(spark: SparkSession, folder: str, name: str, key: str, buckets: Callable[[], int], build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A table in Spark's own buckets, in the folder of the others, which is built where there is none yet."""
    root = store(spark, folder).root
    table = f"{name.replace('.', '_')}_{root.rsplit('/', 1)[-1]}"
    if not spark.catalog.tableExists(table):
        save_bucketed(build(spark, folder), table, key, f"{root}/{name}", buckets())
    return spark.table(table)
