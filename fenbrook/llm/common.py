"""What the operators share: staged tables, code for Python workers, folds, joins with hot keys."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenbrook.sources.shared import remove, shared_dir, ship

__all__ = ["bounded_sample", "fold", "release", "shared_dir", "ship", "spread_join", "stage", "table", "uniform"]

_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_CLEANED: set[str] = set()


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and return a reader of it.

    Cuts lineage, so each text scan runs once, and survives the loss of executors. ``release`` deletes a table that is
    not read any more; what an operator's result still reads goes with the application.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/fenbrook/{spark.sparkContext.applicationId}"
    if folder not in _CLEANED:
        _CLEANED.add(folder)
        atexit.register(_forget, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _forget(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Exception):  # the application may have ended already, or its store be gone
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def release(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; the driver's collection lets Spark's cleaner delete the shuffle
    files of finished steps too, which would else lie there for half an hour."""
    spark = None
    for df in staged:
        if path := _PATHS.pop(df, None):
            spark = df.sparkSession
            remove(spark, path)
    if spark:
        gc.collect()
        spark._jvm.System.gc()


def spread_join(big: DataFrame, small: DataFrame, key: str, weight: str, how: str = "inner", parts: int = 2000) -> DataFrame:
    """``big`` joined with ``small``, one row a key, whose column ``weight`` says how many rows of ``big`` have the key.

    Keys with more than one in ``parts`` of all rows, fewer than ``parts`` of them whatever the size, are sent
    everywhere; their rows of ``big`` stay where they are or are dealt at random. All other keys are joined as Spark
    sees fit. ``weight`` is not in the result.
    """
    names = [c for c in small.columns if c not in (key, weight)]
    one = small.agg(F.sum(weight).alias("all"), F.max(weight).alias("most")).first()
    if not one["all"] or one["most"] * parts <= one["all"]:
        return big.join(small.drop(weight), key, how)
    value = F.struct(F.lit(1).alias("_"), *names)
    hot = F.col(weight) * parts > one["all"]
    kind = dict(big.dtypes)[key]
    first = big.join(F.broadcast(small.where(hot).select(F.col(key).alias("_key"), value.alias("_hot"))), F.col(key) == F.col("_key"), "left").drop("_key")
    # Rows of hot keys have found theirs: they go on under random keys that no row of the other side has.
    other = F.xxhash64(F.lit("spread"), F.monotonically_increasing_id())
    dealt = first.withColumn("_has", F.col("_hot").isNotNull()).withColumn("_on", F.when(F.col("_has"), other).otherwise(F.xxhash64(key)))
    rest = small.where(~hot).select(F.col(key).alias("_key"), F.xxhash64(key).alias("_at"), value.alias("_rest"))
    met = dealt.join(rest, (F.col("_on") == F.col("_at")) & (F.col(key) == F.col("_key")) & ~F.col("_has"), "left")
    found = F.coalesce("_hot", "_rest")
    met = met if how == "left" else met.where(found.isNotNull())
    own = [c for c in big.columns if c != key]
    out = met.select(key, *own, *(found[c].alias(c) for c in names))
    return out.withColumn(key, F.col(key).cast(kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``: the fold that decides what is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % k


def uniform(*cols: Column) -> Column:
    """A reproducible uniform number in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by the hash of ``key``; all rows if there are fewer."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(uniform(F.lit(seed), F.col(key)) < F.lit(bound / n))
