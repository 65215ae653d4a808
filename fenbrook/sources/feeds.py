"""Reading: incremental pulls, typed delimited seeds, records that may not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def incremental(source: DataFrame, target: DataFrame, ts: str, overlap: str, run_id: str, as_of: str, name: str) -> DataFrame:
    """Rows of ``source`` newer than what ``target`` has, less an overlap; with lineage columns.

    The mark is one number, read first: as a literal it goes down into the scan, where files and row groups that are older are not read.
    """
    mark = target.agg(F.date_format(F.max(ts).cast("timestamp_ntz") - F.expr(f"INTERVAL {overlap}"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0] or "1970-01-01 00:00:00"
    new = source.where(F.col(ts) > F.lit(mark).cast(dict(source.dtypes)[ts]))
    return new.withColumns({"_ingested_at": F.lit(as_of).cast("timestamp_ntz"), "_run_id": F.lit(run_id), "_source": F.lit(name)})


def append_partitioned(df: DataFrame, path: str, day: str) -> None:
    df.withColumn("ingest_date", F.to_date(day)).write.mode("append").partitionBy("ingest_date").parquet(path)


def read_seed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, ts: str, since: str, **options: str) -> DataFrame:
    """A pull whose condition the database evaluates."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(F.col(ts) > F.lit(since).cast("timestamp"))


def parsed_or_rejected(raw: DataFrame, value: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON rows that parse, as columns, and those that do not, with the reason."""
    names = StructType.fromDDL(schema).fieldNames()
    read = raw.withColumn("_r", F.from_json(value, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | F.coalesce(*(F.when(F.col(f"_r.{n}").isNotNull(), F.lit(n)) for n in names)).isNull()
    own = [c for c in raw.columns if c != value]
    return read.where(~broken).select(*own, *(f"_r.{n}" for n in names)), read.where(broken).select(*own, value, F.lit("unparseable").alias("reason"))
