"""Change capture: envelopes, typed payloads, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_changes(raw: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Columns entity, op, record_key, payload, source_lsn, source_ts, offset of envelopes (topic, offset, value).

    The payload of a delete is what was there before. Envelopes without an op are dropped.
    """
    field = lambda p: F.get_json_object("value", p)
    op = field("$.op")
    body = F.when(op == "d", field("$.before")).otherwise(field("$.after"))
    parsed = raw.select(
        F.regexp_extract("topic", r"([^.]+)$", 1).alias("entity"),
        op.alias("op"),
        body.alias("payload"),
        field("$.source.lsn").cast("bigint").alias("source_lsn"),
        F.timestamp_millis(field("$.source.ts_ms").cast("bigint")).alias("source_ts"),
        "offset",
    ).where(F.col("op").isNotNull())
    key = F.coalesce(*(F.when(F.col("entity") == e, F.get_json_object("payload", f"$.{k}")) for e, k in keys.items()))
    return parsed.withColumn("record_key", key)


def type_changes(changes: DataFrame, schema: str, casts: dict[str, Column]) -> DataFrame:
    """Payload fields as columns, by a declared schema; values that do not convert are null."""
    opened = changes.withColumn("_p", F.from_json("payload", schema))
    own = [c for c in changes.columns if c != "payload"]
    names = StructType.fromDDL(schema).fieldNames()
    return opened.select(*own, *(F.col(f"_p.{n}").alias(n) for n in names)).withColumns(casts)


def merge(target: DataFrame, source: DataFrame, key: str, version: str, inclusive: bool = True, op: str | None = None, tombstones: bool = False) -> DataFrame:
    """The target after an upsert by ``source``, which has one row per key at most.

    A matched row is replaced if its source version is at least (``inclusive``) or above the target's. With ``op``,
    rows whose op is 'd' delete a matched key whatever their version, and insert nothing; with
    ``tombstones`` a delete must be as new as what it deletes.
    """
    columns = target.columns
    s = source.select(F.col(key), F.struct(*(F.col(c) for c in columns if c in source.columns)).alias("_s"), *([F.col(op).alias("_op")] if op else []))
    t = target.select(F.col(key), F.struct(*columns).alias("_t"))
    both = t.join(s, key, "full_outer")
    newer = F.col(f"_s.{version}") >= F.col(f"_t.{version}") if inclusive else F.col(f"_s.{version}") > F.col(f"_t.{version}")
    gone = (F.col("_op") == "d") if op else F.lit(False)
    if op and tombstones:
        gone = gone & (F.col("_t").isNull() | newer)
    take = F.col("_s").isNotNull() & (F.col("_t").isNull() | newer)
    if op:
        take = take & (F.col("_op") != "d")
    kept = both.where(~F.coalesce(gone, F.lit(False)))
    kept = kept.where(F.col("_t").isNotNull() | F.coalesce(take, F.lit(False)))
    value = lambda c: F.when(F.coalesce(take, F.lit(False)), F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}"))
    return kept.select(*(value(c).alias(c) for c in columns))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
