"""The change stream as micro-batches: changelog, contract, quarantine, merge, parked rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fenbrook.operators.cdc import merge, parse_changes, type_changes, union_all
from fenbrook.operators.contract import Rules, latest_per_key, only_orphan, with_violations
from fenbrook.sources.versions import VersionStore

from .topics import read_topics


@dataclass(frozen=True)
class Entity:
    """One table of the stream. ``prepare`` brings what the rules need (a parent's columns); of a key that the
    table has, a change counts if its ``version`` is above the table's."""

    name: str
    key: str
    schema: str
    casts: dict[str, Column]
    rules: Callable[[], Rules]
    prepare: Callable[[DataFrame, VersionStore], DataFrame]
    columns: tuple[str, ...]
    version: str = "updated_at"
    buckets: int = 64


@dataclass
class BatchResult:
    batch_id: int
    changes: int = 0
    quarantined: dict[str, int] = field(default_factory=dict)
    parked: int = 0


_PARKED = "entity string, op string, payload string, source_lsn bigint, source_ts timestamp, offset bigint, record_key string, first_seen_at timestamp_ntz"


class ChangeApplier:
    """Applies batches to versioned tables, entities in the order given: parents first.

    A batch that runs again finds its changelog written and its merges without effect.
    """

    def __init__(self, spark: SparkSession, store: VersionStore, entities: list[Entity], grace: str = "15 MINUTES"):
        self.spark, self.store, self.entities, self.grace = spark, store, entities, grace
        self.results: list[BatchResult] = []

    def apply(self, raw: DataFrame, batch_id: int, now: str) -> BatchResult:
        result, held = BatchResult(batch_id), []
        changes = parse_changes(raw, {e.name: e.key for e in self.entities}).withColumn("first_seen_at", F.lit(now).cast("timestamp_ntz")).persist()
        held.append(changes)
        try:
            result.changes = changes.count()
            if not result.changes:
                return result  # parked rows wait for the next batch that has any
            self.store.append_once(changes, "changelog", str(batch_id))
            parked = self.store.read("parked")
            work = changes.select(*(c.split()[0] for c in _PARKED.split(", ")))
            if parked is not None:
                work = union_all([work, parked])
            waiting = union_all([self._entity(e, work.where(F.col("entity") == e.name), batch_id, now, result, held) for e in self.entities])
            # All changes of a key that waits are kept, not the newest alone, with the time when each was first seen.
            still = work.join(waiting, ["entity", "record_key"], "left_semi").select(*work.columns)
            self.store.publish(still, "parked", f"stream:{batch_id}")
            result.parked = waiting.count()
            return result
        finally:
            for df in held:
                df.unpersist()
            self.results.append(result)

    def _entity(self, e: Entity, work: DataFrame, batch_id: int, now: str, result: BatchResult, held: list[DataFrame]) -> DataFrame:
        """Merge one entity's newest changes, quarantine bad ones; gives the keys that wait for a parent."""
        newest = latest_per_key(work, ["record_key"], ["source_lsn", "offset"])
        typed = type_changes(newest.withColumn("_payload", F.col("payload")), e.schema, e.casts)
        checked = with_violations(e.prepare(typed, self.store), e.rules()).persist()
        held.append(checked)
        gone = checked.where("op = 'd'")
        alive = checked.where("op <> 'd'")
        waits = only_orphan() & F.coalesce(F.col("first_seen_at") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {self.grace}"), F.lit(False))
        bad = alive.where((F.size("_violations") > 0) & ~waits)
        result.quarantined[e.name] = bad.count()
        if result.quarantined[e.name]:
            rows = bad.select(F.lit(e.name).alias("entity"), "record_key", F.col("_violations").alias("reasons"), F.col("_payload").alias("payload"))
            self.store.append_once(rows, f"quarantine_{e.name}", str(batch_id))
        good = alive.where(F.size("_violations") == 0)
        upserts = union_all([good.select(*e.columns, "op"), gone.select(F.col("record_key").alias(e.key), "op")])
        self.store.publish_merge(upserts, e.name, e.key, e.version, list(e.columns), f"stream:{batch_id}", e.buckets, op="op")
        return alive.where(waits).select("entity", "record_key")


def kafka_options(servers: str, topics: str, cap: int = 100_000) -> dict[str, str]:
    """Options of a change source: topics by pattern, all that is kept at first, at most ``cap`` messages a batch, and no silent loss."""
    return {"kafka.bootstrap.servers": servers, "subscribePattern": topics, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(cap), "failOnDataLoss": "true"}


def change_source(spark: SparkSession, topics: str, servers: str | None = None, folder: str | None = None, log: str | None = None, cap: int = 100_000, files: int = 1) -> DataFrame:
    """Streams topic, offset, value of the topics that match a pattern: from brokers or from a topic log, at most ``cap`` messages a batch, or from
    JSON files of messages in a folder, ``files`` of them a batch."""
    if servers:
        raw = spark.readStream.format("kafka").options(**kafka_options(servers, topics, cap)).load()
        return raw.select("topic", "offset", F.col("value").cast("string"))
    if log:
        return read_topics(spark, log, topics, cap)
    raw = spark.readStream.schema("topic string, offset bigint, value string").option("maxFilesPerTrigger", files).json(folder)
    return raw.where(F.col("topic").rlike(f"^(?:{topics})$"))


def run_live(source: DataFrame, applier: ChangeApplier, checkpoint: str, clock: Callable[[], str], every: str = "10 seconds") -> StreamingQuery:
    """A batch at each interval, until it is stopped."""
    return source.writeStream.foreachBatch(lambda df, i: applier.apply(df, i, clock()) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_available(source: DataFrame, applier: ChangeApplier, checkpoint: str, clock: Callable[[], str]) -> StreamingQuery:
    """All that is there now, in bounded batches; runs again from where it stopped."""
    return source.writeStream.foreachBatch(lambda df, i: applier.apply(df, i, clock()) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def caught_up(progress: dict | None) -> bool:
    """Whether the last progress has read all that its sources had; a source that reports no latest offset has."""
    if not progress or not progress.get("sources"):
        return False
    return all(s.get("latestOffset") in (None, "None", "null") or s.get("latestOffset") == s.get("endOffset") for s in progress["sources"])
