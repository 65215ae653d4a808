"""The change stream by keyed state: late parents by timers, the newest change of each key, work that follows the batch.

Each link from child to parent is one stateful operator whose key is the parent's: it holds what the parent hands down and,
in a map, the children that wait for it. A timer ends the wait, also while nothing arrives. A last operator, by record,
lets a change pass only if it counts. What passes is appended by Spark's file sink exactly once; the table is the last
accepted change of each key. State lies in Spark's RocksDB store, so a batch reads and writes the keys that it has and no others.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from fenbrook.operators.cdc import parse_changes, type_changes, union_all
from fenbrook.operators.contract import Rules, latest_per_key, with_violations
from fenbrook.sources.shared import ship

from .progress import counted

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGE = "entity string, record_key string, op string, payload string, source_lsn bigint, offset bigint, version bigint, parent_key string, hands string, resolved string, reasons array<string>, seq bigint"
_COLUMNS = [c.split()[0] for c in _CHANGE.split(", ")]
_NAMED = Row(*_COLUMNS)


@dataclass(frozen=True)
class Table:
    """One table of the stream. ``rules`` judge a row by itself; ``version`` orders the changes of a key; ``hands`` are the fields that children
    get, with those that the row got from its own parent."""

    name: str
    key: str
    schema: str
    rules: Callable[[], Rules] = dict
    casts: dict[str, Column] = field(default_factory=dict)
    parent: str | None = None
    parent_field: str | None = None
    hands: tuple[str, ...] = ()
    version: Callable[[], Column] = lambda: F.unix_micros(F.col("updated_at").cast("timestamp"))


def judged_changes(raw: DataFrame, tables: list[Table]) -> DataFrame:
    """Changes of the tables with the rules that each row breaks by itself, its parent's key and what it hands down. Changes without a key go to no table
    and are quarantined as ``key_missing``."""
    changes = parse_changes(raw, {t.name: t.key for t in tables})
    out = []
    for t in tables:
        typed = type_changes(changes.where(F.col("entity") == t.name).withColumn("_payload", F.col("payload")), t.schema, t.casts)
        checked = with_violations(typed, {"key_missing": F.col("record_key").isNotNull()} | t.rules())
        hands = F.to_json(F.create_map(*(x for h in t.hands for x in (F.lit(h), F.col(h).cast("string")))) if t.hands else F.create_map().cast("map<string,string>"))
        out.append(
            checked.select(
                "entity", "record_key", "op", F.col("_payload").alias("payload"), "source_lsn", "offset", t.version().cast("bigint").alias("version"),
                (F.col(t.parent_field).cast("string") if t.parent_field else F.lit(None).cast("string")).alias("parent_key"), hands.alias("hands"), F.lit(None).cast("string").alias("resolved"),
                # What a delete carries is what was there before: no rule holds it back but a missing key.
                F.when(F.col("op") == "d", F.filter("_violations", lambda v: v == "key_missing")).otherwise(F.col("_violations")).alias("reasons"), F.lit(None).cast("bigint").alias("seq"),
            )
        )
    return union_all(out)


class MeetParent(StatefulProcessor):
    """One parent and the children that wait for it. Parents pass; children pass with what their parent hands down, or wait ``grace_ms``
    for it and then pass with the reason ``orphan_<parent>``."""

    def __init__(self, parent: str, children: tuple[str, ...], grace_ms: int):
        self.parent, self.children, self.grace_ms = parent, children, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "hands string, lsn bigint, offset bigint")
        self.waiting = handle.getMapState("waiting", "entity string, record_key string, lsn bigint, offset bigint", f"{_CHANGE}, until bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, until = timerValues.getCurrentProcessingTimeInMs(), None
        found = sorted((_change(r) for r in rows), key=lambda r: (r["entity"] != self.parent, *_at(r)))
        state = self.known.get()  # asked once a key, and put back once
        hands, at, changed = (state[0], tuple(state[1:3]), False) if state else (None, None, False)
        for r in found:
            if r["entity"] == self.parent:
                yield _row(r)
                own = (r["source_lsn"] or 0, r["offset"] or 0)
                if not r["reasons"] and (at is None or own >= at):
                    hands = None if r["op"] == "d" else json.dumps(json.loads(r["resolved"] or "{}") | json.loads(r["hands"] or "{}"))
                    at, changed = own, True
            elif r["entity"] not in self.children or r["op"] == "d":
                yield _row(r)
            elif hands is not None:
                yield self._met(r, hands)
            elif r["reasons"]:
                yield _row({**r, "reasons": [*r["reasons"], f"orphan_{self.parent}"]})
            else:
                until = now + self.grace_ms
                self.waiting.updateValue((r["entity"], r["record_key"], r["source_lsn"], r["offset"]), (*_row(r), until))
        if changed:
            self.known.update((hands, *at))
        if hands is not None:
            if changed:  # else nothing can wait here
                for k, v in list(self.waiting.iterator()):
                    yield self._met(_change(v), hands)
                    self.waiting.removeKey(k)
        elif until is not None:
            self.handle.registerTimer(until)  # one timer for all that began to wait in this batch

    def _met(self, r: dict, hands: str) -> Row:
        return _row({**r, "resolved": json.dumps(json.loads(r["resolved"] or "{}") | json.loads(hands))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        for k, v in list(self.waiting.iterator()):
            if v[-1] <= due:
                yield _row({**_change(v), "reasons": [f"orphan_{self.parent}"]})
                self.waiting.removeKey(k)

    def close(self) -> None:
        pass


class TakeNewest(StatefulProcessor):
    """One record. A change passes if its version is above that of the row there is, a delete always; accepted changes are numbered.
    Rows with reasons pass as they are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "seq bigint, version bigint, there boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.row.get()
        before = tuple(state) if state else (0, None, False)
        seq, version, there = before
        for r in sorted((_change(r) for r in rows), key=_at):
            if r["reasons"]:
                yield _row(r)
                continue
            own = r["version"]
            if r["op"] == "d":
                if not there:
                    continue
                there, version = False, None
            elif there and (own is None or version is not None and own <= version):
                continue
            else:
                there, version = True, own
            seq += 1
            yield _row({**r, "seq": seq})
        if (seq, version, there) != before:
            self.row.update((seq, version, there))

    def close(self) -> None:
        pass


def _at(r: dict) -> tuple:
    """Where a change stands in its source; null, which no source should give, is first."""
    return tuple((x is not None, x or 0) for x in (r["source_lsn"], r["offset"]))


def _change(r: Row) -> dict:
    return dict(zip(_COLUMNS, r, strict=False))  # by place: what follows is the key, or the end of a wait


def _row(r: dict) -> Row:
    return _NAMED(*(r[c] for c in _COLUMNS))


def accepted_changes(raw: DataFrame, tables: list[Table], grace_ms: int = 15 * 60 * 1000) -> DataFrame:
    """The changes that count, numbered for each record (``seq``), and those that break a rule, with ``reasons``.

    ``tables`` come parents first. Each table that is a parent is one operator over its own changes and those of its children; what
    went through one goes on to the next. A change whose parent is not there waits ``grace_ms`` of processing time. All changes of a child that waits are kept.
    """
    ship(raw.sparkSession)
    changes = judged_changes(raw, tables)
    parents = [t for t in tables if any(c.parent == t.name for c in tables)]
    through, seen = None, set()
    for p in parents:
        children = tuple(t.name for t in tables if t.parent == p.name)
        fresh = changes.where(F.col("entity").isin(*({p.name, *children} - seen)))
        seen |= {p.name, *children}
        rows = fresh if through is None else through.unionByName(fresh)
        own = F.when(F.col("entity") == p.name, F.col("record_key")).when(F.col("entity").isin(*children), F.col("parent_key"))
        # Rows of other tables only pass: they go by their own key.
        key = F.coalesce(F.concat(F.lit("p"), own), F.concat_ws("|", F.lit("o"), "entity", F.coalesce("record_key", F.col("offset").cast("string"))))
        through = rows.withColumn("_key", key).groupBy("_key").transformWithState(MeetParent(p.name, children, grace_ms), outputStructType=_CHANGE, outputMode="Append", timeMode="ProcessingTime")
    rest = [t.name for t in tables if t.name not in seen]
    if rest:
        alone = changes.where(F.col("entity").isin(*rest))
        through = alone if through is None else through.unionByName(alone)
    record = F.concat_ws("|", "entity", F.coalesce("record_key", F.concat(F.lit("?"), F.col("offset").cast("string"))))
    return through.withColumn("_key", record).groupBy("_key").transformWithState(TakeNewest(), outputStructType=_CHANGE, outputMode="Append", timeMode="None")


def start(raw: DataFrame, tables: list[Table], folder: str, checkpoint: str, grace_ms: int = 15 * 60 * 1000, every: str | None = None, partitions: int | None = None, day: Column | None = None) -> StreamingQuery:
    """Append accepted changes to ``folder`` by table and ``day`` (that of the clock), at an interval until stopped, or all that is there now. Each restart with the
    same checkpoint goes on where it stopped. ``partitions`` of the state, which the first start settles, are Spark's shuffle partitions otherwise."""
    conf = raw.sparkSession.conf
    # With timers there is always one more batch without rows; a run over what is there now must end without them.
    own = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "true" if every else "false"} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: conf.get(k) for k in own}
    out = counted(accepted_changes(raw, tables, grace_ms), [t.name for t in tables]).withColumn("day", F.to_date(F.current_timestamp()) if day is None else day).writeStream.format("parquet").partitionBy("entity", "day").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    try:
        for k, v in own.items():
            conf.set(k, v)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{_CHANGE}, day date").parquet(folder)


def _snapshot(spark: SparkSession, folder: str, table: str) -> tuple[str, str] | None:
    """The day and the path of the newest whole snapshot."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}_snapshots/{table}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(base)] if fs.exists(base) else []
    whole = sorted(p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    return (whole[-1].rsplit("=", 1)[-1], whole[-1]) if whole else None


def _last(spark: SparkSession, folder: str, table: str, before: str | None = None) -> DataFrame:
    """record_key, seq, op, payload, resolved: the last accepted change of each key, from the newest snapshot and the days that it has not folded in."""
    rows = _written(spark, folder).where((F.col("entity") == table) & F.col("seq").isNotNull())
    columns = ("record_key", "seq", "op", "payload", "resolved")
    kept = _snapshot(spark, folder, table)
    if kept:
        rows = rows.where(F.col("day") >= F.lit(kept[0]).cast("date"))
    if before:
        rows = rows.where(F.col("day") < F.lit(before).cast("date"))
    rows = rows.select(*columns)
    if kept:
        rows = rows.union(spark.read.schema("record_key string, seq bigint, op string, payload string, resolved string").parquet(kept[1]))
    return latest_per_key(rows, ["record_key"], ["seq"])


def fold_days(spark: SparkSession, folder: str, table: Table, before: str) -> None:
    """A snapshot of what changed before the day ``before``, which must have begun: reads of the table start from it, and what it holds of the
    change log need not be kept. Deleted keys stay in it as such, since a number of theirs may still come."""
    if before > str(spark.sql("select current_date()").first()[0]):
        raise ValueError(f"{before} has not begun: changes would still come under days before it")
    _last(spark, folder, table.name, before).write.mode("overwrite").parquet(f"{folder}_snapshots/{table.name}/before={before}")


def current(spark: SparkSession, folder: str, table: Table, resolved: tuple[str, ...] = ()) -> DataFrame:
    """The table as it stands: the last accepted change of each key that is no delete, typed, with the ``resolved`` fields of its parents."""
    last = _last(spark, folder, table.name).where("op <> 'd'")
    names = StructType.fromDDL(table.schema).fieldNames()
    typed = type_changes(last.select("payload", F.col("resolved").alias("_resolved")), table.schema, table.casts)
    return typed.select(*(n for n in names if n not in resolved), *(F.get_json_object("_resolved", f"$.{n}").alias(n) for n in resolved))


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """entity, record_key, reasons, payload of the changes that broke a rule."""
    return _written(spark, folder).where(F.size("reasons") > 0).select("entity", "record_key", "reasons", "payload")
