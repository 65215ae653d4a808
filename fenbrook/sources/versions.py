"""Versioned Parquet tables with write, audit, publish.

A version is a folder, or, of a table that changes by key, one folder for each bucket of keys; a
log of rows says which version a table stands at. A version is written aside, checked, and only then
named current by one appended log row, so readers see the old or the new version. Failed
versions stay for inspection. One writer for each store is assumed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenbrook.operators.cdc import merge
from fenbrook.operators.dq import Check, run_checks

from .shared import remove

_LOG = "table_name string, version string, operation string, run_id string, rows bigint, at timestamp, summary map<string,string>"
_RUN = "run_id string, step string, table_name string, status string, rows_in bigint, rows_published bigint, rows_quarantined bigint, version string, detail string"


class DataQualityHalt(Exception):
    """Too many bad rows: nothing is published, and a retry will not help."""


@dataclass(frozen=True)
class PublishResult:
    version: str
    published: bool
    failed_checks: list[str]


class VersionStore:
    def __init__(self, spark: SparkSession, root: str, log_files: int = 64):
        self.spark, self.root, self.log_files = spark, root.rstrip("/"), log_files
        self._views: dict[str, tuple] = {}

    # --- files ---

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _path(self, table: str, version: str) -> str:
        """A version that was swapped in names the table that it was written for."""
        return f"{self.root}/{version}" if "/" in version else f"{self.root}/{table}/{version}"

    # --- log ---

    def _generation(self) -> str:
        """The newest whole generation of the log: it is rewritten as one file once it has many."""
        whole = [g for g in self._children(f"{self.root}/_log") if self._exists(f"{self.root}/_log/{g}/_SUCCESS")]
        return whole[-1] if whole else "g000000"

    def log(self) -> DataFrame:
        path = f"{self.root}/_log/{self._generation()}"
        return self.spark.read.schema(_LOG).parquet(path) if self._exists(path) else self.spark.createDataFrame([], _LOG)

    def record(self, table: str, version: str, operation: str, run_id: str, rows: int, summary: dict[str, str] | None = None) -> None:
        row = self.spark.createDataFrame([(table, version, operation, run_id, rows, summary or {})], "table_name string, version string, operation string, run_id string, rows bigint, summary map<string,string>")
        g = self._generation()
        row.select("table_name", "version", "operation", "run_id", "rows", F.current_timestamp().alias("at"), "summary").coalesce(1).write.mode("append").parquet(f"{self.root}/_log/{g}")
        if len(self._children(f"{self.root}/_log/{g}")) > self.log_files:
            self.compact_log()

    def compact_log(self) -> None:
        """The log in one file, as a new generation; the one before stays for readers that are on their way."""
        g = self._generation()
        self.log().coalesce(1).write.parquet(f"{self.root}/_log/g{int(g[1:]) + 1:06d}")
        for old in self._children(f"{self.root}/_log"):
            if old < g:
                remove(self.spark, f"{self.root}/_log/{old}")

    def current(self, table: str) -> str | None:
        row = self.log().where((F.col("table_name") == table) & (F.col("operation") == "publish")).agg(F.max_by("version", "at").alias("v")).first()
        return row["v"]

    def facts(self, table: str) -> dict | None:
        """Of the current version: version, commit time, rows, run and summary."""
        row = self.log().where((F.col("table_name") == table) & (F.col("operation") == "publish")).agg(F.max_by(F.struct("version", "at", "rows", "run_id", "operation", "summary"), "at").alias("v")).first()
        return row["v"].asDict() if row["v"] else None

    # --- reading and publishing ---

    def read(self, table: str, version: str | None = None) -> DataFrame | None:
        v = version or self.current(table)
        if not v:
            return None
        buckets, _ = self._buckets(table, v)
        return self.spark.read.parquet(*buckets.values()) if buckets else self.spark.read.parquet(self._path(table, v))

    def stage(self, df: DataFrame, table: str) -> tuple[str, int]:
        """A version that nobody reads yet, and its rows, which the files' footers tell."""
        version = uuid.uuid4().hex
        df.write.parquet(self._path(table, version))
        return version, self.read(table, version).count()

    def publish(self, df: DataFrame, table: str, run_id: str, checks: list[Check] = (), summary: dict[str, str] | None = None) -> PublishResult:
        version, rows = self.stage(df, table)
        return self._audited(table, version, rows, run_id, checks, summary)

    def _audited(self, table: str, version: str, rows: int, run_id: str, checks: list[Check], summary: dict[str, str] | None) -> PublishResult:
        results = run_checks(self.read(table, version), list(checks)).collect() if checks else []
        failed = [r["check_name"] for r in results if not r["passed"]]
        self.record_checks(table, run_id, results)
        self.record(table, version, "reject" if failed else "publish", run_id, rows, summary)
        return PublishResult(version, not failed, failed)

    # --- tables that change by key ---

    def _buckets(self, table: str, version: str) -> tuple[dict[int, str], int]:
        """Where the buckets of a keyed version lie that have rows, and how many there are; -1 is an empty file with the columns."""
        path = f"{self._path(table, version)}/_manifest"
        rows = self.spark.read.schema("bucket int, path string, buckets int").parquet(path).collect() if self._exists(path) else []
        return {r["bucket"]: r["path"] for r in rows}, rows[0]["buckets"] if rows else 0

    def publish_merge(self, changes: DataFrame, table: str, key: str, version_col: str, columns: list[str], run_id: str, buckets: int = 64, inclusive: bool = False, op: str | None = None, checks: list[Check] = ()) -> PublishResult:
        """The next version after a merge of ``changes``, one row a key, into the buckets of their keys; all other
        buckets stay the files that they were. ``buckets`` is settled by the first merge of a table."""
        last = self.current(table)
        paths, n = self._buckets(table, last) if last else ({}, buckets)
        if last and not paths:
            raise ValueError(f"{table} was published whole; merge into a table of its own")
        bucket = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        touched = sorted(r["b"] for r in changes.select(bucket.alias("b")).distinct().collect())  # at most n numbers
        if last and not touched:
            return PublishResult(last, True, [])
        version = uuid.uuid4().hex
        base = self._path(table, version)
        known = [paths[b] for b in (-1, *touched) if b in paths]
        old = self.spark.read.parquet(*known).select(*columns) if known else changes.select(*columns).where(F.lit(False))
        merged = merge(old, changes, key, version_col, inclusive=inclusive, op=op).withColumn("_bucket", bucket)
        merged.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(base)
        if not paths:
            merged.drop("_bucket").limit(0).coalesce(1).write.parquet(f"{base}/_columns")
            paths = {-1: f"{base}/_columns"}
        written = {int(c.split("=")[1]) for c in self._children(base) if c.startswith("_bucket=")}
        now = {b: p for b, p in paths.items() if b not in touched} | {b: f"{base}/_bucket={b}" for b in written}
        self.spark.createDataFrame([(b, p, n) for b, p in sorted(now.items())], "bucket int, path string, buckets int").coalesce(1).write.parquet(f"{base}/_manifest")
        return self._audited(table, version, self.read(table, version).count(), run_id, checks, {"touched_buckets": str(len(touched))})

    # --- checks, runs, views ---

    def record_checks(self, table: str, run_id: str, results: list) -> None:
        if results:
            rows = self.spark.createDataFrame([(run_id, table, r["check_name"], r["passed"], r["observed"]) for r in results], "run_id string, table_name string, check_name string, passed boolean, observed double")
            rows.withColumn("checked_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/_checks")

    def check_log(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/_checks") if self._exists(f"{self.root}/_checks") else None

    def record_run(self, **values) -> None:
        """One row of the run log: a step of a run on a table, its status and its counts."""
        row = self.spark.createDataFrame([tuple(values.get(c.split()[0]) for c in _RUN.split(", "))], _RUN)
        row.withColumn("finished_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/_runs")

    def run_log(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/_runs") if self._exists(f"{self.root}/_runs") else None

    def audit(self, checks: dict[str, list[Check]], run_id: str, seen: dict[str, str]) -> dict[str, str]:
        """Check the tables that stand at another version than ``seen`` says; gives what was seen now.

        The first audit, with nothing seen, checks all.
        """
        now = dict(seen)
        for table, own in checks.items():
            version = self.current(table)
            if version and version != seen.get(table):
                self.record_checks(table, run_id, run_checks(self.read(table, version), own).collect())
                now[table] = version
        return now

    def restore(self, table: str, version: str, run_id: str) -> None:
        """Make an older version current again."""
        self.record(table, version, "publish", run_id, self.read(table, version).count(), {"restored": "true"})

    def swap(self, table: str, replay: str, run_id: str) -> PublishResult:
        """Put a table that was replayed beside the live one in its place; what was live is kept as ``<table>_before``."""
        live, new = self.facts(table), self.facts(replay)
        if new is None:
            raise ValueError(f"{replay} has no published version")
        for target, source, facts in ((f"{table}_before", table, live), (table, replay, new)):
            if facts:
                version = facts["version"] if "/" in facts["version"] else f"{source}/{facts['version']}"
                self.record(target, version, "publish", run_id, facts["rows"], {"swapped_from": source})
        for name, (of, select, where) in list(self._views.items()):
            if of in (table, f"{table}_before"):
                self.view(of, name, select, where)  # views follow the table to its new version
        return PublishResult(self.current(table), True, [])

    def view(self, table: str, name: str, select: list[str | Column] | None = None, where: Column | None = None) -> None:
        """A temporary view of the version that is current now, of some columns and rows."""
        df = self.read(table)
        df = df.where(where) if where is not None else df
        (df.select(*select) if select else df).createOrReplaceTempView(name)
        self._views[name] = (table, select, where)

    # --- appended tables ---

    def append_once(self, df: DataFrame, table: str, batch_key: str) -> bool:
        """Append rows under the name of their batch; a replay of the batch changes nothing."""
        seen = self.log().where((F.col("table_name") == table) & (F.element_at("summary", F.lit("batch")) == batch_key)).limit(1).count()
        if seen:
            return False
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch_key}")
        self.record(table, batch_key, "append", batch_key, 0, {"batch": batch_key})
        return True

    def read_appended(self, table: str) -> DataFrame | None:
        """The rows of all batches that the log names."""
        if not self._exists(f"{self.root}/{table}"):
            return None
        named = self.log().where((F.col("table_name") == table) & (F.col("operation") == "append")).select(F.col("version").alias("batch")).distinct()
        return self.spark.read.parquet(f"{self.root}/{table}").withColumn("batch", F.col("batch").cast("string")).join(named, "batch", "left_semi")

    def compact(self, table: str, run_id: str, files: int, at_least: int = 5) -> bool:
        """Rewrite the current version into ``files`` files if it has at least ``at_least``. Tables that change by key are left as
        they are: a merge writes one file a bucket, and needs the buckets."""
        if (version := self.current(table)) and self._buckets(table, version)[0]:
            return False
        df = self.read(table)
        if df is None or len(df.inputFiles()) < at_least:
            return False
        return self.publish(df.repartition(files), table, run_id, summary={"compacted": "true"}).published

    def listing(self, table: str) -> DataFrame:
        """(path, modified) of all data files under a table."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.root}/{table}")
        return files.select(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("path"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"))

    def manifest(self, table: str, versions: DataFrame) -> DataFrame:
        """(path) of all data files of ``versions`` (version): one listing of each version, which retention bounds."""
        paths = [f for r in versions.select("version").distinct().collect() for f in self.read(table, r["version"]).inputFiles()]
        named = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return named.select(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/").alias("path"))


def halt_on(bad: int, rows: int, most: float = 0.01, accept: bool = False) -> float:
    """The share of bad rows; raises above ``most`` unless it is accepted."""
    rate = bad / rows if rows else 0.0
    if rate > most and not accept:
        raise DataQualityHalt(f"{rate:.4f} of rows are bad; {most:g} is the limit")
    return rate


def expired(log: DataFrame, as_of: str, days: int, keep: int) -> DataFrame:
    """table_name, version, reason: published versions that are old and not among the newest ``keep``, and old staged ones."""
    from pyspark.sql.window import Window

    old = F.col("at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    w = Window.partitionBy("table_name", "operation").orderBy(F.col("at").desc(), "version")
    ranked = log.withColumn("rn", F.row_number().over(w))
    reason = F.when(old & (F.col("operation") == "publish") & (F.col("rn") > keep), "expired").when(old & (F.col("operation") == "stage"), "abandoned")
    return ranked.select("table_name", "version", reason.alias("reason")).where(F.col("reason").isNotNull())


def orphans(listing: DataFrame, manifest: DataFrame, as_of: str, days: int) -> DataFrame:
    """Files older than ``days`` that no version names."""
    old = listing.where(F.col("modified") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return old.join(manifest.select("path"), "path", "left_anti")
