"""Metrics of a running stream: per batch rows, rates and times, kept as they are reported."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(changes: DataFrame, name: str = "changes") -> DataFrame:
    """``changes`` with counts by kind that Spark reports with each batch, without a pass of their own."""
    kinds = [F.count_if(F.col("op") == op).alias(f"op_{op}") for op in "cudr"]
    return changes.observe(name, F.count("*").alias("events"), *kinds, F.min("source_ts").alias("oldest"))


class Progress(StreamingQueryListener):
    """Remembers the last ``keep`` batches: id, rows, milliseconds, and the observed metrics."""

    def __init__(self, keep: int = 1000):
        self.keep = keep
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}
        self.batches = [*self.batches, {"batch_id": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration, "observed": metrics}][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counted(changes: DataFrame, tables: list[str], name: str = "tables") -> DataFrame:
    """``changes`` (entity, reasons) with the good and the bad rows of each table, which Spark reports with each batch."""
    good = lambda t: (F.col("entity") == t) & (F.size("reasons") == 0)
    bad = lambda t: (F.col("entity") == t) & (F.size("reasons") > 0)
    return changes.observe(name, *(F.count_if(good(t)).alias(f"good_{t}") for t in tables), *(F.count_if(bad(t)).alias(f"bad_{t}") for t in tables))


class AuditLoop(StreamingQueryListener):
    """Audits that a stream drives: each ``every`` seconds ``audit(table, good, bad)`` of the tables that changed since their last audit.

    The first audit is of all tables. ``audit`` says False where a table is not there yet: it is asked for again at the next
    time, with all that was counted since. Idle batches count as time too. Audits run one after the other beside the stream.
    """

    def __init__(self, tables: list[str], audit: Callable[[str, int, int], bool], every: float = 600, name: str = "tables", clock: Callable[[], float] = time.monotonic):
        self.audit, self.every, self.name, self.clock = audit, every, name, clock
        self.counts = {t: [0, 0] for t in tables}
        self.first = set(tables)
        self.last: float | None = None
        self.errors: list[Exception] = []
        self._lock, self._running = threading.Lock(), threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = (event.progress.observedMetrics or {}).get(self.name)
        if row is not None:
            with self._lock:
                for t, n in self.counts.items():
                    n[0] += row[f"good_{t}"]
                    n[1] += row[f"bad_{t}"]
        self._tick()

    def onQueryIdle(self, event) -> None:
        self._tick()

    def onQueryTerminated(self, event) -> None:
        pass

    def _tick(self) -> None:
        now = self.clock()
        if (self.last is None or now - self.last >= self.every) and self._running.acquire(blocking=False):
            self.last = now
            threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        try:
            self.run()
        except Exception as e:  # noqa: BLE001 - a failed audit must not end the stream; it is kept for whoever asks
            self.errors.append(e)
        finally:
            self._running.release()

    def run(self) -> None:
        """One round of audits; what arrives meanwhile counts for the next."""
        for t in list(self.counts):
            with self._lock:
                good, bad = self.counts[t]
                self.counts[t] = [0, 0]
            if not (t in self.first or good or bad):
                continue
            done = False
            try:
                done = self.audit(t, good, bad)
            finally:
                with self._lock:
                    if done:
                        self.first.discard(t)
                    else:
                        self.counts[t][0] += good
                        self.counts[t][1] += bad
