"""A table's batch run: contract, quarantine, halt, merge, audit, publish, and what the logs say of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenbrook.operators.contract import Rules, quarantine_rows, split, with_violations
from fenbrook.operators.dq import Check, accept_quarantine, run_checks

from .versions import DataQualityHalt, PublishResult, VersionStore, halt_on


def silver_run(
    store: VersionStore, pending: DataFrame, table: str, key: str, rules: Rules, checks: Callable[[float], list[Check]], run_id: str, as_of: str, version: str = "updated_at", most: float = 0.01, accept: bool = False, buckets: int = 64
) -> PublishResult | None:
    """Merge the rows of ``pending`` that keep the rules into ``table``; bad ones go to the quarantine.

    Over ``most`` bad rows, or a failed check, publish nothing, log the run as halted and raise. Without any row the
    current table is checked again and an ok run is logged: so the newest results are never stale.
    """
    checked = with_violations(pending, rules).persist()
    try:
        good, bad = split(checked)
        counts = checked.agg(F.count("*").alias("n"), F.count_if(F.size("_violations") > 0).alias("bad")).first()
        log = {"run_id": run_id, "step": "silver", "table_name": table, "rows_in": counts["n"], "rows_published": 0, "rows_quarantined": counts["bad"]}
        if not counts["n"]:
            if current := store.current(table):
                store.record_checks(table, run_id, run_checks(store.read(table), checks(0.0)).collect())
                store.record_run(**log, status="ok", version=current, detail="no new data")
            return None
        if counts["bad"]:
            store.append_once(quarantine_rows(bad, table, key, run_id, as_of), "quarantine", f"{table}-{run_id}")
        try:
            rate = halt_on(counts["bad"], counts["n"], most, accept)
        except DataQualityHalt as e:
            store.record_run(**log, status="halted", version=store.current(table), detail=str(e))
            raise
        result = store.publish_merge(good, table, key, version, good.columns, run_id, buckets, inclusive=True, checks=accept_quarantine(checks(rate)) if accept else checks(rate))
        log["rows_published"] = counts["n"] - counts["bad"] if result.published else 0
        store.record_run(**log, status="ok" if result.published else "halted", version=result.version, detail="; ".join(result.failed_checks) or "all checks passed")
        if not result.published:
            raise DataQualityHalt(f"{table}: {', '.join(result.failed_checks)}; the version stays aside")
        return result
    finally:
        checked.unpersist()
