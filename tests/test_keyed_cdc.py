"""The change stream by keyed state: late parents, expiry while idle, restarts, replays."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from fenbrook.streaming.keyed_cdc import _COLUMNS, MeetParent, Table, current, fold_days, quarantined, start

_V = lambda: F.col("updated_at")
CUSTOMERS = Table("customers", "id", "id string, brand string, updated_at bigint", lambda: {"brand_unknown": F.col("brand").isNotNull()}, hands=("brand",), version=_V)
ACCOUNTS = Table("accounts", "id", "id string, customer_id string, updated_at bigint", parent="customers", parent_field="customer_id", hands=("customer_id",), version=_V)
PAYMENTS = Table("payments", "id", "id string, account_id string, amount double, updated_at bigint", lambda: {"zero_amount": F.col("amount") != 0}, parent="accounts", parent_field="account_id", version=_V)
TABLES = [CUSTOMERS, ACCOUNTS, PAYMENTS]


def _msg(topic, offset, op, row):
    row = {"updated_at": offset, **row}
    return {"topic": f"bank.public.{topic}", "offset": offset, "value": json.dumps({"op": op, "before": row if op == "d" else None, "after": None if op == "d" else row, "source": {"lsn": offset, "ts_ms": 1000 * offset}})}


@pytest.fixture
def feed(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()

    class Feed:
        out = f"file://{tmp_path}/out"

        def put(self, name, *messages):
            (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, messages)))
            (tmp_path / f"{name}.json").rename(folder / f"{name}.json")

        def start(self, grace_ms=900_000, every=None, day=None):
            raw = spark.readStream.schema("topic string, offset bigint, value string").json(f"file://{folder}")
            return start(raw, TABLES, self.out, f"file://{tmp_path}/ck", grace_ms, every, day=day)

        def run(self, **options):
            q = self.start(**options)
            assert q.awaitTermination(180) and q.exception() is None

        def rows(self, table, *resolved):
            return sorted(tuple(r) for r in current(spark, self.out, table, resolved).collect())

        def bad(self):
            return sorted((r["entity"], r["record_key"], *r["reasons"]) for r in quarantined(spark, self.out).collect())

    return Feed()


def test_children_wait_for_parents_over_two_links_and_restarts(feed):
    feed.put("a", _msg("payments", 1, "c", {"id": "t1", "account_id": "a1", "amount": 5.0}), _msg("payments", 2, "c", {"id": "t2", "account_id": "a1", "amount": 0.0}), _msg("customers", 3, "c", {"id": "c0", "brand": None}))
    feed.run()
    assert feed.rows(PAYMENTS) == [] and feed.bad() == [("customers", "c0", "brand_unknown"), ("payments", "t2", "zero_amount", "orphan_accounts")]
    feed.put("b", _msg("accounts", 4, "c", {"id": "a1", "customer_id": "c1"}), _msg("payments", 5, "u", {"id": "t1", "account_id": "a1", "amount": 6.0}))
    feed.run()  # a new query on the same checkpoint: what waits lies in the state
    assert feed.rows(ACCOUNTS) == [] and feed.rows(PAYMENTS) == [] and len(feed.bad()) == 2
    feed.put("c", _msg("customers", 6, "c", {"id": "c1", "brand": "one"}))
    feed.run()
    assert feed.rows(ACCOUNTS, "brand") == [("a1", "c1", 4, "one")]
    assert feed.rows(PAYMENTS, "customer_id", "brand") == [("t1", "a1", 6.0, 5, "c1", "one")] and len(feed.bad()) == 2
    before = len(feed.rows(PAYMENTS))
    feed.run()  # nothing new
    assert len(feed.rows(PAYMENTS)) == before


def test_only_newer_changes_count_and_deletes_always(feed):
    feed.put("a", _msg("customers", 5, "c", {"id": "c1", "brand": "b"}), _msg("customers", 6, "u", {"id": "c1", "brand": "late", "updated_at": 2}), _msg("customers", 1, "c", {"id": "c2", "brand": "x"}), _msg("customers", 9, "d", {"id": "c2", "brand": "x", "updated_at": 0}))
    feed.run()
    assert feed.rows(CUSTOMERS) == [("c1", "b", 5)]
    feed.put("b", _msg("customers", 10, "u", {"id": "c1", "brand": "new", "updated_at": 7}), _msg("customers", 11, "c", {"id": "c2", "brand": "again", "updated_at": 1}), _msg("accounts", 12, "c", {"id": "a", "customer_id": "c2"}))
    feed.run()
    assert feed.rows(CUSTOMERS) == [("c1", "new", 7), ("c2", "again", 1)] and feed.rows(ACCOUNTS, "brand") == [("a", "c2", 12, "again")]


def test_wait_ends_by_a_timer_on_an_idle_stream(feed):
    feed.put("a", _msg("accounts", 1, "c", {"id": "a1", "customer_id": "nobody"}), _msg("customers", 2, "c", {"id": "c1", "brand": "one"}))
    q = feed.start(grace_ms=4_000, every="1 second")
    try:
        for _ in range(240):  # nothing else is ever put there
            time.sleep(0.5)
            assert q.isActive, q.exception()
            if q.lastProgress and feed_ready(feed) and feed.bad():
                break
        assert feed.bad() == [("accounts", "a1", "orphan_customers")] and feed.rows(ACCOUNTS) == []
        feed.put("b", _msg("customers", 3, "c", {"id": "nobody", "brand": "late"}), _msg("accounts", 4, "u", {"id": "a1", "customer_id": "nobody"}))
        for _ in range(240):
            time.sleep(0.5)
            if feed.rows(ACCOUNTS):
                break
        assert feed.rows(ACCOUNTS, "brand") == [("a1", "nobody", 4, "late")]
    finally:
        q.stop()


def test_a_batch_touches_its_keys_only_and_may_run_twice(spark, feed, tmp_path):
    """State that a batch updates follows the batch, not the table; a batch that was written but not committed leaves no doubles."""
    feed.put("a", *(_msg("customers", i, "c", {"id": f"c{i}", "brand": "b"}) for i in range(1, 2001)))
    feed.run()
    feed.put("b", _msg("customers", 3000, "u", {"id": "c7", "brand": "new"}), _msg("accounts", 3001, "c", {"id": "a1", "customer_id": "c8"}))
    q = feed.start()
    assert q.awaitTermination(180) and q.exception() is None
    updated = [o["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"] for o in p["stateOperators"]]
    assert updated and max(updated) <= 10, updated
    log = spark.read.parquet(feed.out)
    rows = log.count()
    assert rows == 2002 and feed.rows(ACCOUNTS, "brand") == [("a1", "c8", 3001, "b")]
    commits = f"{tmp_path}/ck/commits"
    last = max((x for x in os.listdir(commits) if x.isdigit()), key=int)
    for x in (f"{commits}/{last}", f"{commits}/.{last}.crc"):
        if os.path.exists(x):
            os.remove(x)
    feed.run()
    assert spark.read.parquet(feed.out).count() == rows
    assert [r for r in feed.rows(CUSTOMERS) if r[0] == "c7"] == [("c7", "new", 3000)]


def test_days_are_folded_into_a_snapshot(spark, feed):
    """Reads start from the snapshot; later changes, deletes and keys that come back go on from it."""
    day = lambda d: F.lit(d).cast("date")
    feed.put("a", *(_msg("customers", i, "c", {"id": f"c{i}", "brand": "b"}) for i in range(1, 6)), _msg("customers", 7, "d", {"id": "c5", "brand": "b"}))
    feed.run(day=day("2024-01-01"))
    fold_days(spark, feed.out, CUSTOMERS, "2024-01-02")
    before = feed.rows(CUSTOMERS)
    assert [r[0] for r in before] == ["c1", "c2", "c3", "c4"]
    plan = current(spark, feed.out, CUSTOMERS)._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan and "2024-01-02" in plan  # days before are not read
    feed.put("b", _msg("customers", 10, "u", {"id": "c1", "brand": "new"}), _msg("customers", 11, "d", {"id": "c2", "brand": "b"}), _msg("customers", 12, "c", {"id": "c5", "brand": "again"}))
    feed.run(day=day("2024-01-02"))
    assert feed.rows(CUSTOMERS) == [("c1", "new", 10), ("c3", "b", 3), ("c4", "b", 4), ("c5", "again", 12)]
    fold_days(spark, feed.out, CUSTOMERS, "2024-01-03")
    assert feed.rows(CUSTOMERS) == [("c1", "new", 10), ("c3", "b", 3), ("c4", "b", 4), ("c5", "again", 12)]
    with pytest.raises(ValueError):
        fold_days(spark, feed.out, CUSTOMERS, "2999-01-01")


def test_state_is_asked_once_for_a_key():
    """However many children a parent has in a batch, its state costs one read, and no write where nothing changes."""
    calls = []

    class Known:
        def get(self):
            calls.append("get")
            return '{"brand": "b"}', 1, 1

        def update(self, value):
            calls.append("update")

        def exists(self):
            calls.append("exists")
            return True

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 0

    step = MeetParent("customers", ("accounts",), 1000)
    step.known = Known()
    changes = [tuple({"entity": "accounts", "record_key": f"a{i}", "op": "c", "source_lsn": 200 - i, "offset": i, "parent_key": "c1", "reasons": []}.get(c) for c in _COLUMNS) for i in range(100)]
    out = list(step.handleInputRows(("pc1",), iter(changes), Clock()))
    assert [r["record_key"] for r in out] == [f"a{i}" for i in reversed(range(100))] and {r["resolved"] for r in out} == {'{"brand": "b"}'}
    assert calls == ["get"]


def feed_ready(feed):
    return os.path.isdir(feed.out.removeprefix("file://") + "/_spark_metadata")
