"""The ends of streams: the bounded topic source, the event sink, audits that a stream drives."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from fenbrook.operators.dq import run_checks, silver_checks
from fenbrook.sources.versions import VersionStore
from fenbrook.streaming.calls import live_cards, publish_events, read_events
from fenbrook.streaming.keyed_cdc import Table, current, start
from fenbrook.streaming.progress import AuditLoop, Progress
from fenbrook.streaming.topics import append_messages, read_topics


def _wait(seconds, done, query):
    for _ in range(5 * seconds):
        if done():
            return
        assert query.isActive, query.exception()
        time.sleep(0.2)
    raise AssertionError("waited in vain")


def test_topics_come_in_bounded_batches_and_go_on_after_a_restart(spark, tmp_path):
    log, ck, out = str(tmp_path / "log"), f"file://{tmp_path}/ck", f"file://{tmp_path}/out"
    for t, n in (("bank.a", 25), ("bank.b", 7), ("other.c", 50)):
        append_messages(log, t, [{"n": i} for i in range(n)])
    sizes = []

    def go(until):
        q = read_topics(spark, log, r"bank\..*", cap=10, per_task=3).writeStream.foreachBatch(lambda df, i: (sizes.append(df.count()), df.write.mode("overwrite").parquet(f"{out}/batch={i}")) and None).option("checkpointLocation", ck).trigger(processingTime="0 seconds").start()
        try:
            _wait(60, lambda: sum(sizes) >= until, q)
            q.processAllAvailable()
        finally:
            q.stop()

    go(32)
    assert max(sizes) <= 10 and sum(sizes) == 32
    append_messages(log, "bank.a", [{"n": i} for i in range(25, 30)])
    append_messages(log, "bank.new", [{"n": 0}])
    go(38)
    assert max(sizes) <= 10 and sum(sizes) == 38
    rows = [(r["topic"], r["offset"], json.loads(r["value"])["n"]) for r in spark.read.parquet(out).collect()]
    assert sorted(rows) == sorted([("bank.a", i, i) for i in range(30)] + [("bank.b", i, i) for i in range(7)] + [("bank.new", 0, 0)])

    # Retention outruns the stream: it fails instead of going on with a gap.
    shutil.rmtree(f"{log}/bank.a")
    append_messages(log, "bank.a", [{"n": 99}], first=60)
    q = read_topics(spark, log, r"bank\..*", cap=10).writeStream.format("noop").option("checkpointLocation", ck).trigger(processingTime="0 seconds").start()
    with pytest.raises(Exception, match="are to be read"):
        q.awaitTermination(60)
        raise AssertionError(q.status)
    q.stop()


def test_events_are_published_in_order_and_once(spark, tmp_path):
    feed = tmp_path / "calls"
    feed.mkdir()
    out, ck = f"file://{tmp_path}/out", f"file://{tmp_path}/ck"

    def put(name, lines):
        (feed / f"{name}.json").write_text("\n".join(json.dumps({"call_id": c, "seq": s, "ts": f"2024-01-01T00:00:{s:02}Z", "labels": x}) for c, s, x in lines))

    def go():
        calls = spark.readStream.schema("call_id bigint, seq bigint, ts timestamp, labels array<string>").json(f"file://{feed}")
        q = publish_events(live_cards(calls), out, ck)
        assert q.awaitTermination(120) and q.exception() is None

    def seen():
        rows = read_events(spark, out).orderBy("key", "batch", "place").collect()
        return [(r["key"], json.loads(r["value"])["seq"], json.loads(r["value"])["label"]) for r in rows]

    put(0, [(1, 2, ["z", "b"]), (1, 1, ["m"])] + [(c, 1, ["x", "a"]) for c in range(2, 30)])
    go()
    first = seen()
    assert [r for r in first if r[0] == "1"] == [("1", 1, "m"), ("1", 2, "z"), ("1", 2, "b")] and len(first) == 3 + 2 * 28
    put(1, [(1, 3, ["c", "b"])])
    go()
    want = [("1", 1, "m"), ("1", 2, "z"), ("1", 2, "b"), ("1", 3, "c")]
    assert [r for r in seen() if r[0] == "1"] == want and len(seen()) == len(first) + 1
    # Written but not committed: the batch runs again.
    commits = f"{tmp_path}/ck/commits"
    last = max((x for x in os.listdir(commits) if x.isdigit()), key=int)
    os.remove(f"{commits}/{last}")
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.remove(f"{commits}/.{last}.crc")
    go()
    assert [r for r in seen() if r[0] == "1"] == want and len(seen()) == len(first) + 1
    by_file = read_events(spark, out).select("key", "batch", F.input_file_name().alias("f")).groupBy("key", "batch").agg(F.count_distinct("f").alias("n"))
    assert by_file.where("n > 1").count() == 0


def test_audits_follow_the_tables_that_change(spark, tmp_path):
    v = lambda: F.col("updated_at")
    customers = Table("customers", "id", "id string, brand string, updated_at bigint", hands=("brand",), version=v)
    accounts = Table("accounts", "id", "id string, customer_id string, updated_at bigint", parent="customers", parent_field="customer_id", version=v)
    log, out = str(tmp_path / "log"), f"file://{tmp_path}/out"
    store = VersionStore(spark, f"file://{tmp_path}/store")
    asked, there = [], set()

    def message(n, **row):
        return {"op": "c", "before": None, "after": {**row, "updated_at": n}, "source": {"lsn": n, "ts_ms": n}}

    def audit(table, good, bad):
        asked.append((table, good, bad))
        if table not in there:
            return False
        df = current(spark, out, customers if table == "customers" else accounts).withColumn("brand", F.lit("x"))
        store.record_checks(table, f"audit-{len(asked)}", run_checks(df, silver_checks("id", bad / max(1, good + bad))).collect())
        return True

    now = [0.0]
    loop, seen = AuditLoop(["customers", "accounts"], audit, every=600, clock=lambda: now[0]), Progress()
    append_messages(log, "bank.customers", [message(i, id=f"c{i}", brand="b") for i in range(3)])
    for x in (loop, seen):
        spark.streams.addListener(x)
    q = start(read_topics(spark, log), [customers, accounts], out, f"file://{tmp_path}/ck", every="500 milliseconds")
    idle = lambda: not loop._running.locked()
    try:
        _wait(120, lambda: len(asked) >= 2 and idle(), q)  # the first is of all tables; none is there yet
        assert {a[0] for a in asked} == {"customers", "accounts"} and store.check_log() is None
        _wait(60, lambda: loop.counts["customers"][0] == 3, q)
        there.add("customers")
        before, now[0] = len(asked), 300.0
        time.sleep(2)
        assert len(asked) == before  # not yet time
        now[0] = 601.0
        _wait(60, lambda: len(asked) >= before + 2 and idle(), q)
        assert asked[before:] == [("customers", 3, 0), ("accounts", 0, 0)]
        there.add("accounts")
        now[0] = 1202.0
        _wait(60, lambda: len(asked) >= before + 3 and idle(), q)
        assert asked[before + 2 :] == [("accounts", 0, 0)]  # asked for again, now it is there
        append_messages(log, "bank.accounts", [message(9, id="a", customer_id="c1")])
        _wait(60, lambda: loop.counts["accounts"][0] == 1, q)
        now[0] = 1803.0
        _wait(60, lambda: len(asked) >= before + 4 and idle(), q)
        assert asked[before + 3 :] == [("accounts", 1, 0)] and not loop.errors
        assert {r["table_name"] for r in store.check_log().collect()} == {"customers", "accounts"}
    finally:
        q.stop()
        for x in (loop, seen):
            spark.streams.removeListener(x)
