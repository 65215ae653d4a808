import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from fenbrook.sources.versions import VersionStore
from fenbrook.streaming.calls import call_events, late_payment_matches, live_cards
from fenbrook.streaming.cdc_stream import ChangeApplier, Entity, caught_up, run_available

PARENT = Entity("parents", "id", "id string, name string, updated_at bigint", {}, lambda: {"name_missing": F.col("name").isNotNull()}, lambda df, store: df, ("id", "name", "updated_at"), buckets=4)


def _with_parent(df, store):
    parents = store.read("parents")
    known = parents.select(F.col("id").alias("parent"), F.lit(True).alias("known")) if parents is not None else df.sparkSession.createDataFrame([], "parent string, known boolean")
    return df.join(known, "parent", "left")


CHILD = Entity("children", "id", "id string, parent string, updated_at bigint", {}, lambda: {"orphan_parent": F.col("known").isNotNull()}, _with_parent, ("id", "parent", "updated_at"), buckets=4)


def _msg(topic, offset, op, row):
    row = {"updated_at": offset, **row}
    return {"topic": f"bank.public.{topic}", "offset": offset, "value": json.dumps({"op": op, "before": row if op == "d" else None, "after": None if op == "d" else row, "source": {"lsn": offset, "ts_ms": 1000 * offset}})}


def _put(folder, name, messages):
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, messages)))


def _source(spark, folder):
    return spark.readStream.schema("topic string, offset bigint, value string").option("maxFilesPerTrigger", 1).json(f"file://{folder}")


def test_late_parents_quarantine_and_deletes(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    store = VersionStore(spark, f"file://{tmp_path}/store")
    now = ["2024-01-01 00:00:00"]
    applier = ChangeApplier(spark, store, [PARENT, CHILD])
    go = lambda: run_available(_source(spark, feed), applier, f"file://{tmp_path}/ckpt", lambda: now[0])

    _put(feed, "a", [_msg("children", 1, "c", {"id": "c1", "parent": "p1"}), _msg("parents", 2, "c", {"id": "p0", "name": None}), _msg("children", 3, "c", {"id": "c2", "parent": "p9"})])
    q = go()
    _ended(q)
    assert caught_up(q.lastProgress), [(type(s), s["latestOffset"], s["endOffset"]) for s in q.lastProgress["sources"]]
    assert applier.results[-1].parked == 2 and applier.results[-1].quarantined == {"parents": 1, "children": 0}
    assert store.read("children").count() == 0

    now[0] = "2024-01-01 00:20:00"
    _put(feed, "b", [_msg("parents", 4, "c", {"id": "p1", "name": "one"})])
    _ended(go())
    assert [r["id"] for r in store.read("children").collect()] == ["c1"]
    assert applier.results[-1].parked == 0 and applier.results[-1].quarantined["children"] == 1  # c2 waited too long

    _put(feed, "c", [_msg("parents", 5, "u", {"id": "p1", "name": "new"}), _msg("parents", 3, "u", {"id": "p1", "name": "old"}), _msg("children", 6, "d", {"id": "c1", "parent": "p1"})])
    _ended(go())
    assert [r["name"] for r in store.read("parents").collect()] == ["new"]
    assert store.read("children").count() == 0


def test_all_changes_of_a_waiting_key_are_kept_and_updates_go_by_time(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/store")
    applier = ChangeApplier(spark, store, [PARENT, CHILD])
    feed = lambda m: spark.createDataFrame([(x["topic"], x["offset"], x["value"]) for x in m], "topic string, offset bigint, value string")
    applier.apply(feed([_msg("children", 1, "c", {"id": "c1", "parent": "p1"}), _msg("children", 2, "u", {"id": "c1", "parent": "p1"}), _msg("parents", 3, "c", {"id": "p0", "name": "x"})]), 0, "2024-01-01 00:00:00")
    assert applier.results[-1].parked == 1 and sorted(r["source_lsn"] for r in store.read("parked").collect()) == [1, 2]
    files = set(store.read("parents").inputFiles())
    # A later change that carries an older time than the table has does not count.
    applier.apply(feed([_msg("parents", 9, "u", {"id": "p0", "name": "late", "updated_at": 1}), _msg("parents", 8, "c", {"id": "p1", "name": "one"})]), 1, "2024-01-01 00:01:00")
    assert {r["id"]: r["name"] for r in store.read("parents").collect()} == {"p0": "x", "p1": "one"}
    assert [r["updated_at"] for r in store.read("children").collect()] == [2] and store.read("parked").count() == 0 and files


def test_sources_take_topics_by_pattern_and_run_at_intervals(spark, tmp_path):
    from fenbrook.streaming.cdc_stream import change_source, kafka_options, run_live

    feed = tmp_path / "feed"
    feed.mkdir()
    other = {**_msg("parents", 2, "c", {"id": "p2", "name": "no"}), "topic": "other.parents"}
    _put(feed, "a", [_msg("parents", 1, "c", {"id": "p1", "name": "one"}), other])
    store = VersionStore(spark, f"file://{tmp_path}/store")
    q = run_live(change_source(spark, r"bank\.public\..*", folder=f"file://{feed}"), ChangeApplier(spark, store, [PARENT]), f"file://{tmp_path}/ck", lambda: "2024-01-01 00:00:00", "1 second")
    try:
        for name, want in ((None, {"p1"}), ("b", {"p1", "p3"})):
            if name:
                _put(feed, name, [_msg("parents", 3, "c", {"id": "p3", "name": "three"})])
            for _ in range(300):
                if store.current("parents") and {r["id"] for r in store.read("parents").collect()} == want:
                    break
                time.sleep(0.2)
            assert {r["id"] for r in store.read("parents").collect()} == want
    finally:
        q.stop()
    assert kafka_options("h:9092", "bank.*", 5) == {"kafka.bootstrap.servers": "h:9092", "subscribePattern": "bank.*", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "5", "failOnDataLoss": "true"}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    store = VersionStore(spark, f"file://{tmp_path}/store")
    applier = ChangeApplier(spark, store, [PARENT, CHILD])
    m = [_msg("parents", 1, "c", {"id": "p1", "name": "one"}), _msg("children", 2, "c", {"id": "c1", "parent": "p1"})]
    raw = spark.createDataFrame([(x["topic"], x["offset"], x["value"]) for x in m], "topic string, offset bigint, value string")
    for _ in range(2):
        applier.apply(raw, 7, "2024-01-01 00:00:00")
        assert store.read("parents").count() == store.read("children").count() == 1
        assert store.read_appended("changelog").count() == 2


def _ended(query):
    assert query.awaitTermination(120), query.status
    assert query.exception() is None


def _lines(folder, name, lines):
    """Lines of calls (call, seq, second, labels, ended) as a file that the stream reads in the order of names."""
    f = folder / f"{name}.json"
    f.write_text("\n".join(json.dumps({"call_id": c, "seq": s, "ts": f"2024-01-01T00:{t // 60:02}:{t % 60:02}Z", "labels": x, "done": e}) for c, s, t, x, e in lines))
    os.utime(f, (1_700_000_000 + 60 * name,) * 2)


def _calls(spark, folder):
    return spark.readStream.schema("call_id bigint, seq bigint, ts timestamp, labels array<string>, done boolean").option("maxFilesPerTrigger", 1).json(f"file://{folder}")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_live_cards_come_once_in_order(spark, tmp_path, order):
    """Lines of a call over several micro-batches, in any order of their files."""
    feed = tmp_path / "calls"
    feed.mkdir()
    parts = [
        [(1, 2, 2, ["b"], False), (1, 1, 1, ["a"], False)],
        [(1, 3, 3, ["a", "c"], False), (2, 1, 1, ["a"], True), (3, 4, 20, ["d"], False)],
        [(1, 4, 4, ["c", "d"], False), (1, 3, 3, ["a", "c"], False), (2, 2, 2, None, False)],
    ]
    for at, k in enumerate(order):
        _lines(feed, at, parts[k])
    name = "cards" + "".join(map(str, order))
    q = live_cards(_calls(spark, feed), ended="done").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    _ended(q)
    rows = [tuple(r) for r in spark.table(name).collect()]
    assert [r for r in rows if r[0] == 1] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d")]
    assert [r for r in rows if r[0] != 1] == [(2, 1, "a")]  # the fourth line of call 3 waits for the others


def test_open_gaps_and_idle_calls_time_out(spark, tmp_path):
    """A gap that nobody fills is passed over, a call that was idle or has ended starts anew; events carry JSON."""
    feed = tmp_path / "calls"
    feed.mkdir()
    go = lambda: call_events(live_cards(_calls(spark, feed), idle_ms=600_000, ended="done")).writeStream.format("json").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start(f"file://{tmp_path}/out")
    seen = lambda: sorted((r["key"], *json.loads(r["value"]).values()) for r in spark.read.json(f"file://{tmp_path}/out").collect())
    _lines(feed, 0, [(1, 1, 1, ["a"], False), (1, 3, 3, ["c"], False), (5, 1, 3, ["z"], True)])
    _ended(go())
    assert seen() == [("1", 1, 1, "a"), ("5", 5, 1, "z")]
    _lines(feed, 1, [(9, 1, 300, [], False), (5, 1, 300, ["z"], False)])  # moves the watermark past the gap; call 5 again
    _ended(go())
    assert seen() == [("1", 1, 1, "a"), ("1", 1, 3, "c"), ("5", 5, 1, "z"), ("5", 5, 1, "z")]
    _lines(feed, 2, [(9, 2, 2000, [], False)])
    _ended(go())
    _lines(feed, 3, [(1, 1, 2001, ["a"], False)])  # idle for over ten minutes: forgotten
    _ended(go())
    assert seen().count(("1", 1, 1, "a")) == 2


def test_late_payments_as_streams(spark, tmp_path):
    """A payment that becomes visible in time is matched; a claim without one says so once its wait is over."""
    t = dt.datetime(2024, 1, 1)
    feeds = {n: tmp_path / n for n in ("claims", "pays")}
    for f in feeds.values():
        f.mkdir()
    put = lambda n, k, rows: (feeds[n] / f"{k}.json").write_text("\n".join(json.dumps(x) for x in rows))
    at = lambda s: (t + dt.timedelta(seconds=s)).isoformat()
    put("claims", 0, [{"claim_id": "c1", "customer_id": "x", "amount": 5.0, "ts": at(0)}, {"claim_id": "c2", "customer_id": "y", "amount": 5.0, "ts": at(0)}, {"claim_id": "c3", "customer_id": "x", "amount": 5.0, "ts": at(600)}])
    put("pays", 0, [{"txn_id": "t1", "customer_id": "x", "amount": 5.0, "ts": at(8)}, {"txn_id": "t2", "customer_id": "y", "amount": 5.0, "ts": at(30)}, {"txn_id": "t3", "customer_id": "z", "amount": 5.0, "ts": at(600)}])
    claims = spark.readStream.schema("claim_id string, customer_id string, amount double, ts timestamp").json(f"file://{feeds['claims']}")
    pays = spark.readStream.schema("txn_id string, customer_id string, amount double, ts timestamp").json(f"file://{feeds['pays']}")
    q = late_payment_matches(claims, pays).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    _ended(q)
    assert {("c1", "t1"), ("c2", None)} <= {(r["claim_id"], r["txn_id"]) for r in spark.table("late").collect()}
    assert ("c2", "t2") not in {(r["claim_id"], r["txn_id"]) for r in spark.table("late").collect()}


def test_late_payment_join_as_batch(spark):
    t = dt.datetime(2024, 1, 1)
    claims = spark.createDataFrame([("c", "x", 5.0, t)], "claim_id string, customer_id string, amount double, ts timestamp")
    pays = spark.createDataFrame([("t1", "x", 5.0, t + dt.timedelta(seconds=8)), ("t2", "x", 5.0, t + dt.timedelta(seconds=30))], "txn_id string, customer_id string, amount double, ts timestamp")
    assert [r["txn_id"] for r in late_payment_matches(claims, pays).collect()] == ["t1"]


def test_progress_has_observed_counts(spark, tmp_path):
    from fenbrook.operators.cdc import parse_changes
    from fenbrook.streaming.progress import Progress, observed

    feed = tmp_path / "feed"
    feed.mkdir()
    _put(feed, "a", [_msg("parents", 1, "c", {"id": "p1"}), _msg("parents", 2, "d", {"id": "p1"})])
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        stream = observed(parse_changes(_source(spark, feed), {"parents": "id"}))
        q = stream.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        _ended(q)
        for _ in range(50):
            if listener.batches:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    seen = [b["observed"]["changes"] for b in listener.batches if b["rows"]]
    assert seen and seen[0]["events"] == 2 and seen[0]["op_d"] == 1
