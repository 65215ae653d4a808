"""Live calls: lines of one call strictly in order, with state and expiry; payments that come late."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CARDS = "call_id bigint, seq bigint, label string"
_STATE = "next bigint, heard string, held string, newest bigint"


def live_cards(signals: DataFrame, late: str = "30 seconds", idle_ms: int = 3_600_000, first_seq: int = 1, ended: str | None = None) -> DataFrame:
    """(call_id, seq, label) the first time a label is heard in a call, in the order of the call's lines.

    ``signals`` streams call_id, seq (numbered without gaps from ``first_seq``), ts and labels (array of strings), over any
    number of micro-batches: a line waits in the call's state until all before it have come, and its labels count
    then. Lines may come up to ``late`` after younger ones, later ones are dropped; so when the watermark
    has passed a line that waits, the gap before it stays open and is passed over. A call without lines for ``idle_ms``,
    or after a line where the boolean column ``ended`` is true, is forgotten and starts anew. A line that is sent
    twice counts once. All times are event times, so a bounded run ends and gives the same rows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, heard, held, newest = (state.get[0], json.loads(state.get[1]), {int(k): v for k, v in json.loads(state.get[2]).items()}, state.get[3]) if state.exists else (first_seq, [], {}, 0)
        now, rows, over = state.getCurrentWatermarkMs(), [], False
        if not state.hasTimedOut:
            for lines in batches:
                last = lines[ended].fillna(False) if ended else [False] * len(lines)
                for seq, at, labels, end in zip(lines["seq"], lines["_at"], lines["labels"], last, strict=True):
                    held.setdefault(int(seq), (list(labels) if labels is not None else [], bool(end), int(at)))
                    newest = max(newest, int(at))
        passed = max((seq for seq, line in held.items() if line[2] <= now), default=expected)
        for seq in sorted(held):
            if seq > max(expected, passed):
                break
            labels, last, _ = held.pop(seq)
            over, expected = over or last, max(expected, seq + 1)
            for label in labels:
                if label not in heard:
                    heard.append(label)
                    rows.append((key[0], seq, label))
        if not held and (over or newest + idle_ms <= now):
            state.remove()
        else:
            state.update((expected, json.dumps(heard), json.dumps(held), newest))
            state.setTimeoutTimestamp(max(now + 1, min((line[2] for line in held.values()), default=newest + idle_ms)))
        yield pd.DataFrame(rows, columns=["call_id", "seq", "label"])

    timed = signals.withWatermark("ts", late).withColumn("_at", F.unix_millis("ts"))
    return timed.groupBy("call_id").applyInPandasWithState(step, CARDS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def call_events(cards: DataFrame, topic: str = "assist.events") -> DataFrame:
    """``cards`` as messages of an event stream (topic, key, value): keyed by call, so that a call's stay in order; the value is JSON."""
    return cards.select(F.lit(topic).alias("topic"), F.col("call_id").cast("string").alias("key"), F.to_json(F.struct(*cards.columns)).alias("value"))


def publish_events(cards: DataFrame, folder: str, checkpoint: str, topic: str = "assist.events", every: str | None = None) -> StreamingQuery:
    """A stream of cards as messages in ``folder``: of one call in one file of a batch and in order, no message twice.

    Each batch is a folder of its own that a replay of the batch writes anew, so a batch that was written but not committed
    leaves no doubles; ``read_events`` gives all batches. ``place`` orders the messages of a call inside a batch.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        # A call's cards come from one task, in order; the number of the row keeps that over the exchange.
        events = call_events(batch.withColumn("place", F.monotonically_increasing_id()), topic)
        placed = events.withColumn("place", F.get_json_object("value", "$.place").cast("bigint"))
        placed.repartition("key").sortWithinPartitions("key", "place").write.mode("overwrite").json(f"{folder}/batch={batch_id}")

    out = cards.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """batch, place, topic, key, value of all messages; (batch, place) orders those of a key."""
    return spark.read.schema("topic string, key string, value string, place bigint, batch bigint").json(folder)


def late_payment_matches(claims: DataFrame, payments: DataFrame, wait: str = "12 seconds") -> DataFrame:
    """(claim_id, txn_id, c_ts, ts): claims with the payments of the 3 days before or of up to ``wait`` later; both have ``ts``.

    A claim that has none when the watermark has passed its wait gives one row with null txn_id and ts.
    """
    c = claims.withWatermark("ts", wait).select(F.col("customer_id").alias("c_id"), F.col("amount").alias("c_amount"), F.col("ts").alias("c_ts"), "claim_id")
    p = payments.withWatermark("ts", wait)
    on = (F.col("c_id") == F.col("customer_id")) & (F.col("c_amount") == F.col("amount")) & (F.col("ts") >= F.col("c_ts") - F.expr("INTERVAL 3 DAYS")) & (F.col("ts") <= F.col("c_ts") + F.expr(f"INTERVAL {wait}"))
    return c.join(p, on, "left_outer").select("claim_id", "txn_id", "c_ts", "ts")
