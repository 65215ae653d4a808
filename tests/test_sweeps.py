"""Running and sliding values over ranges against brute force, and how they grow."""

import random
import time

from pyspark.sql import functions as F

from fenbrook.operators import observe
from fenbrook.operators.sweeps import running_sums, sliding_sums


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(500), i, rng.choice([None, *range(9)])) for i, g in enumerate(["a"] * 3000 + ["b"] * 7 + [None] * 200)]
    df = spark.createDataFrame(rows, "g string, at long, i long, v long")
    got = {r["i"]: r["before"] for r in running_sums(df, ["g"], ["at", "i"], {"before": "v"}, cuts=16).collect()}
    total = {}
    for g, _, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        assert got[i] == total.get(g, 0)
        total[g] = total.get(g, 0) + (v or 0)
    assert len(got) == len(rows) and running_sums(df.limit(0), ["g"], ["at", "i"], {"before": "v"}).collect() == []


def test_sliding_sums_over_slots(spark):
    rng = random.Random(2)
    rows = sorted((t, rng.randrange(5)) for t in rng.sample(range(-500, 3000), 600))
    windows = {"short": (10, 0), "long": (700, 0), "back": (90, 40)}
    out = sliding_sums(spark.createDataFrame(rows, "t long, v long"), "t", ["v"], windows, slot=100).collect()
    assert len(out) == len(rows)
    for r in out:
        for w, (oldest, newest) in windows.items():
            assert r[w]["v"] == sum(v for t, v in rows if r["t"] - oldest <= t <= r["t"] - newest)


def test_stream_alerts_over_slots(spark):
    rng = random.Random(3)
    rows = []
    for s in "xy":
        t = 0
        for _ in range(400):
            t += rng.choice([0, 5, 30, 100, 121, 700])
            rows.append((s, t, rng.choice([10.0, 61.0, 70.0, 90.0, 99.0, None]), rng.choice([0.0, 0.02, 0.03, 0.04])))
    got = observe.stream_alerts(spark.createDataFrame(rows, "stream string, sec long, lag_s double, bad_rate double"), slot=1000).collect()
    want = []
    for s in "xy":
        own = [r for r in rows if r[0] == s]
        for i, (_, t, _, _) in enumerate(own):
            least = lambda k, n, t=t, own=own: min((r[k] for r in own if t - n <= r[1] <= t and r[k] is not None), default=None)
            a, b = least(2, 300), least(3, 600)
            want.append((s, t, i > 0 and t - own[i - 1][1] > 120, None if a is None else a > 60, None if b is None else b > 0.01))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_burn_rate_grows_with_the_seconds_not_the_windows(spark):
    """400,000 seconds of one service with windows of six hours."""
    n = 400_000
    calls = spark.range(n).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.when(F.col("id") % 97 == 0, "error").otherwise("ok").alias("outcome"))
    began = time.time()
    out = observe.burn_rate(calls, {"m5": 300, "m30": 1800, "h1": 3600, "h6": 21600}, 0.001)
    r = out.agg(F.count("*"), F.count_if("slow_burn"), F.count_if((F.col("sec") >= 21600) & (F.abs(F.col("h6") - 1 / 97) > 0.0005))).first()
    assert r[0] == n and r[1] > 0.99 * n and r[2] == 0
    assert time.time() - began < 60  # the sliding frames took some 10 s for each 40,000
