"""Service levels, latency, spend, freshness and lag from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fenbrook.operators.sweeps import in_slots, running_sums, sliding_sums

FAILED = ("unavailable", "error")


def nearest_rank(df: DataFrame, by: str, value: str, cuts: int = 64) -> DataFrame:
    """p50 and p95 by rank, not interpolated: the sorted values at n // 2 and min(n - 1, int(0.95 n)). Null values do not count.

    Equal values are counted first; ``cuts`` approximate quantiles of each ``by`` deal the distinct values into
    ranges, so that a window holds one range of one ``by``, and the counts of the ranges say where each begins.
    """
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(by, value).agg(F.count("*").alias("c"))
    edges = known.groupBy(by).agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 1000).alias("_edges"), F.count("*").alias("n"))
    ranged = counts.join(edges, by).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    up_to = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranged.groupBy(by, "_range").agg(F.sum("c").alias("r")).select(by, "_range", F.coalesce(F.sum("r").over(up_to), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(begins, [by, "_range"]).withColumn("_to", F.col("_before") + F.sum("c").over(inside))
    at = lambda i: F.max(F.when((F.col("_to") - F.col("c") <= i) & (i < F.col("_to")), F.col(value)))
    return placed.groupBy(by).agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).alias("p95"))


def histogram_quantile(df: DataFrame, value: str, bounds: list[float], q: float) -> DataFrame:
    """The quantile from fixed buckets, linear inside the bucket; beyond the last bound, that bound."""
    spark = df.sparkSession
    edges = spark.createDataFrame([(i, b, bounds[i - 1] if i else 0.0) for i, b in enumerate(bounds)] + [(len(bounds), None, bounds[-1])], "i int, upper double, lower double")
    bucket = F.coalesce(*(F.when(F.col(value) <= b, F.lit(i)) for i, b in enumerate(bounds)), F.lit(len(bounds)))
    counts = df.groupBy(bucket.alias("i")).agg(F.count("*").alias("n"))  # one row for each bucket at most
    w = Window.orderBy("i")
    run = edges.join(counts, "i", "left").fillna(0, ["n"]).withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    hit = run.where(F.col("upto") >= q * F.col("total")).orderBy("i").limit(1)
    inside = F.col("lower") + (F.col("upper") - F.col("lower")) * (q * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
    return hit.select(F.lit(q).alias("q"), F.round(F.when(F.col("upper").isNull(), F.col("lower")).otherwise(inside), 6).alias("estimate"))


def error_ratio(calls: DataFrame, *by: str) -> DataFrame:
    n = F.count("*")
    bad = F.count_if(F.col("outcome").isin(*FAILED))
    return calls.groupBy(*by).agg(n.alias("calls"), bad.alias("errors"), F.round(bad / F.greatest(n, F.lit(1)), 6).alias("error_ratio"), F.round(1 - bad / F.greatest(n, F.lit(1)), 6).alias("availability"))


def burn_rate(calls: DataFrame, windows: dict[str, int], budget: float, hold: tuple[int, int] = (120, 900), look_back: int = 300, slot: int = 21_600) -> DataFrame:
    """Per second with calls: the error ratio of each window up to it, and whether the fast or the slow burn alert fires.

    An alert fires once its condition has held at all seconds with calls of its hold time (fast, slow), and at the last of
    the ``look_back`` seconds before that: so if the run of seconds where it holds began that long ago and there were calls around then.
    Sums slide as signed events, and a run is known by where it began: work is linear in the seconds, whatever the windows.
    """
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    bad = F.when(F.col("outcome").isin(*FAILED), 1).otherwise(0)
    per_second = calls.groupBy(at.alias("sec")).agg(F.count("*").alias("n"), F.sum(bad).alias("bad"), F.lit(1).alias("here"))
    spans = {name: (seconds, 0) for name, seconds in windows.items()} | {f"_back{h}": (h + look_back, h) for h in hold}
    out = sliding_sums(per_second, "sec", ["n", "bad", "here"], spans, slot)
    out = out.select("sec", "n", *((F.col(f"{w}.bad") / F.col(f"{w}.n")).alias(w) for w in windows), *((F.col(f"_back{h}.here") > 0).alias(f"_back{h}") for h in hold))
    out = out.withColumns({"_fast": (F.col("h1") > 14.4 * budget) & (F.col("m5") > 14.4 * budget), "_slow": (F.col("h6") > 6 * budget) & (F.col("m30") > 6 * budget)})
    # A run that began before what a slot sees of the one before it began long enough ago if there were calls to show it.
    seen = in_slots(out, "sec", slot, max(hold) + look_back)
    w = Window.partitionBy("_slot").orderBy("sec")
    begins = lambda c: F.when(F.col(c) & ~F.coalesce(F.lag(c).over(w), F.lit(False)), F.col("sec"))
    seen = seen.withColumns({"_fast_from": begins("_fast"), "_slow_from": begins("_slow")})
    since = lambda c: F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = lambda c, h: F.col(c) & F.col(f"_back{h}") & F.coalesce(since(f"{c}_from") <= F.col("sec") - h, F.lit(False))
    seen = seen.withColumns({"fast_burn": held("_fast", hold[0]), "slow_burn": held("_slow", hold[1])}).where("_own")
    return seen.select("sec", "n", *(F.round(name, 6).alias(name) for name in windows), "fast_burn", "slow_burn")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` with its cost: prices are per million tokens, of the first prefix by ``position`` that the model's name
    starts with, or else of 'default'. ``prices`` is a short fixed list; it meets the distinct models only."""
    fallback = prices.where("prefix = 'default'").select(F.col("price_in").alias("d_in"), F.col("price_out").alias("d_out"))
    named = prices.where("prefix <> 'default'")
    models = usage.select("model").distinct()
    first = models.join(F.broadcast(named), models["model"].startswith(named["prefix"]), "left").groupBy("model").agg(F.min_by(F.struct("price_in", "price_out"), "position").alias("p"))
    met = usage.join(first, "model").join(F.broadcast(fallback))
    p_in, p_out = F.coalesce("p.price_in", "d_in"), F.coalesce("p.price_out", "d_out")
    cost = (p_in * (F.col("tokens_in") + 0.1 * F.col("cache_read") + 1.25 * F.col("cache_write")) + p_out * F.col("tokens_out")) / 1e6
    return met.withColumn("cost", cost).select(*usage.columns, "cost")


def spend_daily(usage: DataFrame, prices: DataFrame, cap: float) -> DataFrame:
    """Cost of each day, summed in whole units of 1e-8 so that the order of rows does not matter, and whether it passed the cap."""
    total = F.sum(F.round(F.col("cost") * 1e8).cast("bigint")) / 1e8
    return priced(usage, prices).groupBy("day").agg(total.alias("cost"), F.count("*").alias("uses")).withColumn("over_cap", F.col("cost") > cap)


def running_spend(usage: DataFrame) -> DataFrame:
    """Adds what the uses before each one have cost on its day; ``cost`` in whole small units sums exactly. A day is cut into ranges of time."""
    return running_sums(usage, ["day"], ["at", "use_id"], {"spent_before": "cost"})


def rate_by_outcome(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "outcome").agg(F.count("*").alias("calls"))


def ingest_rate(log: DataFrame, by: str, window: int = 600, step: int = 60) -> DataFrame:
    """Rows a minute at each ``step``: the slope of the running count over the ``window`` seconds before it, which slides.

    The count is scraped once a step: samples of a window are the counts at its steps. Windows with fewer than two
    samples have no slope.
    """
    scrape = F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / step) * step
    seen = log.groupBy(by, scrape.cast("bigint").alias("sec")).agg(F.count("*").alias("c"))
    # A running count of months is not needed for a slope: each window starts counting at its first step.
    samples = seen.withColumn("at", F.explode(F.sequence(F.col("sec"), F.col("sec") + window - step, F.lit(step))))
    ordered = Window.partitionBy(by, "at").orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    run = samples.withColumn("n", F.sum("c").over(ordered))
    return run.groupBy(by, "at").agg(F.sum("c").alias("rows"), F.count("*").alias("samples"), F.round(F.regr_slope("n", (F.col("sec") - F.col("at")).cast("double")) * 60, 4).alias("per_minute")).where("samples > 1")


def ingest_lag(topic: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Messages of each topic against the rows that arrived; a negative lag is duplicates."""
    a, b = topic.groupBy(on).agg(F.count("*").alias("messages")), table.groupBy(on).agg(F.count("*").alias("records"))
    both = a.join(b, on, "left")
    lag = F.col("messages") - F.col("records")
    return both.select(on, "messages", "records", lag.alias("lag"), F.when(F.col("records").isNull(), "absent").when(lag < 0, "duplicates").when(lag > 0, "behind").otherwise("even").alias("state"))


def backlog(lags: DataFrame, group: str) -> DataFrame:
    """Messages that each group of consumers is behind, over all its topics; topics that hold too many do not offset others."""
    return lags.groupBy(group).agg(F.sum(F.greatest("lag", F.lit(0))).alias("backlog"), F.count_if(F.col("lag") > 0).alias("topics_behind"))


def fleet_summary(watched: DataFrame, as_of: str) -> DataFrame:
    """One row of all watched tables: observed, unreadable (there, but not observed), duplicated, the worst lag, and the
    minutes since the oldest of the last commits. ``watched`` has exists, observed, committed_at, records, topic_records."""
    lag = F.when(F.col("observed"), F.col("topic_records") - F.col("records"))
    now = F.lit(as_of).cast("timestamp_ntz").cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros(F.col("committed_at").cast("timestamp"))) / 60e6
    return watched.agg(
        F.count_if("observed").alias("observed"), F.count_if(~F.col("observed") & F.col("exists")).alias("unreadable"), F.count_if(~F.col("exists")).alias("absent"),
        F.count_if(lag < 0).alias("duplicated"), F.coalesce(F.max(lag), F.lit(0)).alias("worst_lag"), F.round(F.max(F.when(F.col("observed"), age)), 3).alias("minutes_since_commit"),
    )


def freshness_state(age: Column, limit: Column) -> Column:
    return F.when(age.isNull() | limit.isNull(), "unknown").when(age <= limit, "fresh").when(age <= 2 * limit, "late").otherwise("stale")


def sla_seconds(tables: DataFrame, slas: DataFrame, properties: tuple[str, ...] = ("freshness",)) -> DataFrame:
    """The first declared level, by position, that names the table or no table, in seconds."""
    unit = F.create_map(*(x for k, v in {"s": 1, "m": 60, "h": 3600, "d": 86400}.items() for x in (F.lit(k), F.lit(v))))
    usable = F.broadcast(slas.where(F.col("property").isin(*properties)))
    met = tables.join(usable, usable["element"].isNull() | (usable["element"] == tables["table_name"]), "left")
    first = met.groupBy("table_name").agg(F.min_by(F.struct("value", "unit"), "position").alias("s"))
    return first.select("table_name", (F.col("s.value") * F.element_at(unit, F.col("s.unit"))).cast("bigint").alias("seconds"))


def stream_alerts(batches: DataFrame, stall: int = 120, lag: float = 60, rate: float = 0.01, slot: int = 21_600) -> DataFrame:
    """Per batch: stalled (no progress for ``stall`` seconds before it), lagging and failing for all batches of the last 5 or 10 minutes.

    A condition has held for so long if the last batch where it did not is older than that. Streams are cut into slots that see the end
    of the one before; a batch with none before it in sight is stalled unless it is its stream's first. Without any reading in its time a condition is null.
    """
    first = batches.groupBy("stream").agg(F.min("sec").alias("_first"))
    seen = in_slots(batches.join(first, "stream"), "sec", slot, max(stall, 600))
    w = Window.partitionBy("stream", "_slot").orderBy("sec")
    up_to = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.max(F.when(c, F.col("sec"))).over(up_to)
    # Null if there was no reading at all in the last s seconds.
    held = lambda c, t, s: F.when(last(F.col(c).isNotNull()) >= F.col("sec") - s, F.coalesce(last(F.col(c) <= t) < F.col("sec") - s, F.lit(True)))
    gap = F.col("sec") - F.lag("sec").over(w)
    stalled = F.coalesce(gap > stall, F.col("sec") > F.col("_first"))
    out = seen.select("stream", "sec", "_own", stalled.alias("stalled"), held("lag_s", lag, 300).alias("lagging"), held("bad_rate", rate, 600).alias("failing"))
    return out.where("_own").drop("_own")


def check_status(declared: DataFrame, results: DataFrame) -> DataFrame:
    """Per table: how many checks pass by their latest result, or that they are only declared."""
    last = results.groupBy("table_name", "check_name").agg(F.max_by("passed", "checked_at").alias("passed"))
    counts = last.groupBy("table_name").agg(F.count("*").alias("n"), F.count_if("passed").alias("ok"))
    return declared.join(counts, "table_name", "left").select("table_name", F.coalesce(F.concat("ok", F.lit(" of "), "n", F.lit(" passing")), F.lit("only declared")).alias("status"))
