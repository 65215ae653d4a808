"""Bars, authorisation counts, rates and chart queries over market and card events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import latest_per_key


def ohlcv(trades: DataFrame, grain: str = "minute") -> DataFrame:
    """A bar per product and ``grain``. The average price is held inside [low, high]; without volume it is null."""
    priced = trades.where(F.col("price").isNotNull())
    bars = priced.groupBy("product", F.date_trunc(grain, "ts").cast("timestamp_ntz").alias("bar")).agg(
        F.min_by("price", "ts").cast("double").alias("open"),
        F.max("price").cast("double").alias("high"),
        F.min("price").cast("double").alias("low"),
        F.max_by("price", "ts").cast("double").alias("close"),
        F.sum("size").alias("volume"),
        F.sum(F.col("price") * F.col("size")).cast("double").alias("notional"),
        F.count("*").alias("trades"),
    )
    mean = F.round(F.col("notional") / F.nullif(F.col("volume"), F.lit(0)), 6)
    return bars.withColumn("vwap", F.when(mean.isNotNull(), F.least("high", F.greatest("low", mean)))).drop("notional")


def auth_daily(auths: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("decision") == "approved")
    return auths.groupBy("merchant", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("auths"),
        ok.alias("approved"),
        F.count_if(F.col("decision") == "declined").alias("declined"),
        F.sum("amount_eur").cast("double").alias("amount_eur"),
        F.round(ok / F.count("*"), 4).alias("approval_rate"),
    )


def kpi_totals(auths: DataFrame) -> DataFrame:
    n = F.count("*")
    return auths.agg(n.alias("auths"), F.sum("amount_eur").cast("double").alias("amount_eur"), F.round(F.count_if(F.col("decision") == "approved") / F.greatest(n, F.lit(1)), 6).alias("approval_rate"))


def hourly_rollup(bars: DataFrame, limit: int) -> DataFrame:
    hour = F.date_trunc("hour", "bar").cast("timestamp_ntz").alias("hour")
    return bars.groupBy("product", hour).agg(F.round(F.avg("close"), 6).alias("avg_close"), F.sum("volume").alias("volume")).orderBy("hour", "product").limit(limit)


def breakdown(auths: DataFrame, dim: str) -> DataFrame:
    n = F.count("*")
    return auths.groupBy(dim).agg(n.alias("auths"), F.round(F.count_if(F.col("decision") == "approved") / n, 4).alias("approval_rate"), F.sum("amount_eur").cast("double").alias("spend_eur"))


def compacted_latest(topic: DataFrame, key: str, offset: str) -> DataFrame:
    """What a compacted topic keeps: the value of the highest offset of each key."""
    return latest_per_key(topic, [key], [offset])


def fx_convert(amounts: DataFrame, rates: DataFrame, amount: str, currency: str) -> DataFrame:
    """``amount_base`` by the latest rate of each currency; null where there is none."""
    latest = rates.groupBy("currency").agg(F.max_by("rate", "ts").alias("rate"))
    return amounts.join(latest, amounts[currency] == latest["currency"], "left").drop(latest["currency"]).withColumn("amount_base", F.round(F.col(amount).cast("double") * F.col("rate"), 4))


def normal_name(c: str) -> F.Column:
    """Lower case, letters and digits only, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]+", " "))


def sanctions_hits(auths: DataFrame, listed: DataFrame) -> DataFrame:
    """Merchants whose normalised name is listed, with their authorisations."""
    names = listed.select(normal_name("name").alias("_n")).distinct()
    hit = auths.withColumn("_n", normal_name("merchant")).join(names, "_n", "left_semi")
    return hit.groupBy("merchant").agg(F.count("*").alias("auths"), F.sum("amount_eur").cast("double").alias("amount_eur"), F.max("ts").alias("last_auth"))


def _grams(name: Column, q: int) -> Column:
    """The q-grams of a padded name, equal ones told apart by their number, so that the sets count repeats."""
    padded = F.concat(F.lit("#" * (q - 1)), name, F.lit("$" * (q - 1)))
    each = F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substr(padded, i, F.lit(q)))
    return F.transform(each, lambda g, i: F.concat(g, F.lit("|"), F.size(F.filter(F.slice(each, 1, i + 1), lambda x: x == g)).cast("string")))


def similar_names(left: DataFrame, right: DataFrame, edits: int = 1, q: int = 2) -> DataFrame:
    """(left, right, distance): all pairs of normalised names at most ``edits`` edits apart. Both sides have ``name``, distinct and not null.

    An edit changes at most q of a name's q-grams, so two such names share one of the q * edits + 1 rarest grams of each, rare by all names: only these prefixes
    are joined, pairs whose lengths differ by more than ``edits`` are left out, and the distance of the rest is computed. Names with fewer grams
    than that meet by what is left of both without ``edits`` letters.
    """
    prefix = q * edits + 1
    named = left.select("name").union(right.select("name")).select(F.explode(_grams(F.col("name"), q)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def keys(names: DataFrame) -> DataFrame:
        grams = names.select("name", F.explode(_grams(F.col("name"), q)).alias("g")).join(named, "g")
        first = grams.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "g"))), 1, prefix).alias("p"))
        own = first.select("name", F.explode("p").alias("p")).select("name", F.col("p.g").alias("key"))
        # A name this short may lose all its grams by that many edits: it meets others by what is left of both without a few letters.
        short = names.where(F.length("name") + q - 1 <= 2 * q * edits).select("name", F.array("name").alias("v"))
        for _ in range(edits):
            fewer = F.flatten(F.transform("v", lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i, x=x: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))))
            short = short.withColumn("v", F.array_distinct(F.concat("v", fewer)))
        return own.union(short.select("name", F.explode("v").alias("v")).select("name", F.concat(F.lit("left "), "v")))

    a, b = keys(left).select(F.col("name").alias("left"), "key"), keys(right).select(F.col("name").alias("right"), "key")
    near = a.join(b, "key").where(F.abs(F.length("left") - F.length("right")) <= edits).select("left", "right").distinct()
    return near.withColumn("distance", F.levenshtein("left", "right", edits)).where("distance >= 0")


def screened(auths: DataFrame, listed: DataFrame, edits: int = 1) -> DataFrame:
    """Merchants whose normalised name is at most ``edits`` edits from a listed one: the nearest of these, and their authorisations."""
    known = listed.select(normal_name("name").alias("name")).where("name <> ''").distinct()
    seen = auths.withColumn("_n", normal_name("merchant"))
    hits = similar_names(seen.select(F.col("_n").alias("name")).where("_n <> ''").distinct(), known, edits)
    best = hits.groupBy("left").agg(F.min(F.struct("distance", "right")).alias("m")).select(F.col("left").alias("_n"), F.col("m.right").alias("listed"), F.col("m.distance").alias("distance"))
    found = seen.join(best, "_n")
    return found.groupBy("merchant", "listed", "distance").agg(F.count("*").alias("auths"), F.sum("amount_eur").cast("double").alias("amount_eur"), F.max("ts").alias("last_auth"))
