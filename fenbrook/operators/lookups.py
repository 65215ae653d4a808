"""Governed lookups: point and time-bounded reads, identification and payment tracing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def find_customer(customers: DataFrame, last_name: str | None = None, postcode_outward: str | None = None, phone_last4: str | None = None, limit: int = 10) -> DataFrame:
    """Customers that match all given arguments, of which there must be one."""
    tests: list[Column] = []
    if last_name is not None:
        tests.append(F.lower("last_name") == last_name.lower())
    if postcode_outward is not None:
        tests.append(F.lower(F.split_part("postcode", F.lit(" "), F.lit(1))) == postcode_outward.lower())
    if phone_last4 is not None:
        tests.append(F.substring("phone", -4, 4) == phone_last4)
    if not tests:
        raise ValueError("give at least one of last_name, postcode_outward, phone_last4")
    return customers.where(reduce(lambda a, b: a & b, tests)).select("customer_id", "first_name", "last_name", "postcode", "brand").orderBy("customer_id").limit(limit)


def recent_transactions(txns: DataFrame, customer_id: str, as_of: str, days: int, limit: int) -> DataFrame:
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    mine = txns.where((F.col("customer_id") == customer_id) & (F.col("txn_ts") >= since))
    return mine.orderBy(F.col("txn_ts").desc(), "txn_id").limit(min(limit, 100))


def accounts_of(accounts: DataFrame, customer_id: str, limit: int = 20) -> DataFrame:
    return accounts.where(F.col("customer_id") == customer_id).orderBy("product", "account_id").limit(limit)


def open_complaints(complaints: DataFrame, customer_id: str, include_resolved: bool = False, limit: int = 20) -> DataFrame:
    """Newest first; what the customer wrote stands apart in ``customer_words``."""
    mine = complaints.where(F.col("customer_id") == customer_id)
    if not include_resolved:
        mine = mine.where(F.col("status").isin("open", "investigating"))
    return mine.orderBy(F.col("opened_at").desc(), "complaint_id").limit(limit).withColumn("customer_words", F.struct("summary")).drop("summary")


def account_alerts(accounts: DataFrame) -> DataFrame:
    frozen = F.when(F.col("status") == "frozen", "frozen")
    overdrawn = F.when((F.col("product") == "current_account") & (F.col("balance") < 0), "overdrawn")
    alert = accounts.withColumn("alerts", F.concat_ws(",", frozen, overdrawn)).where("alerts <> ''")
    return alert.select("account_id", "customer_id", "alerts", F.format_number(F.abs("balance").cast("double"), 2).alias("amount"))


def unique_identity(customers: DataFrame, keys: list[Column], seed: int) -> DataFrame:
    """Customers whose key no other has, with a reproducible draw order: the first of it is a random pick."""
    names = [f"_k{i}" for i in range(len(keys))]
    counted = customers.withColumns(dict(zip(names, keys, strict=True))).withColumn("_n", F.count("*").over(Window.partitionBy(*names)))
    return counted.where("_n = 1").withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}|"), "customer_id"), 256)).drop("_n", *names)


def identify_callers(state: DataFrame, customers: DataFrame) -> DataFrame:
    """call_id, matches, customer_id: by last name and outward postcode, then by first name where several match."""
    outward = F.lower(F.split_part("postcode", F.lit(" "), F.lit(1)))
    who = customers.select(F.lower("last_name").alias("last"), outward.alias("out"), F.lower("first_name").alias("known_first"), "customer_id")
    call = state.select("call_id", F.lower("last_name").alias("last"), outward.alias("out"), F.lower(F.split_part("full_name", F.lit(" "), F.lit(1))).alias("said_first"))
    met = call.join(who, ["last", "out"], "left")
    counted = met.groupBy("call_id").agg(
        F.count("customer_id").alias("n"),
        F.min("customer_id").alias("only"),
        F.count_if(F.col("said_first") == F.col("known_first")).alias("n_first"),
        F.min(F.when(F.col("said_first") == F.col("known_first"), F.col("customer_id"))).alias("only_first"),
    )
    return counted.select(
        "call_id",
        F.when(F.col("n") > 1, F.when(F.col("n_first") > 0, F.col("n_first")).otherwise(F.col("n"))).otherwise(F.col("n")).alias("matches"),
        F.when(F.col("n") == 1, F.col("only")).when(F.col("n_first") == 1, F.col("only_first")).alias("customer_id"),
    )


def pinpoint(claims: DataFrame, txns: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """Payments of the claimant in the last ``days`` whose size is one of the claimed amounts."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    wanted = claims.select("claim_id", "customer_id", F.explode("amounts").alias("claimed"))
    recent = txns.where(F.col("txn_ts") >= since).select("customer_id", "txn_id", "txn_ts", F.abs("amount").alias("size"))
    hit = wanted.join(recent, (wanted["customer_id"] == recent["customer_id"]) & (F.round("claimed", 2) == F.round("size", 2)))
    return hit.select("claim_id", "txn_id", "txn_ts", F.col("claimed").cast("double").alias("claimed"))


def latest_of(txns: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of each ``by`` the newest transaction, of equally new ones that of the least id."""
    at = txns.groupBy(*by).agg(F.max("txn_ts").alias("txn_ts"))
    return txns.join(at, [*by, "txn_ts"]).groupBy(*by, "txn_ts").agg(F.min_by(F.struct("txn_id", "status"), "txn_id").alias("r")).select(*by, "txn_ts", "r.*")


def trace_payment(claims: DataFrame, txns: DataFrame, as_of: str, days: int = 7, channels: tuple[str, ...] = ("faster_payment", "online", "mobile")) -> DataFrame:
    """For each claim the outgoing transfer of its amount, or else the newest, and what state it is in.

    The newest transfer of each customer, and of each customer and amount, is found first: a claim meets one row for each of its amounts and
    one more, however many transfers its customer has. Claims of customers without any transfer go first, before their amounts are looked at.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    out = txns.where((F.col("txn_ts") >= now - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("amount") < 0) & F.col("channel").isin(*channels))
    row = F.struct("txn_ts", "txn_id", "status")
    # The newest, and of those the least id: sizes and times of ids do not matter for a minimum of their order.
    newest = lambda name, *by: latest_of(out.withColumn("size", -F.col("amount")), by).select(*by, row.alias(name))
    met = claims.select("claim_id", "customer_id", "amounts").join(newest("any", "customer_id"), "customer_id")
    asked = met.select("claim_id", "customer_id", "any", F.explode_outer(F.array_distinct("amounts")).alias("size"))
    found = asked.join(newest("same", "customer_id", "size"), ["customer_id", "size"], "left")
    # Of a customer's newest transfer it matters only where no amount is met.
    each = found.select("claim_id", F.col("same").isNotNull().alias("exact"), F.coalesce("same", "any").alias("t"))
    w = Window.partitionBy("claim_id").orderBy(F.col("exact").desc(), F.col("t.txn_ts").desc(), "t.txn_id")
    best = each.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("claim_id", "exact", "t.*")
    old = F.col("txn_ts") < now - F.expr("INTERVAL 1 DAY")
    state = F.when(F.col("status") == "reversed", "returned").when(F.col("status") == "posted", "sent").when(old, "delayed").otherwise("in_progress")
    return best.select("claim_id", "txn_id", "exact", state.alias("state"))
