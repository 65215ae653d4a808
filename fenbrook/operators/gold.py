"""The customer product: holdings, activity and complaints of each customer in one row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ("open_accounts", "txn_count_30d", "reversed_txn_30d", "open_complaints", "total_complaints", "fos_referrals")


def _money(c: F.Column) -> F.Column:
    return c.cast("decimal(18,2)")


def holdings(accounts: DataFrame) -> DataFrame:
    is_open = F.col("status") == "open"
    deposit = is_open & F.col("product").isin("current_account", "savings")
    return accounts.groupBy("customer_id").agg(
        F.array_sort(F.collect_set(F.when(is_open, F.col("product")))).alias("products_held"),
        F.count_if(is_open).alias("open_accounts"),
        _money(F.sum(F.when(deposit, F.col("balance")).otherwise(0))).alias("deposit_balance"),
        _money(F.sum(F.when(is_open & (F.col("balance") < 0), -F.col("balance")).otherwise(0))).alias("lending_balance"),
        F.bool_or(F.col("status") == "frozen").alias("has_frozen_account"),
    )


def activity(txns: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = txns.where(F.col("txn_ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy("customer_id").agg(
        F.count("*").alias("txn_count_30d"),
        _money(F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(0))).alias("spend_30d"),
        F.count_if(F.col("status") == "reversed").alias("reversed_txn_30d"),
        F.max("txn_ts").alias("last_txn_ts"),
    )


def complaint_history(complaints: DataFrame) -> DataFrame:
    """Counts and the last complaint, in one aggregation: the newest is the largest (opened_at, id)."""
    newest = F.max_by(F.struct("category", "summary", "status", "opened_at"), F.struct("opened_at", "complaint_id"))
    return (
        complaints.groupBy("customer_id")
        .agg(
            F.count_if(F.col("status").isin("open", "investigating")).alias("open_complaints"),
            F.count("*").alias("total_complaints"),
            F.count_if(F.col("status") == "referred_to_fos").alias("fos_referrals"),
            newest.alias("_last"),
        )
        .select("customer_id", "open_complaints", "total_complaints", "fos_referrals", *(F.col(f"_last.{c}").alias(f"last_complaint_{c}") for c in ("category", "summary", "status", "opened_at")))
    )


def customer_360(customers: DataFrame, accounts: DataFrame, txns: DataFrame, complaints: DataFrame, as_of: str) -> DataFrame:
    """One row per customer. Absent counts are 0; absent amounts, flags, lists and times stay null."""
    who = customers.select("customer_id", "brand", "first_name", "last_name", "date_of_birth", "email", "phone", "postcode", "region", "segment", "vulnerability_flag", "customer_since")
    wide = who.join(holdings(accounts), "customer_id", "left").join(activity(txns, as_of), "customer_id", "left").join(complaint_history(complaints), "customer_id", "left")
    return wide.fillna(0, list(COUNTS)).withColumn("refreshed_at", F.lit(as_of).cast("timestamp_ntz"))


def bucket_count(rows: int, rows_per_bucket: int = 500_000) -> int:
    """A power of two, so that tables of different size still fit: the larger number is a multiple of the smaller."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows / rows_per_bucket))))


def save_bucketed(df: DataFrame, table: str, key: str, path: str, buckets: int) -> DataFrame:
    """``df`` as a table of Spark's catalog, in ``buckets`` files by the hash of ``key``, each sorted by it: joins and groups on the key need no
    exchange, a lookup reads one file and in it the row groups around the key."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
