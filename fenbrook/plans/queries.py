"""Registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fenbrook.operators import cdc, contract, dq, gold, lookups, markets, observe, security, text
from fenbrook.sources import feeds, versions
from fenbrook.streaming import calls, keyed_cdc
from fenbrook.streaming.keyed_cdc import Table

from . import lake, shapes
from .shapes import BANK_DAY, BRANDS, CURRENCIES, EVENT_DAY, STATUSES, read, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = twin(sql)
        return f

    return add


# --- silver shapes ---


def customers_checked(s: SparkSession, d: str) -> DataFrame:
    return contract.with_violations(shapes.source_customers(s, d), contract.customer_rules(BANK_DAY, BRANDS))


def customers(s: SparkSession, d: str) -> DataFrame:
    return lake.table(s, d, "silver.customers", lambda s, d: contract.split(customers_checked(s, d))[0])


def accounts_checked(s: SparkSession, d: str) -> DataFrame:
    return contract.with_violations(contract.resolve(shapes.source_accounts(s, d), customers(s, d), "customer_id", ["brand"]), contract.account_rules(CURRENCIES))


def accounts(s: SparkSession, d: str) -> DataFrame:
    return lake.table(s, d, "silver.accounts", lambda s, d: contract.split(accounts_checked(s, d))[0])


def transactions(s: SparkSession, d: str) -> DataFrame:
    """The newest of each id. An id holds its account's number, so accounts are what is dealt out, once for this and for the join with them."""
    return contract.latest_within(shapes.raw_transactions(s, d, dealt=True), "account_id", ["txn_id"], ["txn_ts", "amount", "version", "tie"]).drop("version", "tie")


def transactions_checked(s: SparkSession, d: str) -> DataFrame:
    joined = contract.resolve(transactions(s, d), accounts(s, d), "account_id", ["customer_id", "brand"])
    return contract.with_violations(joined, contract.transaction_rules(BANK_DAY, CURRENCIES))


def txns(s: SparkSession, d: str) -> DataFrame:
    return lake.table(s, d, "silver.transactions", lambda s, d: contract.split(transactions_checked(s, d))[0])


def complaints_checked(s: SparkSession, d: str) -> DataFrame:
    joined = contract.resolve(shapes.source_complaints(s, d), customers(s, d), "customer_id", ["brand"])
    return contract.with_violations(joined, contract.complaint_rules(STATUSES))


def complaints(s: SparkSession, d: str) -> DataFrame:
    return lake.table(s, d, "silver.complaints", lambda s, d: contract.split(complaints_checked(s, d))[0])


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- sources ---


@query(
    f"""select event_id, user_id, event_type, timestamp '{EVENT_DAY}' as _ingested_at, 'run-1' as _run_id, 'events' as _source from events where ts > (select max(ts) from events where event_id % 3 = 0 and ts < timestamp '2024-01-20') - interval 10 minutes"""
)
def bronze_incremental(s, d):
    e = read(s, d, "events")
    done = e.where("event_id % 3 = 0 and ts < timestamp_ntz '2024-01-20'")
    return feeds.incremental(e, done, "ts", "10 MINUTES", "run-1", EVENT_DAY, "events").select("event_id", "user_id", "event_type", "_ingested_at", "_run_id", "_source")


@query("select product, ts, cast(price as double) as price, cast(size as bigint) as size from trades")
def stg_typed(s, d):
    raw = shapes.trades(s, d).select("product", F.col("ts").cast("string").alias("ts"), F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"))
    return raw.select("product", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("price").cast("decimal(18,4)").cast("double").alias("price"), F.col("size").cast("bigint").alias("size"))


@query("select user_id, arg_max(value, event_id) as value, max(event_id) as event_id from events group by 1")
def compacted_latest(s, d):
    return markets.compacted_latest(read(s, d, "events"), "user_id", "event_id").select("user_id", "value", "event_id")


@query("""select case when event_id % 17 = 3 then 'rejected' else 'parsed' end as side, count(*) as rows, sum(event_id)::bigint as ids from events group by 1""")
def dlq_split(s, d):
    value = F.when(F.col("event_id") % 17 == 3, F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "v": "x'))).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("v"))))
    good, bad = feeds.parsed_or_rejected(read(s, d, "events").select("event_id", value.alias("value")), "value", "id bigint, v string")
    total = lambda df, side: df.agg(F.count("*").alias("rows"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids")).select(F.lit(side).alias("side"), "rows", "ids")
    return total(good, "parsed").unionByName(total(bad, "rejected")).where("rows > 0")


def _version_log(s, d):
    """A log of commits as a table's versions have: one per day and type of event."""
    op = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "view", "stage").otherwise("publish")
    return read(s, d, "events").groupBy(F.col("event_type").alias("table_name"), F.to_date("ts").alias("day"), op.alias("operation")).agg(F.max("ts").alias("at"), F.max("event_id").cast("string").alias("version"), F.count("*").alias("rows"))


_LOG = """log as (select event_type as table_name, cast(ts as date) as day, case event_type when 'error' then 'reject' when 'view' then 'stage' else 'publish' end as operation,
    max(ts) as "at", cast(max(event_id) as varchar) as version, count(*) as rows from events group by 1, 2, 3)"""


@query(f"""with {_LOG} select table_name, arg_max(version, "at") as version, max("at") as "at", arg_max(rows, "at") as rows from log where operation = 'publish' group by 1""")
def current_version(s, d):
    log = _version_log(s, d).where("operation = 'publish'")
    return log.groupBy("table_name").agg(F.max_by("version", "at").alias("version"), F.max("at").alias("at"), F.max_by("rows", "at").alias("rows"))


@query(
    f"""with {_LOG}, r as (select *, row_number() over (partition by table_name, operation order by "at" desc, version) as rn from log)
    select table_name, version, case when operation = 'publish' then 'expired' else 'abandoned' end as reason from r
    where "at" < timestamp '{EVENT_DAY}' - interval 7 days and ((operation = 'publish' and rn > 20) or operation = 'stage')"""
)
def expired_versions(s, d):
    return versions.expired(_version_log(s, d), EVENT_DAY, 7, 20)


@query(f"""select 'part-' || event_id as path from events where ts < timestamp '{EVENT_DAY}' - interval 3 days and event_id % 13 = 5""")
def orphan_files(s, d):
    e = read(s, d, "events").select(F.concat(F.lit("part-"), "event_id").alias("path"), F.col("ts").alias("modified"), "event_id")
    return versions.orphans(e.drop("event_id"), e.where("event_id % 13 <> 5"), EVENT_DAY, 3).select("path")


# --- change stream ---


def _changes(s, d):
    return cdc.parse_changes(shapes.change_stream(s, d), {"limits": "customer_id"})


_SCHEMA = "customer_id string, credit_limit string, as_of_day int, state string, updated_ms bigint"


def _typed(s, d):
    casts = {"credit_limit": F.expr("try_cast(credit_limit as decimal(18,2))"), "as_of_day": F.expr("date_add(date '1970-01-01', as_of_day)"), "updated_at": F.timestamp_millis("updated_ms").cast("timestamp_ntz")}
    return cdc.type_changes(_changes(s, d), _SCHEMA, casts)


@query("select 'limits' as entity, op, customer_id as record_key, lsn as source_lsn, cast(floor(epoch_us(ts) / 1000) as bigint) as source_ms from changes")
def cdc_parse(s, d):
    return _changes(s, d).select("entity", "op", "record_key", "source_lsn", F.unix_millis("source_ts").alias("source_ms"))


@query("select customer_id, cast(credit_limit as double) as credit_limit, as_of_day, state, op from changes")
def cdc_typed(s, d):
    return _double(_typed(s, d), "credit_limit").select("customer_id", "credit_limit", "as_of_day", "state", "op")


@query("select op, count(*) as changes from changes group by 1")
def cdc_op_counts(s, d):
    return _changes(s, d).groupBy("op").agg(F.count("*").alias("changes"))


@query(f"select min(ts) as oldest, cast(date_diff('second', min(ts), timestamp '{EVENT_DAY}') as bigint) as lag_s from changes")
def cdc_lag(s, d):
    ts = F.min(F.col("ts"))
    parsed = _changes(s, d).join(read(s, d, "events").select(F.col("event_id").alias("source_lsn"), "ts"), "source_lsn")
    end = F.unix_seconds(F.lit(EVENT_DAY).cast("timestamp_ntz").cast("timestamp"))
    return parsed.agg(ts.alias("oldest"), (end - F.unix_seconds(F.date_trunc("second", ts).cast("timestamp_ntz").cast("timestamp"))).alias("lag_s"))


def _latest_change(s, d):
    return contract.latest_per_key(_typed(s, d), ["customer_id"], ["source_lsn", "offset"])


_NEWEST = "newest as (select * exclude (rn) from (select *, row_number() over (partition by customer_id order by lsn desc) as rn from changes) where rn = 1)"


@query(f"with {_NEWEST} select customer_id, op, lsn, cast(credit_limit as double) as credit_limit from newest")
def cdc_latest(s, d):
    return _double(_latest_change(s, d), "credit_limit").select("customer_id", "op", F.col("source_lsn").alias("lsn"), "credit_limit")


def _checked_changes(s, d):
    known = contract.resolve(_typed(s, d), customers(s, d), "customer_id", ["brand"])
    return contract.with_violations(known, {"orphan_customer": F.col("brand").isNotNull(), "state_missing": F.col("state").isNotNull(), "limit_unreadable": F.col("credit_limit").isNotNull()})


@query(
    f"""select lsn, customer_id from changes left join customers using (customer_id)
    where brand is null and state is not null and credit_limit is not null and ts > timestamp '{EVENT_DAY}' - interval 5 days"""
)
def cdc_waiting(s, d):
    seen = _checked_changes(s, d).join(read(s, d, "events").select(F.col("event_id").alias("source_lsn"), "ts"), "source_lsn")
    return contract.waiting(seen, "ts", EVENT_DAY, "5 DAYS").select(F.col("source_lsn").alias("lsn"), "customer_id")


@query("select customer_id, count(*) as changes from changes where customer_id in (select customer_id from changes left join customers using (customer_id) where brand is null) group by 1")
def cdc_still_waiting(s, d):
    keys = _checked_changes(s, d).where(F.array_contains("_violations", "orphan_customer")).select("customer_id").distinct()
    return _changes(s, d).join(keys, F.col("record_key") == F.col("customer_id"), "left_semi").groupBy(F.col("record_key").alias("customer_id")).agg(F.count("*").alias("changes"))


@query("select cast(count(*) as bigint) as rows, cast(sum(case when lsn % 2 = 0 then 1 else 0 end) as bigint) as parked from changes")
def cdc_work_set(s, d):
    c = _changes(s, d)
    new, parked = c.where("source_lsn % 2 <> 0"), c.where("source_lsn % 2 = 0").withColumn("first_seen_at", F.col("source_ts"))
    both = cdc.union_all([new, parked])
    return both.agg(F.count("*").alias("rows"), F.count("first_seen_at").alias("parked"))


_TRACED = "customer_id in ('C0000008', 'C0000083', 'C0000166')"


@query(
    f"""with seen as (select lsn, op, customer_id, ts, brand, list_filter([case when brand is null then 'orphan_customer' end, case when state is null then 'state_missing' end, case when credit_limit is null then 'limit_unreadable' end], lambda x: x is not null) as why
        from changes left join customers using (customer_id) where {_TRACED})
    select customer_id, 1 as step, 'changelog' as stage, lsn as n, op as detail from seen
    union all select customer_id, 2, 'quarantine', lsn, array_to_string(why, ',') from seen where len(why) > 0 and not (why = ['orphan_customer'] and ts > timestamp '{EVENT_DAY}' - interval 15 days)
    union all select customer_id, 3, 'pending', lsn, cast(cast(ts as date) as varchar) from seen where why = ['orphan_customer'] and ts > timestamp '{EVENT_DAY}' - interval 15 days"""
)
def trace_key(s, d):
    """What became of a key's changes, in order: they arrived, were rejected, or wait for their parent since when."""
    seen = _checked_changes(s, d).where(_TRACED).join(read(s, d, "events").select(F.col("event_id").alias("source_lsn"), "ts"), "source_lsn")
    pending = contract.waiting(seen, "ts", EVENT_DAY, "15 DAYS")
    rejected = seen.where(F.size("_violations") > 0).join(pending.select("source_lsn"), "source_lsn", "left_anti")
    part = lambda df, step, stage, detail: df.select("customer_id", F.lit(step).alias("step"), F.lit(stage).alias("stage"), F.col("source_lsn").alias("n"), detail.alias("detail"))
    return cdc.union_all([part(seen, 1, "changelog", F.col("op")), part(rejected, 2, "quarantine", F.array_join("_violations", ",")), part(pending, 3, "pending", F.to_date("ts").cast("string"))])


def _limits(s, d):
    """The table before a batch: what every third customer had, as of some day."""
    at = F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(c_custkey * 7 % 30 as int))")
    return read(s, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("customer_id"), F.col("c_acctbal").alias("credit_limit"), at.alias("updated_at"))


_BEFORE = "before as (select 'C' || lpad(cast(c_custkey as varchar), 7, '0') as customer_id, c_acctbal as credit_limit, timestamp '2024-01-01' + to_days(cast(c_custkey * 7 % 30 as int)) as updated_at from customer where c_custkey % 3 = 0)"


def _merged_sql(source: str, newer: str, columns: dict[str, str]) -> str:
    """After a merge: the newer of the two where a change is there, and no row that a change deletes."""
    take = f"n.customer_id is not null and (b.customer_id is null or n.updated_at {newer} b.updated_at)"
    return "select coalesce(b.customer_id, n.customer_id) as customer_id, " + ", ".join(f"case when {take} then {n} else b.{c} end as {c}" for c, n in columns.items()) + f" from before b full join {source} n on b.customer_id = n.customer_id"


_LIMIT = {"credit_limit": "cast(n.credit_limit as double)", "updated_at": "n.updated_at"}


@query(f"with {_NEWEST}, {_BEFORE} {_merged_sql('newest', '>=', _LIMIT)}")
def merge_batch(s, d):
    return cdc.merge(_limits(s, d), _double(_latest_change(s, d), "credit_limit"), "customer_id", "updated_at")


@query(f"with {_NEWEST}, {_BEFORE} {_merged_sql('newest', '>', _LIMIT)} where n.op is null or n.op <> 'd'")
def merge_cdc(s, d):
    source = _double(_latest_change(s, d), "credit_limit")
    upserts, gone = source.where("op <> 'd'"), source.where("op = 'd'").select("customer_id", "op")
    return cdc.merge(_limits(s, d), cdc.union_all([upserts.select("customer_id", "credit_limit", "updated_at", "op"), gone]), "customer_id", "updated_at", inclusive=False, op="op")


@query(
    f"""with {_NEWEST}, {_BEFORE}, good as (select n.* from newest n left join customers c using (customer_id) where n.op = 'd' or (c.brand is not null and n.state is not null and n.credit_limit is not null))
    {_merged_sql('good', '>', {"updated_at": "n.updated_at"})} where n.op is null or n.op <> 'd'"""
)
def cdc_end_to_end(s, d):
    checked = contract.latest_per_key(_checked_changes(s, d), ["customer_id"], ["source_lsn"])
    good = checked.where("op = 'd'").union(checked.where((F.col("op") != "d") & (F.size("_violations") == 0)))
    return cdc.merge(_limits(s, d), _double(good, "credit_limit").select("customer_id", "credit_limit", "updated_at", "op"), "customer_id", "updated_at", inclusive=False, op="op").select("customer_id", "updated_at")


#: The change topics of a child and its parent. Payloads carry dates as text here.
_STREAMED = [
    Table("customers", "customer_id", "customer_id string, brand string, email string, date_of_birth date", lambda: contract.customer_rules(BANK_DAY, BRANDS), hands=("brand",), version=lambda: F.lit(0)),
    Table(
        "limits", "customer_id", "customer_id string, credit_limit decimal(18,2), state string, updated_ms bigint", lambda: {"state_missing": F.col("state").isNotNull(), "limit_missing": F.col("credit_limit").isNotNull()},
        parent="customers", parent_field="customer_id", version=lambda: F.col("updated_ms"),
    ),
]


@query(
    """with gone as (select customer_id, max(lsn) as at_ from changes where op = 'd' group by 1),
    ok as (select c.*, k.brand from changes c join customers k using (customer_id) left join gone g using (customer_id) where op <> 'd' and state is not null and credit_limit is not null and (at_ is null or lsn > at_))
    select customer_id, cast(credit_limit as double) as credit_limit, state, brand from (select *, row_number() over (partition by customer_id order by updated_at desc, lsn) as rn from ok) where rn = 1"""
)
def cdc_by_state(s, d):
    """The change stream itself, over keyed state: changes wait for customers, the newest count, deletes always."""
    row = F.struct("customer_id", "brand", "email", F.col("date_of_birth").cast("string").alias("date_of_birth"))
    body = F.to_json(F.struct(F.lit("r").alias("op"), row.alias("after"), F.struct(F.lit(0).alias("lsn"), F.lit(0).alias("ts_ms")).alias("source")))
    parents = shapes.source_customers(s, d).select(F.lit("bank.public.customers").alias("topic"), F.lit(0).cast("bigint").alias("offset"), body.alias("value"))
    folder = f"{lake.store(s, d).root}/stream-{uuid.uuid4().hex}"
    shapes.change_stream(s, d).select("topic", "offset", "value").union(parents).write.parquet(f"{folder}/feed")
    raw = s.readStream.schema("topic string, offset bigint, value string").parquet(f"{folder}/feed")
    q = keyed_cdc.start(raw, _STREAMED, f"{folder}/out", f"{folder}/checkpoint", partitions=s.sparkContext.defaultParallelism)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return _double(keyed_cdc.current(s, f"{folder}/out", _STREAMED[1], ("brand",)), "credit_limit").drop("updated_ms")


# --- contract and quarantine ---


@query("select txn_id, account_id, cast(amount as double) as amount, txn_ts from transactions")
def dedup_latest(s, d):
    return _double(transactions(s, d), "amount").select("txn_id", "account_id", "amount", "txn_ts")


@query("select account_id, brand from source_accounts left join (select customer_id, brand from customers) using (customer_id)")
def brand_via_customer(s, d):
    return contract.resolve(shapes.source_accounts(s, d), customers(s, d), "customer_id", ["brand"]).select("account_id", "brand")


@query("select txn_id, customer_id, brand from transactions left join (select account_id, customer_id, brand from accounts) using (account_id)")
def brand_via_account(s, d):
    return contract.resolve(transactions(s, d), accounts(s, d), "account_id", ["customer_id", "brand"]).select("txn_id", "customer_id", "brand")


def _reasons(df, entity, key):
    return df.select(F.lit(entity).alias("entity"), F.col(key).alias("record_key"), F.array_join("_violations", ",").alias("reasons"))


_ALL_CHECKED = """select 'customers' as entity, customer_id as record_key, reasons from customers_checked union all select 'accounts', account_id, reasons from accounts_checked
    union all select 'transactions', txn_id, reasons from transactions_checked union all select 'complaints', complaint_id, reasons from complaints_checked"""


def _all_checked(s, d):
    return cdc.union_all([_reasons(customers_checked(s, d), "customers", "customer_id"), _reasons(accounts_checked(s, d), "accounts", "account_id"), _reasons(transactions_checked(s, d), "transactions", "txn_id"), _reasons(complaints_checked(s, d), "complaints", "complaint_id")])


@query(f"select entity, reasons, count(*) as rows from ({_ALL_CHECKED}) group by 1, 2")
def contract_violations(s, d):
    return _all_checked(s, d).groupBy("entity", "reasons").agg(F.count("*").alias("rows"))


@query("select txn_id, customer_id, brand, cast(amount as double) as amount from txns")
def silver_good(s, d):
    return _double(contract.split(transactions_checked(s, d))[0], "amount").select("txn_id", "customer_id", "brand", "amount")


@query(f"select entity, record_key, reasons, md5(record_key) as payload_key from ({_ALL_CHECKED}) where reasons <> ''")
def quarantine_rows(s, d):
    parts = ((customers_checked, "customers", "customer_id"), (accounts_checked, "accounts", "account_id"), (transactions_checked, "transactions", "txn_id"), (complaints_checked, "complaints", "complaint_id"))
    rows = [contract.quarantine_rows(contract.split(f(s, d))[1], entity, key, "run-1", BANK_DAY) for f, entity, key in parts]
    own = F.coalesce(*(F.when(F.col("entity") == entity, F.get_json_object("payload", f"$.{key}")) for _, entity, key in parts))
    return cdc.union_all(rows).select("entity", "record_key", F.array_join("reasons", ",").alias("reasons"), F.md5(own.cast("binary")).alias("payload_key"))


@query("select count(*) as rows, count(*) filter (where reasons <> '') as bad, round(count(*) filter (where reasons <> '') / count(*), 6) as rate from transactions_checked")
def quarantine_rate(s, d):
    return contract.quarantine_rate(transactions_checked(s, d))


@query("select distinct array_to_string(list_sort(list(distinct brand)), ', ') as brands from customers")
def visible_brands(s, d):
    return customers(s, d).agg(F.array_join(F.array_sort(F.collect_set("brand")), ", ").alias("brands"))


# --- gold ---

_HOLDINGS = """select customer_id, coalesce(array_to_string(list_sort(list(distinct product) filter (where status = 'open')), ','), '') as products_held, count(*) filter (where status = 'open') as open_accounts,
    cast(sum(case when status = 'open' and product in ('current_account', 'savings') then balance else 0 end) as double) as deposit_balance,
    cast(sum(case when status = 'open' and balance < 0 then -balance else 0 end) as double) as lending_balance, bool_or(status = 'frozen') as has_frozen_account from accounts group by 1"""
_ACTIVITY = f"""select customer_id, count(*) as txn_count_30d, cast(sum(case when amount < 0 then -amount else 0 end) as double) as spend_30d,
    count(*) filter (where status = 'reversed') as reversed_txn_30d, max(txn_ts) as last_txn_ts from txns where txn_ts >= timestamp '{BANK_DAY}' - interval 30 days group by 1"""
_HISTORY = """select customer_id, count(*) filter (where status in ('open', 'investigating')) as open_complaints, count(*) as total_complaints, count(*) filter (where status = 'referred_to_fos') as fos_referrals from complaints group by 1"""
_LAST = """select customer_id, category as last_complaint_category, summary as last_complaint_summary, status as last_complaint_status, opened_at as last_complaint_opened_at
    from (select *, row_number() over (partition by customer_id order by opened_at desc, complaint_id desc) as rn from complaints) where rn = 1"""


def _held(df):
    return _double(df.withColumn("products_held", F.array_join("products_held", ",")), "deposit_balance", "lending_balance")


@query(_HOLDINGS)
def holdings(s, d):
    return _held(gold.holdings(accounts(s, d)))


@query(_ACTIVITY)
def activity_30d(s, d):
    return _double(gold.activity(txns(s, d), BANK_DAY), "spend_30d")


@query(_HISTORY)
def complaint_history(s, d):
    return gold.complaint_history(complaints(s, d)).select("customer_id", "open_complaints", "total_complaints", "fos_referrals")


@query(_LAST)
def last_complaint(s, d):
    return gold.complaint_history(complaints(s, d)).drop("open_complaints", "total_complaints", "fos_referrals")


def _built_gold(s, d):
    return gold.customer_360(customers(s, d), accounts(s, d), txns(s, d), complaints(s, d), BANK_DAY)


def _gold(s, d):
    """The published product, in buckets of its key: as many as its customers ask for."""
    return lake.bucketed(s, d, "gold.customer_360", "customer_id", lambda: gold.bucket_count(customers(s, d).count()), _built_gold)


_GOLD = f"""select c.customer_id, brand, first_name, last_name, date_of_birth, email, phone, postcode, region, segment, vulnerability_flag, customer_since,
    products_held, coalesce(open_accounts, 0) as open_accounts, deposit_balance, lending_balance, has_frozen_account, coalesce(txn_count_30d, 0) as txn_count_30d, spend_30d,
    coalesce(reversed_txn_30d, 0) as reversed_txn_30d, last_txn_ts, coalesce(open_complaints, 0) as open_complaints, coalesce(total_complaints, 0) as total_complaints, coalesce(fos_referrals, 0) as fos_referrals,
    last_complaint_category, last_complaint_summary, last_complaint_status, last_complaint_opened_at, timestamp '{BANK_DAY}' as refreshed_at
    from customers c left join ({_HOLDINGS}) using (customer_id) left join ({_ACTIVITY}) using (customer_id) left join ({_HISTORY}) using (customer_id) left join ({_LAST}) using (customer_id)"""


@query(_GOLD)
def customer_360(s, d):
    return _double(_held(_built_gold(s, d)), "spend_30d")


@query()
def gold_layout_stats(s, d):
    """Rows and key range of each file of the published product: what a lookup can skip by."""
    laid = _gold(s, d).select("customer_id", F.regexp_extract(F.input_file_name(), r"_0*(\d+)\.c\d+", 1).cast("int").alias("part"))
    return laid.groupBy("part").agg(F.count("*").alias("rows"), F.min("customer_id").alias("first"), F.max("customer_id").alias("last"))


@query(f"select customer_id, brand, region, open_accounts, total_complaints from ({_GOLD}) where customer_id = 'C0000004'")
def point_lookup(s, d):
    return _gold(s, d).where("customer_id = 'C0000004'").select("customer_id", "brand", "region", "open_accounts", "total_complaints")


@query(f"select (select count(*) from customers) as silver_rows, count(*) as gold_rows, count(*) = (select count(*) from customers) as equal from ({_GOLD})")
def row_count_match(s, d):
    a, b = customers(s, d).agg(F.count("*").alias("silver_rows")), _built_gold(s, d).agg(F.count("*").alias("gold_rows"))
    return a.join(F.broadcast(b)).withColumn("equal", F.col("silver_rows") == F.col("gold_rows"))  # one row each


# --- markets and cards ---

_BARS = """select product, date_trunc('minute', ts) as bar, cast(arg_min(price, ts) as double) as open, cast(max(price) as double) as high, cast(min(price) as double) as low, cast(arg_max(price, ts) as double) as close,
    cast(sum(size) as bigint) as volume, count(*) as trades, least(cast(max(price) as double), greatest(cast(min(price) as double), round(cast(sum(price * size) as double) / nullif(sum(size), 0), 6))) as vwap
    from trades group by 1, 2"""
_AUTHS = """select merchant, cast(ts as date) as day, count(*) as auths, count(*) filter (where decision = 'approved') as approved, count(*) filter (where decision = 'declined') as declined,
    cast(sum(amount_eur) as double) as amount_eur, round(count(*) filter (where decision = 'approved') / count(*), 4) as approval_rate from card_auths group by 1, 2"""


@query(_BARS)
def ohlcv_1m(s, d):
    return markets.ohlcv(shapes.trades(s, d))


@query(_AUTHS)
def card_auth_daily(s, d):
    return markets.auth_daily(shapes.card_auths(s, d))


@query("select count(*) as auths, cast(sum(amount_eur) as double) as amount_eur, round(count(*) filter (where decision = 'approved') / count(*), 6) as approval_rate from card_auths")
def kpi_totals(s, d):
    return markets.kpi_totals(shapes.card_auths(s, d))


@query(f"select product, date_trunc('hour', bar) as hour, round(avg(close), 6) as avg_close, cast(sum(volume) as bigint) as volume from ({_BARS}) group by 1, 2 order by hour, product limit 1000")
def hourly_rollup(s, d):
    return markets.hourly_rollup(markets.ohlcv(shapes.trades(s, d)), 1000)


@query("select channel, count(*) as auths, round(count(*) filter (where decision = 'approved') / count(*), 4) as approval_rate, cast(sum(amount_eur) as double) as spend_eur from card_auths group by 1")
def breakdown_by_dim(s, d):
    return markets.breakdown(shapes.card_auths(s, d), "channel")


@query("""with rates as (select ['GBP', 'EUR', 'USD', 'CHF'][event_id % 4 + 1] as currency, ts, value as rate from events where event_type = 'view' and event_id % 4 <> 2),
    latest as (select currency, arg_max(rate, ts) as rate from rates group by 1)
    select merchant, ts, currency, round(cast(amount_eur as double) * rate, 4) as amount_base from card_auths left join latest using (currency)""")
def fx_convert(s, d):
    rates = read(s, d, "events").where("event_type = 'view' and event_id % 4 <> 2").select(shapes.pick(("GBP", "EUR", "USD", "CHF"), F.col("event_id") % 4).alias("currency"), "ts", F.col("value").alias("rate"))
    return markets.fx_convert(shapes.card_auths(s, d), rates, "amount_eur", "currency").select("merchant", "ts", "currency", "amount_base")


@query("select merchant, count(*) as auths, cast(sum(amount_eur) as double) as amount_eur, max(ts) as last_auth from card_auths where merchant in (select 'Shop ' || (s_suppkey % 50) from supplier where s_suppkey % 7 = 3) group by 1")
def sanctions_hits(s, d):
    listed = read(s, d, "supplier").where("s_suppkey % 7 = 3").select(F.concat(F.lit(" SHOP - "), (F.col("s_suppkey") % 50).cast("string"), F.lit(".")).alias("name"))
    return markets.sanctions_hits(shapes.card_auths(s, d), listed)


@query(
    r"""with n as (select distinct merchant, trim(regexp_replace(lower(merchant), '[^a-z0-9]+', ' ', 'g')) as m from card_auths), l as (select distinct 'shob ' || (s_suppkey % 50) as listed from supplier where s_suppkey % 7 = 3),
    best as (select merchant, arg_min(listed, (levenshtein(m, listed), listed)) as listed, min(levenshtein(m, listed)) as distance from n, l where levenshtein(m, listed) <= 1 group by 1)
    select merchant, listed, cast(distance as int) as distance, count(*) as auths, cast(sum(amount_eur) as double) as amount_eur, max(ts) as last_auth from card_auths join best using (merchant) group by 1, 2, 3"""
)
def sanctions_similar(s, d):
    """The listed names are misspelt."""
    listed = read(s, d, "supplier").where("s_suppkey % 7 = 3").select(F.concat(F.lit(" SHOB - "), (F.col("s_suppkey") % 50).cast("string"), F.lit(".")).alias("name"))
    return markets.screened(shapes.card_auths(s, d), listed)


# --- data quality ---


# Rules as they are declared of the bank's tables, with a limit on time as of the bank's day, and two of our own.
CONTRACT = f"""
schema:
  - name: transactions
    quality:
      - {{ name: currency_known, type: sql, severity: error, query: "SELECT count(*) FROM silver.transactions WHERE currency NOT IN ('GBP','EUR','USD')", mustBe: 0 }}
      - {{ name: timestamp_not_in_future, type: sql, severity: error, query: "SELECT count(*) FROM silver.transactions WHERE txn_ts > timestamp_ntz '{BANK_DAY}' + INTERVAL '1' HOUR", mustBe: 0 }}
      - {{ name: brand_resolved, type: sql, severity: error, query: "SELECT count(*) FROM silver.transactions WHERE brand IS NULL", mustBe: 0 }}
      - {{ name: few_large, type: sql, severity: warning, query: "SELECT count(*) FROM silver.transactions WHERE amount < -90000", mustBeLessThan: 10 }}
      - {{ name: quarantine_rate, type: text, severity: error, description: "Over one per cent halts the batch" }}
  - name: customer_360
    quality:
      - {{ name: row_count_matches_customers, type: sql, severity: error, query: "SELECT (SELECT count(*) FROM gold.customer_360) - (SELECT count(*) FROM silver.customers)", mustBe: 0 }}
      - {{ name: no_negative_counts, type: sql, severity: error, query: "SELECT count(*) FROM gold.customer_360 WHERE open_accounts < 0 OR open_complaints < 0", mustBe: 0 }}
      - {{ name: brands, type: sql, severity: warning, query: "SELECT count(DISTINCT brand) FROM gold.customer_360", mustBeBetween: [2, 3] }}
"""


@query(
    f"""select 'transactions' as table_name, 'currency_known' as rule, 'error' as severity, count(*)::double as observed, count(*) = 0 as passed from txns where currency not in ('GBP', 'EUR', 'USD')
    union all select 'transactions', 'timestamp_not_in_future', 'error', count(*)::double, count(*) = 0 from txns where txn_ts > timestamp '{BANK_DAY}' + interval 1 hour
    union all select 'transactions', 'brand_resolved', 'error', count(*)::double, count(*) = 0 from txns where brand is null
    union all select 'transactions', 'few_large', 'warning', count(*)::double, count(*) < 10 from txns where amount < -90000
    union all select 'customer_360', 'row_count_matches_customers', 'error', ((select count(*) from ({_GOLD})) - count(*))::double, (select count(*) from ({_GOLD})) = count(*) from customers
    union all select 'customer_360', 'no_negative_counts', 'error', count(*)::double, count(*) = 0 from ({_GOLD}) where open_accounts < 0 or open_complaints < 0
    union all select 'customer_360', 'brands', 'warning', count(distinct brand)::double, count(distinct brand) between 2 and 3 from ({_GOLD})"""
)
def declared_rules(s, d):
    return dq.declared_checks(dq.read_contract(CONTRACT), {"silver.transactions": txns(s, d), "silver.customers": customers(s, d), "gold.customer_360": _gold(s, d)})


@query(
    """select 'pk_unique' as check_name, cast(count(txn_id) - count(distinct txn_id) as double) as observed, count(txn_id) = count(distinct txn_id) as passed from txns
    union all select 'pk_not_null', cast(count(*) filter (where txn_id is null) as double), count(*) filter (where txn_id is null) = 0 from txns
    union all select 'brand_not_null', cast(count(*) filter (where brand is null) as double), count(*) filter (where brand is null) = 0 from txns
    union all select 'quarantine_rate', coalesce(count(*) filter (where reasons <> '') / nullif(count(*), 0), 0)::double, coalesce(count(*) filter (where reasons <> '') / nullif(count(*), 0), 0) <= 0.01 from transactions_checked"""
)
def dq_silver(s, d):
    return dq.run_checks(transactions_checked(s, d), dq.silver_checks("txn_id"))


@query(
    f"""with g as ({_GOLD}) select 'row_count_matches_customers' as check_name, count(*)::double as observed, count(*) = (select count(*) from customers) as passed from g
    union all select 'no_negative_counts', count(*)::double, count(*) = 0 from g where open_accounts < 0 or open_complaints < 0
    union all select 'brand_not_null', count(*)::double, count(*) = 0 from g where brand is null"""
)
def dq_gold(s, d):
    return dq.run_checks(_gold(s, d), dq.gold_checks(customers(s, d).count()))


@query("""select 'no_orphans' as rule, count(*) as offenders from transactions_checked where reasons like '%orphan%'
    union all select 'no_zero_amount', count(*) from txns where amount = 0 union all select 'future', count(*) from source_customers where date_of_birth >= date '2001-11-05'""")
def contract_rules(s, d):
    return dq.offenders(
        {
            "no_orphans": transactions_checked(s, d).where(F.array_contains("_violations", "orphan_account")),
            "no_zero_amount": txns(s, d).where("amount = 0"),
            "future": shapes.source_customers(s, d).where(F.col("date_of_birth") >= F.lit(BANK_DAY).cast("date")),
        }
    )


@query("""select 'unique' as test, 'txn_id' as column_name, count(txn_id) - count(distinct txn_id) as offenders from raw_transactions
    union all select 'not_null', 'merchant', count(*) filter (where merchant is null) from raw_transactions
    union all select 'accepted_values', 'currency', count(*) filter (where currency not in ('GBP', 'EUR', 'USD')) from raw_transactions""")
def column_tests(s, d):
    return dq.column_tests(shapes.raw_transactions(s, d), ["txn_id"], ["merchant"], {"currency": list(CURRENCIES)})


@query(
    f"""select 'approved_plus_declined' as rule, count(*) as offenders from ({_AUTHS}) where approved + declined <> auths
    union all select 'ohlc_consistent', count(*) from ({_BARS}) where low > high or open not between low and high or close not between low and high
    union all select 'vwap_inside', count(*) from ({_BARS}) where vwap < low or vwap > high"""
)
def relational_tests(s, d):
    bars, auths = markets.ohlcv(shapes.trades(s, d)), markets.auth_daily(shapes.card_auths(s, d))
    return dq.offenders(
        {
            "approved_plus_declined": auths.where("approved + declined <> auths"),
            "ohlc_consistent": bars.where("low > high or open not between low and high or close not between low and high"),
            "vwap_inside": bars.where("vwap < low or vwap > high"),
        }
    )


@query("""select column_name, problem, (select count(*) from orders) as rows from (values ('o_totalprice', 'type'), ('o_comment', 'missing'), ('o_orderpriority', 'extra')) t(column_name, problem)""")
def schema_drift(s, d):
    from pyspark.sql.types import DataType

    orders = read(s, d, "orders")
    declared = DataType.fromDDL("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(18,2), o_orderdate timestamp_ntz, o_comment string")
    return dq.schema_drift(orders, declared).join(F.broadcast(orders.agg(F.count("*").alias("rows"))))  # one row


@query("""select 'o_orderkey' as column_name, 'int' as declared, count(*) filter (where try_cast(o_orderkey as int) is null) as unfit, count(*) as rows from orders
    union all select 'o_orderpriority', 'int', count(*) filter (where try_cast(o_orderpriority as int) is null), count(*) from orders
    union all select 'o_totalprice', 'decimal(8,2)', count(*) filter (where try_cast(o_totalprice as decimal(8,2)) is null), count(*) from orders""")
def value_drift(s, d):
    return dq.value_drift(read(s, d, "orders"), {"o_orderkey": "int", "o_orderpriority": "int", "o_totalprice": "decimal(8,2)"})


# --- governance ---

E_BANK = security.bank_entitlements()


def _view(s, d, user, table="gold.customer_360"):
    return security.secure_view(_gold(s, d), table, user, E_BANK)


@query("select customer_id, brand from customers where brand in ('Meridian', 'Northgate')")
def row_filter(s, d):
    return _view(s, d, "bob").select("customer_id", "brand")


@query("""select customer_id, substr(first_name, 1, 1) || '.' as first_name, substr(last_name, 1, 1) || '.' as last_name, cast(null as date) as date_of_birth, cast(null as varchar) as email,
    split_part(postcode, ' ', 1) as postcode, cast(null as boolean) as vulnerability_flag from customers""")
def masked_none(s, d):
    return _view(s, d, "carol").select("customer_id", "first_name", "last_name", "date_of_birth", "email", "postcode", "vulnerability_flag")


@query("""select customer_id, first_name, cast(date_trunc('year', date_of_birth) as date) as date_of_birth, regexp_replace(email, '^(.).*(@.*)$', '\\1***\\2') as email, '*******' || right(phone, 4) as phone,
    split_part(postcode, ' ', 1) as postcode, vulnerability_flag from customers where brand = 'Meridian'""")
def masked_partial(s, d):
    return _view(s, d, "alice").select("customer_id", "first_name", "date_of_birth", "email", "phone", "postcode", "vulnerability_flag")


@query("select customer_id as record_key, array_to_string(list_sort(string_split(reasons, ',')), ',') as reasons, cast(null as varchar) as payload from customers_checked where reasons <> ''")
def masked_raw_records(s, d):
    """Quarantined rows for someone who may read the tables of operations, but no personal data."""
    auditor = dataclasses.replace(E_BANK, users={**E_BANK.users, "dana": ("auditor", ("*",))}, personas={**E_BANK.personas, "auditor": security.Persona(frozenset({"ops"}), "partial", False)})
    rows = contract.quarantine_rows(contract.split(customers_checked(s, d))[1], "customers", "customer_id", "run-1", BANK_DAY)
    seen = security.secure_view(rows, "ops.quarantine", "dana", auditor)
    return seen.select("record_key", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), "payload")


@query("select account_id, '****' || right(iban, 4) as iban from accounts where brand = 'Meridian'")
def masked_accounts(s, d):
    return security.secure_view(accounts(s, d), "silver.accounts", "alice", E_BANK).select("account_id", "iban")


@query("with seen as (select split_part(postcode, ' ', 1) as postcode from customers where brand = 'Meridian') select count(*) filter (where postcode = 'AB3 3CD') as exact, count(*) filter (where postcode = 'AB3') as outward from seen")
def mask_then_filter(s, d):
    v = _view(s, d, "alice")
    return v.agg(F.count_if(F.col("postcode") == "AB3 3CD").alias("exact"), F.count_if(F.col("postcode") == "AB3").alias("outward"))


# What each persona gets to see of the customers' columns, written out: cells that are visible, masked and hidden.
_CELLS = """select persona, column_name, access, case when persona = 'contact_centre' then m else n end as cells from (
    select (select count(*) from customers) as n, (select count(*) from customers where brand = 'Meridian') as m) c, (values
    ('analyst', 'date_of_birth', 'hidden'), ('analyst', 'email', 'hidden'), ('analyst', 'first_name', 'masked'), ('analyst', 'last_name', 'masked'), ('analyst', 'phone', 'hidden'), ('analyst', 'postcode', 'masked'), ('analyst', 'vulnerability_flag', 'hidden'),
    ('contact_centre', 'date_of_birth', 'masked'), ('contact_centre', 'email', 'masked'), ('contact_centre', 'first_name', 'visible'), ('contact_centre', 'last_name', 'visible'), ('contact_centre', 'phone', 'masked'), ('contact_centre', 'postcode', 'masked'), ('contact_centre', 'vulnerability_flag', 'visible'),
    ('platform_admin', 'date_of_birth', 'visible'), ('platform_admin', 'email', 'visible'), ('platform_admin', 'first_name', 'visible'), ('platform_admin', 'last_name', 'visible'), ('platform_admin', 'phone', 'visible'), ('platform_admin', 'postcode', 'visible'), ('platform_admin', 'vulnerability_flag', 'visible')) a(persona, column_name, access)"""


@query(_CELLS)
def access_matrix(s, d):
    """The matrix of the product's tagged columns, with the cells that a user of each persona reads through the view."""
    matrix = security.access_matrix(s, E_BANK).where("table_name = 'gold.customer_360'")
    users = {"analyst": "carol", "contact_centre": "alice", "platform_admin": "ops_admin"}
    cells = cdc.union_all([_view(s, d, user).agg(F.count("*").alias("cells")).select(F.lit(p).alias("persona"), "cells") for p, user in users.items()])
    return matrix.join(F.broadcast(cells), "persona").select("persona", "column_name", "access", "cells")  # a row for each persona


_CHAIN = ["event_id", "event_type", "user_id"]


def _chain(s, d):
    log = read(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), *_CHAIN)
    return security.append_chain(log, "day", "event_id", _CHAIN)


#: The chain hash by hash, with the heads of its segments, as recursive SQL.
_CHAIN_SQL = """with recursive e as (select cast(cast(ts as date) as varchar) as day, event_id, event_type, user_id, event_id || '|' || event_type || '|' || user_id as txt, event_id // 10000 as seg from events),
    g as (select day, seg, sha256(string_agg(sha256(txt), '' order by event_id)) as digest, row_number() over (partition by day order by seg) as k from e group by 1, 2),
    h as (select day, seg, k, 'genesis' as head, digest from g where k = 1 union all select g.day, g.seg, g.k, sha256(h.head || '|' || h.digest), g.digest from h join g on g.day = h.day and g.k = h.k + 1),
    r as (select *, row_number() over (partition by day, seg order by event_id) as i from e),
    c as (select r.day, r.seg, r.i, r.event_id, h.head as prev_hash, sha256(h.head || '|' || r.txt) as row_hash from r join h using (day, seg) where i = 1
        union all select r.day, r.seg, r.i, r.event_id, c.row_hash, sha256(c.row_hash || '|' || r.txt) from c join r on r.day = c.day and r.seg = c.seg and r.i = c.i + 1)
    select c.day, c.event_id, e.event_type, e.user_id, prev_hash, row_hash from c join e using (event_id)"""


@query(_CHAIN_SQL)
def audit_chain(s, d):
    return _chain(s, d)


@query(
    """select cast(cast(ts as date) as varchar) as day, count(*) as rows, min(case when event_id % 1000 = 500 then event_id end) as first_broken from events group by 1"""
)
def audit_verify(s, d):
    edited = _chain(s, d).withColumn("event_type", F.when(F.col("event_id") % 1000 == 500, "edited").otherwise(F.col("event_type")))
    return security.verify_chain(edited, "day", "event_id", _CHAIN)


# --- lookups ---


@query("select customer_id, first_name, last_name, postcode, brand from customers where lower(last_name) = 'bell' and lower(split_part(postcode, ' ', 1)) = 'ab5' order by customer_id limit 10")
def find_customer(s, d):
    return lookups.find_customer(customers(s, d), last_name="Bell", postcode_outward="AB5")


@query(f"select txn_id, txn_ts, cast(amount as double) as amount from txns where customer_id = 'C0000004' and txn_ts >= timestamp '{BANK_DAY}' - interval 900 days order by txn_ts desc, txn_id limit 50")
def recent_transactions(s, d):
    return _double(lookups.recent_transactions(txns(s, d), "C0000004", BANK_DAY, 900, 50), "amount").select("txn_id", "txn_ts", "amount")


@query("select complaint_id, opened_at, status, summary from complaints where customer_id = 'C0000008' and status in ('open', 'investigating') order by opened_at desc, complaint_id limit 20")
def open_complaints(s, d):
    return lookups.open_complaints(complaints(s, d), "C0000008").select("complaint_id", "opened_at", "status", F.col("customer_words.summary").alias("summary"))


@query("select account_id, product, status from accounts where customer_id = 'C0000004' order by product, account_id limit 20")
def accounts_of_customer(s, d):
    return lookups.accounts_of(accounts(s, d), "C0000004").select("account_id", "product", "status")


@query("""select account_id, customer_id, case when status = 'frozen' and product = 'current_account' and balance < 0 then 'frozen,overdrawn' when status = 'frozen' then 'frozen' else 'overdrawn' end as alerts,
    format('{:,.2f}', cast(abs(balance) as double)) as amount from accounts where status = 'frozen' or (product = 'current_account' and balance < 0)""")
def account_alerts(s, d):
    return lookups.account_alerts(accounts(s, d))


@query("""select customer_id, sha256('7|' || customer_id) as draw from (select *, count(*) over (partition by lower(last_name), split_part(postcode, ' ', 1), substr(phone, 1, 4)) as n from customers) where n = 1""")
def unique_identity(s, d):
    keys = [F.lower("last_name"), F.split_part("postcode", F.lit(" "), F.lit(1)), F.substring("phone", 1, 4)]
    return lookups.unique_identity(customers(s, d), keys, 7).select("customer_id", "draw")


def _signals(s, d):
    return text.extract_signals(shapes.transcripts(s, d))


def _final_state(s, d):
    """What a call knows at its end."""
    state = text.call_state(_signals(s, d))
    return contract.latest_per_key(state, ["call_id"], ["seq"])


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _labels_sql(patterns: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches(text, {_rx(p)}) then '{n}' end" for n, p in patterns.items()) + "], lambda x: x is not null)"


#: Lines with what they say, by the same patterns in the other engine's regular expressions.
_SAID = f"""said as (select *, case when mine and len(name_words) > 1 then array_to_string(name_words, ' ') end as full_name,
    case when mine and regexp_matches(text, {_rx(text.POSTCODE)}) then upper(regexp_extract(text, {_rx(text.POSTCODE)}, 1) || ' ' || regexp_extract(text, {_rx(text.POSTCODE)}, 2)) end as postcode
    from (select *, speaker = 'customer' as mine,
        list_filter(string_split_regex(regexp_extract(text, {_rx(text.NAME)}, 1), '\\s+'), lambda w: w <> '' and w not in ({", ".join(map(_rx, text.NOT_NAMES))})) as name_words from transcripts))"""
_LABELLED = f"""{_SAID}, lab as (select *, case when mine then {_labels_sql(text.INTENTS)} else [] end as intents, case when mine then {_labels_sql(text.VULNERABILITIES)} else [] end as vulnerabilities,
    case when mine then {_labels_sql(text.RISKS)} else [] end as risks from said),
    each as (select call_id, seq, label, place from (select call_id, seq, unnest(list_concat(list_concat(intents, vulnerabilities), risks)) as label, generate_subscripts(list_concat(list_concat(intents, vulnerabilities), risks), 1) as place from lab)),
    firsts as (select call_id, label, arg_min(seq, seq * 100 + place) as seq, arg_min(place, seq * 100 + place) as place from each group by 1, 2)"""


@query(
    f"""with {_SAID}, known as (select call_id, arg_min(full_name, seq) filter (where full_name is not null) as full_name, split_part(arg_min(postcode, seq) filter (where postcode is not null), ' ', 1) as outward from said group by 1),
    met as (select k.call_id, c.customer_id, lower(split_part(k.full_name, ' ', 1)) = lower(c.first_name) as same from known k
        left join customers c on lower(string_split(k.full_name, ' ')[-1]) = lower(c.last_name) and lower(k.outward) = lower(split_part(c.postcode, ' ', 1)))
    select call_id, case when count(customer_id) > 1 and count(*) filter (where same) > 0 then count(*) filter (where same) else count(customer_id) end as matches,
        case when count(customer_id) = 1 then min(customer_id) when count(*) filter (where same) = 1 then min(customer_id) filter (where same) end as customer_id from met group by 1"""
)
def identify_caller(s, d):
    return lookups.identify_callers(_final_state(s, d), customers(s, d))


def _claims(s, d):
    """Claims about payments: the size of each transaction of the last weeks, and an amount that was misheard."""
    return txns(s, d).select(F.col("txn_id").alias("claim_id"), "customer_id", F.array(F.abs("amount"), F.lit(1).cast("decimal(18,2)")).alias("amounts"))


_CLAIMS = "claims as (select txn_id as claim_id, customer_id, abs(amount) as size from txns)"


@query(f"with {_CLAIMS} select claim_id, txn_id, txn_ts, cast(size as double) as claimed from claims c join txns t on c.customer_id = t.customer_id and (abs(t.amount) = c.size) where txn_ts >= timestamp '{BANK_DAY}' - interval 10 days")
def payment_pinpoint(s, d):
    return lookups.pinpoint(_claims(s, d), txns(s, d), BANK_DAY, 10)


@query(
    f"""with {_CLAIMS}, met as (select claim_id, t.*, (-t.amount = size or -t.amount = 1) as exact from claims c join txns t on c.customer_id = t.customer_id
        where txn_ts >= timestamp '{BANK_DAY}' - interval 30 days and amount < 0 and channel in ('faster_payment', 'online', 'mobile'))
    select claim_id, txn_id, exact, case when status = 'reversed' then 'returned' when status = 'posted' then 'sent' when txn_ts < timestamp '{BANK_DAY}' - interval 1 day then 'delayed' else 'in_progress' end as state
    from (select *, row_number() over (partition by claim_id order by exact desc, txn_ts desc, txn_id) as rn from met) where rn = 1"""
)
def payment_trace(s, d):
    return lookups.trace_payment(_claims(s, d), txns(s, d), BANK_DAY, 30)


# --- text ---


@query(
    rf"""with {_LABELLED} select call_id, seq, full_name, postcode, case when mine then nullif(regexp_extract(text, {_rx(text.CUSTOMER_ID)}, 1), '') end as customer_id,
    case when mine then array_to_string(list_transform(regexp_extract_all(text, {_rx(text.MONEY)}, 1), lambda x: printf('%.2f', cast(replace(x, ',', '') as double))), ',') else '' end as amounts,
    array_to_string(intents, ',') as intents, array_to_string(vulnerabilities, ',') as vulnerabilities, array_to_string(risks, ',') as risks from lab"""
)
def signals(s, d):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return _signals(s, d).select("call_id", "seq", "full_name", "postcode", "customer_id", F.array_join(F.transform("amounts", lambda a: a.cast("string")), ",").alias("amounts"), joined("intents"), joined("vulnerabilities"), joined("risks"))


_FIRST_NAME, _LAST_NAME = f"{shapes._list(shapes.FIRST)}[call_id % 8 + 1]", f"{shapes._list(shapes.LAST)}[call_id % 11 + 1]"


def _called(s, d):
    """Lines with the names of their call: of its caller, whole and in parts, and a letter, which is none."""
    first, last = shapes.pick(shapes.FIRST, F.col("call_id") % 8), shapes.pick(shapes.LAST, F.col("call_id") % 11)
    return shapes.transcripts(s, d).withColumn("names", F.array(first, F.lit("I"), last, F.concat(first, F.lit(" "), last), F.lit(None)))


@query(
    rf"""with n as (select *, {_FIRST_NAME} as a, {_LAST_NAME} as b from transcripts), o as (select *, case when length(a) > length(b) or length(a) = length(b) and a < b then a else b end as long, case when length(a) > length(b) or length(a) = length(b) and a < b then b else a end as short from n)
    select call_id, seq, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b' || a || ' ' || b || '\b', '[name]', 'g'), '(?i)\b' || long || '\b', '[name]', 'g'), '(?i)\b' || short || '\b', '[name]', 'g') as text from o"""
)
def redact_names(s, d):
    return text.redact_names(_called(s, d), "text", "names").select("call_id", "seq", "text")


@query()
def redact(s, d):
    return text.redact(_called(s, d), "text", "names").drop("names")


@query(
    rf"""with t as (select *, lag(text) over (partition by call_id order by seq) as heard, call_id * 7 + seq as k from transcripts),
    c as (select call_id, seq, text || ' ref T' || lpad(cast(k as varchar), 10, '0') as text, concat_ws(' ', 'C0000042 12.99 300', case when k % 2 = 0 then 'T' || lpad(cast(k as varchar), 10, '0') else '-' end, heard) as proof from t),
    m as (select *, list_filter(list_transform(regexp_extract_all(text, {_rx(text.MONEY)}, 1), lambda x: try_cast(replace(x, ',', '') as decimal(18,2))), lambda x: x is not null) as said,
        list_transform(regexp_extract_all(replace(proof, ',', ''), '(\d+(?:\.\d+)?)', 1), lambda x: try_cast(x as decimal(18,2))) as known,
        list_concat(regexp_extract_all(text, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1), regexp_extract_all(text, '\b(C\d{{7}}|A\d{{8}}|CMP\d{{7}}|T[0-9A-Za-z]{{10,24}})\b', 1)) as other from c)
    select call_id, seq, array_to_string(list_sort(list_distinct(list_concat(list_transform(list_filter(said, lambda x: not list_contains(known, x)), lambda x: '£' || x), list_filter(other, lambda x: not contains(proof, x))))), ',') as missing from m"""
)
def ungrounded(s, d):
    """Lines with a reference each, against what was looked up and the line before."""
    k = F.col("call_id") * 7 + F.col("seq")
    ref = F.concat(F.lit("T"), F.lpad(k.cast("string"), 10, "0"))
    heard = F.lag("text").over(Window.partitionBy("call_id").orderBy("seq"))
    lines = shapes.transcripts(s, d).select("call_id", "seq", F.concat("text", F.lit(" ref "), ref).alias("text"), heard.alias("heard"), F.concat_ws(" ", F.lit("C0000042 12.99 300"), F.when(k % 2 == 0, ref).otherwise("-")).alias("evidence"))
    return text.ungrounded(lines, "text", "evidence", "heard").select("call_id", "seq", F.array_join(F.array_sort(F.array_distinct("missing")), ",").alias("missing"))


def _stop_sql() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)


@query(
    f"""with procedures as (select item_id as doc_id, array_to_string(string_split(text, ' ')[1:4], ' ') as title, 'topic' || (item_id % 7) as tags, text as body from benchmark),
    tok as (select doc_id, unnest(regexp_extract_all(lower(title || ' ' || title || ' ' || tags || ' ' || tags || ' ' || body), '[a-z0-9_]+')) as t from procedures), terms as (select doc_id, t, count(*) as f from tok where t not in ({_stop_sql()}) group by 1, 2),
    len as (select doc_id, sum(f) as len from terms group by 1), df as (select t, count(*) as df from terms group by 1), n as (select (select count(*) from benchmark) as n_docs, (select sum(len) from len) as total),
    q as (select query_id, t, count(*) as q from (select conv_id * 1000 + turn as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t from conversations where role = 'user') where t not in ({_stop_sql()}) group by 1, 2),
    scored as (select query_id, doc_id, round(sum(q * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * f * 2.4 / (f + 1.4 * (0.25 + 0.75 * len * n_docs / total))), 6) as score from q join terms using (t) join df using (t) join len using (doc_id), n group by 1, 2)
    select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored) where rank <= 3"""
)
def bm25_topk(s, d):
    asked = read(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    procedures = read(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("title"), F.concat(F.lit("topic"), F.col("item_id") % 7).alias("tags"), F.col("text").alias("body"))
    return text.bm25(asked, procedures.select("doc_id", text.procedure_text("title", "tags", "body").alias("text")), 3).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""with x as (select complaint_id, cast(opened_at as date) as day, category from complaints),
    y as (select *, case when category in ('payments', 'fraud_scam') then (select max(day + cast(k as int)) from range(0, 30) r(k) where isodow(day + cast(k as int)) < 6
            and (select count(*) from range(1, 30) u(j) where j <= k and isodow(day + cast(j as int)) < 6) = 15) else day + 56 end as deadline from x)
    select complaint_id, deadline, cast(deadline - date '{EVENT_DAY}' as int) as days_left, deadline < date '{EVENT_DAY}' as overdue, deadline - date '{EVENT_DAY}' <= 5 as escalate from y"""
)
def complaint_deadline(s, d):
    return text.with_deadline(complaints(s, d), "opened_at", "category", EVENT_DAY).select("complaint_id", "deadline", "days_left", "overdue", "escalate")


@query(f"with {_LABELLED} select call_id, label, seq from firsts")
def first_signal_per_call(s, d):
    return text.first_signals(_signals(s, d)).drop("place")


def _lookups(s, d):
    """What was looked up during calls: at each line of a colleague a tool, which may have failed."""
    n = F.col("conv_id") * 7 + F.col("turn")
    tool = shapes.pick(("get_accounts", "get_complaints", "get_recent_transactions"), n % 3)
    outcome = F.when(n % 9 == 0, "unavailable").when(n % 11 == 0, "denied").otherwise("ok")
    return read(s, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"), tool.alias("tool"), outcome.alias("outcome"))


def _cards(s, d):
    urgent = read(s, d, "conversations").where("conv_id % 4 = 1").select(F.col("conv_id").alias("call_id"))
    return text.guidance_cards(_signals(s, d), _lookups(s, d), urgent)


#: The policy of the cards written out case by case, apart from the library's table of them.
_CARDS_SQL = f"""{_LABELLED}, looked as (select conv_id as call_id, turn as seq, ['get_accounts', 'get_complaints', 'get_recent_transactions'][(conv_id * 7 + turn) % 3 + 1] as tool,
        case when (conv_id * 7 + turn) % 9 = 0 then 'unavailable' when (conv_id * 7 + turn) % 11 = 0 then 'denied' else 'ok' end as outcome from conversations where role = 'assistant'),
    shown as (select call_id, label, seq, case when label like '%request' or label = 'instruction_injection' then 'guard' when label in ('bereavement', 'financial_difficulty', 'health', 'capability') then 'compliance'
            when label in ('card_fraud', 'payment_missing', 'new_complaint') or call_id % 4 = 1 and label = 'complaint_chase' then 'action' else 'insight' end as card,
            case label when 'third_party_request' then 'Third-party request' when 'instruction_injection' then 'Caller tried to instruct the assistant' when 'sensitive_data_request' then 'Sensitive data mentioned' when 'bereavement' then 'Bereavement disclosed'
            when 'financial_difficulty' then 'Possible financial difficulty' when 'health' then 'Health circumstances mentioned' when 'capability' then 'Caller may need more support' when 'card_fraud' then 'Possible card fraud'
            when 'complaint_chase' then 'Complaint deadline' when 'payment_missing' then 'Payment status' when 'balance_query' then 'Live balances' when 'new_complaint' then 'Log a complaint' end as title,
            case when label = 'third_party_request' then 'DATA-3P-01' when label in ('instruction_injection', 'sensitive_data_request') then 'SAFETY-01' when label = 'bereavement' then 'VULN-BEREAVEMENT-01' when label = 'financial_difficulty' then 'VULN-FINDIFF-01'
            when label in ('health', 'capability') then 'VULN-HEALTH-01' when label = 'card_fraud' then 'CARD-FRAUD-01' when label in ('complaint_chase', 'new_complaint') then 'COMPLAINTS-DISP-01' when label = 'payment_missing' then 'PAYMENTS-FPS-01' end as procedure from firsts
        union all select call_id, 'identity', greatest(min(seq) filter (where full_name is not null), min(seq) filter (where postcode is not null)), 'identity', 'Verify the caller', 'IDV-01' from lab group by 1 having count(full_name) > 0 and count(postcode) > 0
        union all select call_id, 'summary', max(seq), 'summary', 'Draft call note (check before saving)', null from lab group by 1
        union all select call_id, 'fail:' || outcome, min(seq), 'status', arg_min(tool, seq) || ': ' || outcome, null from looked where outcome <> 'ok' group by call_id, outcome),
    ranked as (select *, case card when 'guard' then 0 when 'compliance' then 1 when 'action' then 2 when 'identity' then 3 when 'insight' then 4 when 'status' then 5 else 6 end as priority from shown)"""


@query(f"with {_CARDS_SQL} select call_id, label, seq, card, title, procedure, priority, cast(row_number() over (partition by call_id order by priority, seq, label) as int) as position from ranked")
def call_cards(s, d):
    return _cards(s, d)


@query(f"""with {_CARDS_SQL} select cast(call_id as varchar) as key, '{{"call_id":' || call_id || ',"seq":' || seq || ',"card":"' || card || '","priority":' || priority || '}}' as value from ranked""")
def call_events(s, d):
    return calls.call_events(_cards(s, d).select("call_id", "seq", "card", "priority")).select("key", "value")


@query(
    f"""with {_LABELLED} select l.call_id, l.seq, arg_min(full_name, seq) filter (where full_name is not null) over w as full_name, arg_min(postcode, seq) filter (where postcode is not null) over w as postcode,
        coalesce((select string_agg(f.label, ',' order by f.seq, f.place) from firsts f where f.call_id = l.call_id and f.seq <= l.seq), '') as labels
    from lab l window w as (partition by l.call_id order by l.seq rows between unbounded preceding and current row)"""
)
def call_state(s, d):
    return text.call_state(_signals(s, d)).select("call_id", "seq", "full_name", "postcode", F.array_join("labels", ",").alias("labels"))


@query(
    f"""with {_CARDS_SQL}, r as (select call_id, string_agg(replace(label, '_', ' '), ', ' order by seq, place) filter (where label in ('card_fraud', 'complaint_chase', 'payment_missing', 'balance_query', 'new_complaint')) as reasons,
        string_agg(replace(label, '_', ' '), ', ' order by seq, place) filter (where label in ('bereavement', 'financial_difficulty', 'health', 'capability')) as disclosed from firsts group by 1),
    g as (select call_id, string_agg(title, '; ' order by seq, priority, title) as guidance from ranked where card in ('guard', 'compliance', 'action') group by 1),
    k as (select call_id, count(*) filter (where outcome = 'ok') as lookups from looked group by 1), n as (select call_id, count(*) as lines from lab group by 1)
    select call_id, coalesce(reasons, 'general enquiry') as reasons, coalesce(disclosed, '') as disclosed, coalesce(guidance, '') as guidance, coalesce(lookups, 0) as lookups, lines from n left join r using (call_id) left join g using (call_id) left join k using (call_id)"""
)
def call_note(s, d):
    return text.call_note(_signals(s, d), _cards(s, d), _lookups(s, d))


def _expected(s, d):
    """What the lines should be labelled as: true labels of the planted phrases, some of them wrong."""
    n = (F.col("call_id") * 7 + F.col("seq")) % 11
    some = lambda *labels: F.array_compact(F.array(*(F.when(n.isin(*k), name) for name, k in labels)))
    lines = _signals(s, d).where("speaker = 'customer'")
    name = F.when(n % 2 == 0, F.concat(shapes.pick(shapes.FIRST, F.col("call_id") % 8), F.lit(" "), shapes.pick(shapes.LAST, F.col("call_id") % 11)))
    code = F.concat(F.lit("AB"), (F.col("call_id") % 20 + 1).cast("string"), F.lit(" "), (F.col("call_id") % 9 + 1).cast("string"), F.lit("CD"))
    return lines.withColumns({"want_intents": some(("card_fraud", (0,)), ("complaint_chase", (1,)), ("payment_missing", (2, 9))), "want_vulnerabilities": some(("bereavement", (5,)), ("health", (7, 8))), "want_risks": some(("instruction_injection", (9,)), ("sensitive_data_request", (9, 10))), "want_name": name, "want_postcode": code})


@query(
    f"""with {_LABELLED}, p as (select *, (call_id * 7 + seq) % 11 as n from lab where mine),
    w as (select 'intents' as field, intents as have, list_filter([case when n = 0 then 'card_fraud' end, case when n = 1 then 'complaint_chase' end, case when n in (2, 9) then 'payment_missing' end], lambda x: x is not null) as want from p
        union all select 'vulnerabilities', vulnerabilities, list_filter([case when n = 5 then 'bereavement' end, case when n in (7, 8) then 'health' end], lambda x: x is not null) from p
        union all select 'risks', risks, list_filter([case when n = 9 then 'instruction_injection' end, case when n in (9, 10) then 'sensitive_data_request' end], lambda x: x is not null) from p),
    c as (select field, cast(sum(len(list_intersect(want, have))) as bigint) as tp, cast(sum(len(list_filter(have, lambda x: not list_contains(want, x)))) as bigint) as fp, cast(sum(len(list_filter(want, lambda x: not list_contains(have, x)))) as bigint) as fn from w group by 1)
    select field, tp, fp, fn, round(tp / greatest(tp + fp, 1), 3) as precision, round(tp / greatest(tp + fn, 1), 3) as recall, round(tp / greatest(tp + fp, 1), 3) >= 0.3 and round(tp / greatest(tp + fn, 1), 3) >= 0.3 as passed from c"""
)
def label_quality(s, d):
    return text.label_quality(_expected(s, d), {f: (f"want_{f}", f) for f in ("intents", "vulnerabilities", "risks")}, (0.3, 0.3))


@query(
    f"""with {_LABELLED}, p as (select *, {shapes._list(shapes.FIRST)}[call_id % 8 + 1] || ' ' || {shapes._list(shapes.LAST)}[call_id % 11 + 1] as n, 'AB' || (call_id % 20 + 1) || ' ' || (call_id % 9 + 1) || 'CD' as c from lab where mine and (call_id * 7 + seq) % 11 % 2 = 0)
    select count(*) as labelled, count(*) filter (where full_name is not distinct from n and postcode is not distinct from c) as right, round(count(*) filter (where full_name is not distinct from n and postcode is not distinct from c) / greatest(count(*), 1), 3) as rate from p"""
)
def identity_capture(s, d):
    return text.identity_capture(_expected(s, d), "want_name", "want_postcode")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as new from events),
    g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as n from e)
    select user_id, min(ts) as started, count(*) as lines from g group by user_id, n""")
def call_sessions(s, d):
    w = F.session_window(F.col("ts"), "30 minutes")
    out = read(s, d, "events").groupBy("user_id", w).agg(F.min("ts").alias("started"), F.count("*").alias("lines"))
    return out.select("user_id", "started", "lines")


# --- observability, freshness ---


def _calls(s, d):
    return read(s, d, "events").select(F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "unavailable").otherwise("denied")).otherwise("ok").alias("outcome"), "ts", F.col("value").alias("latency"), F.to_date("ts").alias("day"), "event_id", "user_id")


_CALLS = "calls as (select event_type as tool, case when event_type = 'error' then case when event_id % 3 = 0 then 'unavailable' else 'denied' end else 'ok' end as outcome, ts, value as latency, cast(ts as date) as day, event_id, user_id from events)"


@query(f"""with {_CALLS}, r as (select tool, latency, row_number() over (partition by tool order by latency) - 1 as i, count(*) over (partition by tool) as n from calls)
    select tool, max(n) as n, max(case when i = n // 2 then latency end) as p50, max(case when i = least(n - 1, cast(floor(n * 0.95) as bigint)) then latency end) as p95 from r group by 1""")
def latency_percentiles(s, d):
    return observe.nearest_rank(_calls(s, d), "tool", "latency")


@query(
    """with b as (select case when value <= 5 then 0 when value <= 10 then 1 when value <= 25 then 2 when value <= 50 then 3 when value <= 100 then 4 else 5 end as i, count(*) as n from events group by 1),
    e as (select * from (values (0, 5.0, 0.0), (1, 10.0, 5.0), (2, 25.0, 10.0), (3, 50.0, 25.0), (4, 100.0, 50.0), (5, null, 100.0)) v(i, upper, lower)),
    r as (select e.i, cast(upper as double) as upper, cast(lower as double) as lower, coalesce(n, 0) as n, sum(coalesce(n, 0)) over (order by e.i) as upto, sum(coalesce(n, 0)) over () as total from e left join b using (i))
    select 0.95::double as q, round(case when upper is null then lower else lower + (upper - lower) * (0.95::double * total - (upto - n)) / n end, 6) as estimate from r where upto >= 0.95 * total order by i limit 1"""
)
def histogram_quantile(s, d):
    return observe.histogram_quantile(read(s, d, "events"), "value", [5.0, 10.0, 25.0, 50.0, 100.0], 0.95)


@query(f"with {_CALLS} select tool, count(*) as calls, count(*) filter (where outcome in ('unavailable', 'error')) as errors, round(count(*) filter (where outcome in ('unavailable', 'error')) / count(*), 6) as error_ratio, round(1 - count(*) filter (where outcome in ('unavailable', 'error')) / count(*), 6) as availability from calls group by 1")
def error_ratio(s, d):
    return observe.error_ratio(_calls(s, d), "tool")


def _over(seconds: int) -> str:
    return f"over (order by sec range between {seconds} preceding and current row)"


def _ratio(seconds: int) -> str:
    return f"sum(bad) {_over(seconds)} / sum(n) {_over(seconds)}"


def _held_sql(c: str, hold: int) -> str:
    return f"bool_and({c}) {_over(hold)} and coalesce(last_value({c}) over (order by sec range between {hold + 300} preceding and {hold} preceding), false)"


@query(
    f"""with {_CALLS}, p as (select cast(floor(epoch_us(ts) / 1000000) as bigint) as sec, count(*) as n, cast(sum(case when outcome in ('unavailable', 'error') then 1 else 0 end) as bigint) as bad from calls group by 1),
    w as (select sec, n, {_ratio(300)} as m5, {_ratio(1800)} as m30, {_ratio(3600)} as h1, {_ratio(21600)} as h6 from p),
    c as (select *, h1 > 14.4 * 0.005 and m5 > 14.4 * 0.005 as fast, h6 > 6 * 0.005 and m30 > 6 * 0.005 as slow from w)
    select sec, n, round(m5, 6) as m5, round(m30, 6) as m30, round(h1, 6) as h1, round(h6, 6) as h6, {_held_sql('fast', 120)} as fast_burn, {_held_sql('slow', 900)} as slow_burn from c"""
)
def burn_rate(s, d):
    return observe.burn_rate(_calls(s, d), {"m5": 300, "m30": 1800, "h1": 3600, "h6": 21600}, 0.005)


@query(f"with {_CALLS} select date_trunc('minute', ts) as minute, outcome, count(*) as calls from calls group by 1, 2")
def rate_by_outcome(s, d):
    return observe.rate_by_outcome(_calls(s, d))


@query(
    """with x as (select event_type as tool, cast(ceil(epoch_us(ts) / 1e6 / 60) * 60 as bigint) as sec, count(*) as c from events group by 1, 2),
    w as (select *, unnest(generate_series(sec, sec + 540, 60)) as "at" from x), y as (select *, sum(c) over (partition by tool, "at" order by sec) as n from w)
    select tool, "at", cast(sum(c) as bigint) as rows, count(*) as samples, round(regr_slope(n, sec - "at") * 60, 4) as per_minute from y group by 1, 2 having count(*) > 1"""
)
def ingest_rate(s, d):
    return observe.ingest_rate(read(s, d, "events").select(F.col("event_type").alias("tool"), "ts"), "tool")


def _usage(s, d):
    n = F.length("text")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 7).cast("int"))
    return read(s, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("use_id"), day.alias("day"), shapes.pick(("small-1", "small-2-fast", "large-1", "other"), F.col("conv_id") % 4).alias("model"),
        n.alias("tokens_in"), (n % 97).alias("tokens_out"), (n % 13).alias("cache_read"), (n % 7).alias("cache_write"),
    )


#: In the order of the list; the first prefix that fits counts, so the second is never reached.
_PRICES = [(1, "small", 1.0, 4.0), (2, "small-2", 2.0, 5.0), (3, "large", 10.0, 40.0), (4, "default", 3.0, 9.0)]


def _price_list(s):
    return s.createDataFrame(_PRICES, "position int, prefix string, price_in double, price_out double")



_USAGE = """usage as (select conv_id * 1000 + turn as use_id, date '2024-01-01' + cast(conv_id % 7 as int) as day, ['small-1', 'small-2-fast', 'large-1', 'other'][conv_id % 4 + 1] as model,
    length(text) as tokens_in, length(text) % 97 as tokens_out, length(text) % 13 as cache_read, length(text) % 7 as cache_write from conversations),
    prices as (select * from (values ('small-1', 1.0, 4.0), ('small-2-fast', 1.0, 4.0), ('large-1', 10.0, 40.0), ('other', 3.0, 9.0)) p(model, price_in, price_out)),
    cost as (select use_id, day, (price_in::double * (tokens_in + 0.1::double * cache_read + 1.25::double * cache_write) + price_out::double * tokens_out) / 1e6 as cost from usage join prices using (model))"""


@query(f"with {_USAGE} select day, sum(cast(round(cost * 1e8) as bigint)) / 1e8::double as cost, count(*) as uses, sum(cast(round(cost * 1e8) as bigint)) / 1e8::double > 0.05 as over_cap from cost group by 1")
def spend_daily(s, d):
    return observe.spend_daily(_usage(s, d), _price_list(s), 0.05)


@query(f"with {_USAGE} select use_id, day, cast(coalesce(sum(cast(round(cost * 1e8) as bigint)) over (partition by day order by use_id rows between unbounded preceding and 1 preceding), 0) as bigint) as spent_before from cost")
def spend_cost(s, d):
    cost = observe.priced(_usage(s, d), _price_list(s))
    uses = cost.select("use_id", "day", F.col("use_id").alias("at"), F.round(F.col("cost") * 1e8).cast("bigint").alias("cost"))
    return observe.running_spend(uses).select("use_id", "day", "spent_before")


_LAG = """t as (select event_type as topic, count(*) as messages from events group by 1), b as (select event_type as topic, count(*) as records from events where event_type <> 'view' and not (event_type = 'click' and event_id % 4 = 1) group by 1)"""


def _arrived(s, d):
    return read(s, d, "events").where("event_type <> 'view' and not (event_type = 'click' and event_id % 4 = 1)").select(F.col("event_type").alias("topic"))


@query(f"with {_LAG} select topic, messages, records, messages - records as lag, case when records is null then 'absent' when messages < records then 'duplicates' when messages > records then 'behind' else 'even' end as state from t left join b using (topic)")
def ingest_lag(s, d):
    return observe.ingest_lag(read(s, d, "events").select(F.col("event_type").alias("topic")), _arrived(s, d), "topic")


_SLAS = [(1, "freshness", None, 36.0, "h"), (2, "latency", "click", 1.0, "m"), (0, "freshness", "click", 2.0, "m")]


def _slas(s):
    return s.createDataFrame(_SLAS, "position int, property string, element string, value double, unit string")


@query("select event_type as table_name, cast(case when event_type = 'click' then 120 else 129600 end as bigint) as seconds from events group by 1, 2")
def sla_seconds(s, d):
    return observe.sla_seconds(read(s, d, "events").select(F.col("event_type").alias("table_name")).distinct(), _slas(s))


_AGE = f"date_diff('second', max(ts), timestamp '{EVENT_DAY}')"


@query(f"select event_type as table_name, case when {_AGE} <= s then 'fresh' when {_AGE} <= 2 * s then 'late' else 'stale' end as state from (select *, case when event_type = 'click' then 120 else 129600 end as s from events) group by event_type, s")
def freshness_state(s, d):
    e = read(s, d, "events").groupBy(F.col("event_type").alias("table_name")).agg(F.max("ts").alias("at"))
    age = F.unix_seconds(F.lit(EVENT_DAY).cast("timestamp_ntz").cast("timestamp")) - F.unix_seconds(F.date_trunc("second", "at").cast("timestamp_ntz").cast("timestamp"))
    limits = observe.sla_seconds(e.select("table_name"), _slas(s))
    return e.join(limits, "table_name").select("table_name", observe.freshness_state(age, F.col("seconds")).alias("state"))


@query(
    f"""with {_LAG} select ['console', 'archive'][1 + (ascii(topic) % 2)] as consumer_group, cast(sum(greatest(messages - coalesce(records, 0), 0)) as bigint) as backlog, count(*) filter (where messages > coalesce(records, 0)) as topics_behind from t left join b using (topic) group by 1"""
)
def consumer_backlog(s, d):
    lag = observe.ingest_lag(read(s, d, "events").select(F.col("event_type").alias("topic")), _arrived(s, d), "topic")
    groups = lag.select(shapes.pick(("console", "archive"), F.ascii("topic") % 2).alias("consumer_group"), F.coalesce("lag", "messages").alias("lag"))
    return observe.backlog(groups, "consumer_group")


_WATCHED = """watched as (select event_type as topic, event_type <> 'view' as there, event_type not in ('view', 'signup') as observed, count(*) as topic_records,
    count(*) filter (where not (event_type = 'click' and event_id % 4 = 1)) + count(*) filter (where event_type = 'error' and event_id % 10 = 0) as records, max(ts) filter (where not (event_type = 'click' and event_id % 4 = 1)) as committed_at from events group by event_type)"""


@query(
    f"""with {_WATCHED} select count(*) filter (where observed) as observed, count(*) filter (where not observed and there) as unreadable, count(*) filter (where not there) as absent, count(*) filter (where observed and topic_records < records) as duplicated,
    coalesce(max(topic_records - records) filter (where observed), 0) as worst_lag, round(max(date_diff('microsecond', committed_at, timestamp '{EVENT_DAY}') / 60e6) filter (where observed), 3) as minutes_since_commit from watched"""
)
def fleet_summary(s, d):
    arrived = ~((F.col("event_type") == "click") & (F.col("event_id") % 4 == 1))
    twice = (F.col("event_type") == "error") & (F.col("event_id") % 10 == 0)
    facts = read(s, d, "events").groupBy("event_type").agg(F.count("*").alias("topic_records"), (F.count_if(arrived) + F.count_if(twice)).alias("records"), F.max(F.when(arrived, F.col("ts"))).alias("committed_at"))
    watched = facts.withColumns({"exists": F.col("event_type") != "view", "observed": ~F.col("event_type").isin("view", "signup")})
    return observe.fleet_summary(watched, EVENT_DAY)


@query(
    """with r as (select event_type as table_name, user_id % 4 as c, arg_max(event_id % 5 <> 0, event_id) as ok from events where event_type <> 'signup' group by 1, 2), n as (select table_name, count(*) as n, count(*) filter (where ok) as ok from r group by 1)
    select table_name, coalesce(ok || ' of ' || n || ' passing', 'only declared') as status from (select distinct event_type as table_name from events) left join n using (table_name)"""
)
def check_status(s, d):
    e = read(s, d, "events").select(F.col("event_type").alias("table_name"), (F.col("user_id") % 4).alias("check_name"), (F.col("event_id") % 5 != 0).alias("passed"), F.col("event_id").alias("checked_at"))
    return observe.check_status(e.select("table_name").distinct(), e.where("table_name <> 'signup'"))


@query(
    """with b as (select event_type as stream, cast(floor(epoch_us(ts) / 1000000) as bigint) as sec, max(value) as lag_s, max(event_id % 50) / 1000 as bad_rate from events group by 1, 2)
    select stream, sec, coalesce(sec - lag(sec) over (partition by stream order by sec) > 120, false) as stalled, min(lag_s) over (partition by stream order by sec range between 300 preceding and current row) > 60 as lagging,
    min(bad_rate) over (partition by stream order by sec range between 600 preceding and current row) > 0.01 as failing from b"""
)
def stream_alerts(s, d):
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("sec")
    b = read(s, d, "events").groupBy(F.col("event_type").alias("stream"), sec).agg(F.max("value").alias("lag_s"), (F.max(F.col("event_id") % 50) / 1000).alias("bad_rate"))
    return observe.stream_alerts(b)
