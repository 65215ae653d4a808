"""Row filters, column masks, access matrix, and the hash chain of an audit log."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fenbrook.sources.shared import ship


@dataclass(frozen=True)
class Persona:
    schemas: frozenset[str]
    pii: str  # none, partial or full
    special_category: bool


@dataclass(frozen=True)
class Entitlements:
    users: dict[str, tuple[str, tuple[str, ...]]]  # user: persona, brands ('*': all)
    personas: dict[str, Persona]
    tags: dict[str, dict[str, str]]  # table: column: tag
    brand_scoped: frozenset[str]
    tenants: dict[str, frozenset[str]] = field(default_factory=dict)


def bank_entitlements() -> Entitlements:
    # Users, personas, tags and scoped tables of the bank.
    people = {"first_name": "pii.name", "last_name": "pii.name", "date_of_birth": "pii.dob", "email": "pii.contact", "phone": "pii.contact", "postcode": "pii.location", "vulnerability_flag": "special_category"}
    shared = frozenset({"gold", "silver"})
    return Entitlements(
        users={"alice": ("contact_centre", ("Meridian",)), "bob": ("complaints_investigator", ("Meridian", "Northgate")), "carol": ("analyst", ("Meridian", "Northgate", "Isle")), "ops_admin": ("platform_admin", ("*",))},
        personas={
            "contact_centre": Persona(shared, "partial", True),
            "complaints_investigator": Persona(shared, "full", True),
            "analyst": Persona(frozenset({"gold"}), "none", False),
            "platform_admin": Persona(frozenset({"gold", "silver", "bronze", "ops"}), "full", True),
        },
        tags={"gold.customer_360": people, "silver.customers": people, "silver.accounts": {"iban": "pii.financial_id"}, "bronze.customers": people, "ops.quarantine": {"payload": "pii.raw_record"}},
        brand_scoped=frozenset({"silver.customers", "silver.accounts", "silver.transactions", "silver.complaints", "gold.customer_360"}),
        tenants={"tenant-canary": frozenset({"canary_data"})},
    )


def mask(tag: str, column: str, kind: str, pii: str, special: bool) -> Column | None:
    """The masked column for a clearance, or None where it is shown as it is."""
    c, nothing = F.col(column), F.lit(None).cast(kind)
    if tag == "special_category":
        return None if special else nothing
    if pii == "full":
        return None
    if tag == "pii.contact":
        mail = F.regexp_replace(c, r"^(.).*(@.*)$", "$1***$2")
        return F.when(c.contains("@"), mail).otherwise(F.concat(F.lit("*******"), F.substring(c, -4, 4))) if pii == "partial" else nothing
    if tag == "pii.dob":
        return F.trunc(c, "year") if pii == "partial" else nothing
    if tag == "pii.name":
        return None if pii == "partial" else F.concat(F.substring(c, 1, 1), F.lit("."))
    if tag == "pii.location":
        return F.split_part(c, F.lit(" "), F.lit(1))
    if tag == "pii.financial_id":
        return F.concat(F.lit("****"), F.substring(c, -4, 4))
    return nothing


def secure_view(df: DataFrame, table: str, user: str, e: Entitlements) -> DataFrame:
    """``df`` as ``user`` may see it: rows of the user's brands, columns masked. Filters on the view see masked values.

    A tenant sees its own schemas as they are. Nothing of a schema outside the persona; no rows for an unknown user.
    """
    schema = table.split(".")[0]
    if user in e.tenants:
        if schema not in e.tenants[user]:
            raise PermissionError(f"{user} may not read {table}")
        return df
    if user not in e.users:
        return df.where(F.lit(False))
    name, brands = e.users[user]
    persona = e.personas[name]
    if schema not in persona.schemas:
        raise PermissionError(f"{user} may not read {table}")
    if table in e.brand_scoped and "*" not in brands:
        df = df.where(F.col("brand").isin(*brands))
    types, tags = dict(df.dtypes), e.tags.get(table, {})
    masks = {c: m for c, t in tags.items() if c in types and (m := mask(t, c, types[c], persona.pii, persona.special_category)) is not None}
    return df.withColumns(masks) if masks else df


def explain_policy(table: str, user: str, columns: list[str], e: Entitlements) -> dict:
    """What holds for ``user`` on these columns of a table: the brands that rows are kept of, and the tag of each masked column."""
    name, brands = e.users.get(user, ("", ()))
    persona = e.personas.get(name)
    scoped = table in e.brand_scoped and "*" not in brands
    tags = {c: t for c, t in e.tags.get(table, {}).items() if c in columns}
    masked = {c: t for c, t in tags.items() if persona and mask(t, c, "string", persona.pii, persona.special_category) is not None}
    return {"row_filter": {"brand": list(brands)} if scoped else None, "masked": masked}


def governed_answer(store, table: str, user: str, e: Entitlements, ask: Callable[[DataFrame], DataFrame], maintained_by: str, queried_at: dt.datetime) -> tuple[list[dict], dict]:
    """The rows of a lookup (a small answer) on the version that is current now, as ``user`` may see them, and where they come from.

    The record has the table and what maintains it, the version, its commit, its age at the query and its run, who
    asked, how many rows came back, and the filter and masks that held. ``store`` is a VersionStore.
    """
    facts = store.facts(table)
    source = store.read(table, facts["version"]) if facts else None
    if source is None:
        raise LookupError(f"{table} has no version")
    out = ask(secure_view(source, table, user, e))
    rows = [r.asDict(recursive=True) for r in out.collect()]
    snapshot = {
        "id": facts["version"],
        "committed_at": facts["at"].isoformat(),
        "committed_seconds_before_query": round((queried_at - facts["at"]).total_seconds(), 1),
        "committed_by": facts["run_id"],
        "operation": facts["operation"],
        "summary": facts["summary"],
    }
    asked = {"as_user": user, "pinned_to_snapshot": True, "rows": len(rows)}
    return rows, {"table": table, "maintained_by": maintained_by, "snapshot": snapshot, "query": asked, "policy": explain_policy(table, user, out.columns, e)}


def check_derived(columns: list[str], table: str, e: Entitlements) -> None:
    """A derived view may not select a tagged column."""
    if tagged := sorted(set(columns) & set(e.tags.get(table, {}))):
        raise PermissionError(f"{table}: {', '.join(tagged)}")


def access_matrix(spark: SparkSession, e: Entitlements) -> DataFrame:
    """persona, table_name, column_name, access (hidden, masked or visible), by the enforced masks."""
    personas = spark.createDataFrame([(n, s, p.pii, p.special_category) for n, p in e.personas.items() for s in sorted(p.schemas)], "persona string, schema string, pii string, special boolean")
    tags = spark.createDataFrame([(t.split(".")[0], t, c, g) for t, cs in e.tags.items() for c, g in cs.items()], "schema string, table_name string, column_name string, tag string")
    all_ = personas.select("persona", "pii", "special").distinct().join(F.broadcast(tags))  # both sides are fixed configuration
    readable = all_.join(personas.select("persona", "schema", F.lit(True).alias("ok")), ["persona", "schema"], "left")
    hidden = ((F.col("tag") == "special_category") & ~F.col("special")) | ((F.col("pii") == "none") & F.col("tag").isin("pii.contact", "pii.dob", "pii.raw_record")) | ((F.col("tag") == "pii.raw_record") & (F.col("pii") != "full"))
    plain = (F.col("tag") == "special_category") | (F.col("pii") == "full") | ((F.col("tag") == "pii.name") & (F.col("pii") == "partial"))
    return readable.select("persona", "table_name", "column_name", F.when(F.col("ok").isNull(), "unreadable").when(hidden, "hidden").when(plain, "visible").otherwise("masked").alias("access"))


def _row_text(columns: list[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


GENESIS = "genesis"


def _sha(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def _segmented(df: DataFrame, key: str, seq: str, columns: list[str], segment: int) -> DataFrame:
    return df.withColumns({"_segment": F.floor(F.col(seq) / segment).cast("bigint"), "_text": _row_text(columns)})


def _heads(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, segment, head): the hash that the first row of each segment follows.

    A key's first segment follows the genesis; any other sha256(head of the segment before | its digest), where the digest is
    the sha256 of the segment's row hashes in order. Heads are one small row for each segment.
    """
    ship(rows.sparkSession)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq), F.sha2("_text", 256).alias("h"))))
    digests = rows.groupBy(key, "_segment").agg(F.sha2(F.array_join(F.transform(ordered, lambda r: r["h"]), ""), 256).alias("digest"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = object(), ""
        for batch in batches:
            out = []
            for k, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != last:
                    last, head = k, GENESIS
                out.append(head)
                head = _sha(head, digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], [key, "_segment", "head"])

    kind = dict(rows.dtypes)[key]
    return digests.repartition(key).sortWithinPartitions(key, "_segment").mapInArrow(chain, f"{key} {kind}, _segment bigint, head string")


def append_chain(df: DataFrame, key: str, seq: str, columns: list[str], segment: int = 10_000) -> DataFrame:
    """Adds prev_hash and row_hash: sha256 of the previous hash and the row, along the number ``seq`` of each ``key``.

    A chain is sequential, so it is cut into segments of ``segment`` numbers, which are chained in tasks of their own, row
    by row; the first row of each follows the segment's head (``_heads``). A key whose numbers lie in one segment is one plain
    chain from the genesis. Rows of a key with equal numbers are ordered by their text.
    """
    rows = _segmented(df, key, seq, columns, segment)
    joined = rows.join(_heads(rows, key, seq), [key, "_segment"])

    own = df.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prev = object(), ""
        for batch in batches:
            before, after = [], []
            for k, s, text, head in zip(*(batch.column(c).to_pylist() for c in (key, "_segment", "_text", "head")), strict=True):
                if (k, s) != last:
                    last, prev = (k, s), head
                before.append(prev)
                prev = _sha(prev, text)
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(before, pa.string()), pa.array(after, pa.string())], [*own, "prev_hash", "row_hash"])

    schema = ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, ("prev_hash", "string"), ("row_hash", "string")])
    # By a hash of the two: dealt by the columns themselves, as the join above deals them, Spark would take this step out, and then read the join's input by map
    # task or in parts; a segment would start anew in each.
    dealt = joined.repartition(F.xxhash64(key, "_segment"))
    return dealt.sortWithinPartitions(key, "_segment", seq, "_text").mapInArrow(fold, schema)


def verify_chain(df: DataFrame, key: str, seq: str, columns: list[str], segment: int = 10_000) -> DataFrame:
    """key, rows, first_broken: the first seq whose hashes do not follow, or null. A window holds one segment."""
    rows = _segmented(df, key, seq, columns, segment)
    w = Window.partitionBy(key, "_segment").orderBy(seq, "_text")
    before = F.coalesce(F.lag("row_hash").over(w), F.col("head"))
    good = (F.col("prev_hash") == before) & (F.col("row_hash") == F.sha2(F.concat(F.col("prev_hash"), F.lit("|"), "_text"), 256))
    checked = rows.join(_heads(rows, key, seq), [key, "_segment"]).withColumn("_ok", F.coalesce(good, F.lit(False)))
    return checked.groupBy(key).agg(F.count("*").alias("rows"), F.min(F.when(~F.col("_ok"), F.col(seq))).alias("first_broken"))
