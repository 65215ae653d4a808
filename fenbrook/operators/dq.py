"""Checks: one pass of aggregates for each table, declared rules, drift of schemas."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .cdc import union_all


@dataclass(frozen=True)
class Check:
    """An aggregate of the table, which must be at most (or exactly) a limit."""

    name: str
    observed: Column
    limit: float
    exact: bool = False


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """check_name, observed, passed of all checks, from one aggregation of the table."""
    one = df.agg(*(F.coalesce(c.observed.cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(checks)))
    row = lambda i, c: F.struct(F.lit(c.name).alias("check_name"), F.col(f"_{i}").alias("observed"), (F.col(f"_{i}") == c.limit if c.exact else F.col(f"_{i}") <= c.limit).alias("passed"))
    return one.select(F.inline(F.array(*(row(i, c) for i, c in enumerate(checks)))))


def duplicates(key: str | Column) -> Column:
    return F.count(key) - F.count_distinct(key)


def nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def gold_checks(expected: int) -> list[Check]:
    return [
        Check("row_count_matches_customers", F.count("*"), expected, exact=True),
        Check("no_negative_counts", F.count_if((F.col("open_accounts") < 0) | (F.col("open_complaints") < 0)), 0),
        Check("brand_not_null", nulls("brand"), 0),
    ]


def silver_checks(key: str, rate: float | None = None, most: float = 0.01) -> list[Check]:
    """The gate of a silver table: no key twice, each row with a key and a brand, few rows in the quarantine.

    Of a staged table, with the ``rate`` of the batch that went into it. Without a rate, of a batch that is checked
    (``contract.with_violations``), all in its one pass: its good rows, which are to be staged, and the share of its bad ones.
    """
    good = F.size("_violations") == 0 if rate is None else F.lit(True)
    own = F.when(good, F.col(key))
    bad = F.count_if(~good) / F.greatest(F.count("*"), F.lit(1)) if rate is None else F.lit(rate)
    return [
        Check("pk_unique", duplicates(own), 0),
        Check("pk_not_null", F.count_if(good & F.col(key).isNull()), 0),
        Check("brand_not_null", F.count_if(good & F.col("brand").isNull()), 0),
        Check("quarantine_rate", bad, most),
    ]


def accept_quarantine(checks: list[Check]) -> list[Check]:
    """The same checks where the rate of the quarantine is observed as it is, and passes."""
    return [replace(c, limit=math.inf) if c.name == "quarantine_rate" else c for c in checks]


def column_tests(df: DataFrame, unique: list[str] = (), not_null: list[str] = (), accepted: dict[str, list[str]] | None = None) -> DataFrame:
    """Offenders of generic tests on columns: test, column_name, offenders."""
    tests = [("unique", c, duplicates(c)) for c in unique] + [("not_null", c, nulls(c)) for c in not_null]
    tests += [("accepted_values", c, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(v))) for c, v in (accepted or {}).items()]
    one = df.agg(*(x.alias(f"_{i}") for i, (_, _, x) in enumerate(tests)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(t).alias("test"), F.lit(c).alias("column_name"), F.col(f"_{i}").cast("bigint").alias("offenders")) for i, (t, c, _) in enumerate(tests)))))


#: What a declared rule may ask of the number that its query gives.
_MUST = {
    "mustBe": lambda x, v: x == v, "mustNotBe": lambda x, v: x != v, "mustBeLessThan": lambda x, v: x < v, "mustBeLessOrEqualTo": lambda x, v: x <= v,
    "mustBeGreaterThan": lambda x, v: x > v, "mustBeGreaterOrEqualTo": lambda x, v: x >= v, "mustBeBetween": lambda x, v: x.between(*v), "mustNotBeBetween": lambda x, v: ~x.between(*v),
}
_ROWWISE = re.compile(r"\s*SELECT\s+count\(\s*\*\s*\)\s+FROM\s+([\w.]+)\s+WHERE\s+(.+?)\s*;?\s*", re.I | re.S)
#: Conditions with these are no conditions on one row of one table.
_WIDER = re.compile(r"\b(?:SELECT|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT|UNION|JOIN|OVER)\b", re.I)


def read_contract(text: str) -> list[dict]:
    """The SQL rules of a declared contract, YAML or JSON: table, name, query, one of the ``must...`` conditions, severity. Rules of other
    types, which say something in words, are none."""
    try:
        contract = json.loads(text)
    except ValueError:
        import yaml

        contract = yaml.safe_load(text)
    out = []
    for table in contract.get("schema", []):
        for rule in [*table.get("quality", []), *(r | {"column": p["name"]} for p in table.get("properties", []) for r in p.get("quality", []))]:
            must = [k for k in rule if k.startswith("must")]
            if rule.get("type", "sql") != "sql" or "query" not in rule:
                continue
            if len(must) != 1 or must[0] not in _MUST:
                raise ValueError(f"{table['name']}.{rule.get('name')}: one known condition is needed, not {must}")
            out.append({"table": table["name"], "name": rule["name"], "query": rule["query"], "must": must[0], "value": rule[must[0]], "severity": rule.get("severity", "error")})
    return out


def declared_checks(rules: list[dict], tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rule, severity, observed, passed of declared rules (``read_contract``), as one plan.

    ``tables`` maps the names that the queries use. Queries that count the rows of one table where a condition holds become counts of one
    scan for each table; all others are given to Spark as they are, with the names bound to the DataFrames.
    """
    rowwise: dict[str, list[tuple[dict, str]]] = {}
    frames = []
    observed = lambda r, x: (F.lit(r["table"]).alias("table_name"), F.lit(r["name"]).alias("rule"), F.lit(r["severity"]).alias("severity"), x.cast("double").alias("observed"), F.coalesce(_MUST[r["must"]](x.cast("double"), r["value"]), F.lit(False)).alias("passed"))
    for r in rules:
        m = _ROWWISE.fullmatch(r["query"])
        if m and m[1] in tables and not _WIDER.search(m[2]):
            rowwise.setdefault(m[1], []).append((r, m[2]))
            continue
        names, sql = {}, r["query"].replace("{", "{{").replace("}", "}}")
        for i, t in enumerate(sorted(tables, key=len, reverse=True)):
            sql, n = re.subn(rf"(?<![\w.]){re.escape(t)}(?![\w.])", f"{{t{i}}}", sql)
            names |= {f"t{i}": tables[t]} if n else {}
        if not names:
            raise ValueError(f"{r['table']}.{r['name']} reads none of the tables {sorted(tables)}")
        one = next(iter(names.values())).sparkSession.sql(sql, **names)
        frames.append(one.select(*observed(r, F.col(one.columns[0]))))
    for table, own in rowwise.items():
        one = tables[table].agg(*(F.count_if(F.expr(c)).alias(f"_{i}") for i, (_, c) in enumerate(own)))
        frames.append(one.select(F.inline(F.array(*(F.struct(*observed(r, F.col(f"_{i}"))) for i, (r, _) in enumerate(own))))))
    return union_all(frames)


def offenders(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, offenders: how many rows each query of offenders returns."""
    return union_all([df.agg(F.count("*").alias("offenders")).select(F.lit(name).alias("rule"), "offenders") for name, df in rules.items()])


def schema_drift(df: DataFrame, declared: StructType) -> DataFrame:
    """column_name, problem of columns that are missing, extra or of another type; names with a leading _ are ignored."""
    spark = df.sparkSession
    side = lambda s, n: spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in s.fields if not f.name.startswith("_")], f"column_name string, {n} string")
    both = side(declared, "declared").join(side(df.schema, "live"), "column_name", "full_outer")
    problem = F.when(F.col("live").isNull(), "missing").when(F.col("declared").isNull(), "extra").when(F.col("live") != F.col("declared"), "type")
    return both.select("column_name", problem.alias("problem")).where(F.col("problem").isNotNull())


def value_drift(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """column_name, declared, unfit, rows: how many values do not convert to the declared type, in one pass."""
    unfit = lambda c, t: F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t})").isNull())
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("declared"), unfit(c, t).alias("unfit"), F.count("*").alias("rows")) for c, t in declared.items()))
    return df.agg(rows.alias("r")).select(F.inline("r"))
