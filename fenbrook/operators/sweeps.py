"""Running values over ranges: sums carried from range to range, sliding windows as signed events.

Spark's sliding frames sum their buffer again for each row, and a running frame puts a whole key in one task. Here an order is
cut into ranges: a range is one window group, and what the ranges before it add up to, one row a range, is carried in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], cuts: int = 64) -> DataFrame:
    """``df`` with, for each (name: column), the sum of the column over the rows of the same ``by`` before this one in ``order``.

    The first column of ``order``, a number or a time, is cut at approximate quantiles of each ``by``; ties are settled
    by the rest of ``order``, which should tell any two rows of a ``by`` apart. Nulls come first and count as 0.
    """
    first = order[0]
    edges = df.groupBy(*by).agg(F.percentile_approx(first, [i / cuts for i in range(1, cuts)], 1000).alias("_edges"))
    edges = edges.select(*(F.col(b).alias(f"_by_{b}") for b in by), "_edges")
    ranged = df.join(edges, _same(df, by), "left").drop(*(f"_by_{b}" for b in by))
    ranged = ranged.withColumn("_range", F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(first))), F.lit(-1))).drop("_edges")
    return carried_sums(ranged, by, "_range", order, sums).drop("_range")


def _same(df: DataFrame, by: list[str]) -> Column:
    return reduce(Column.__and__, (df[b].eqNullSafe(F.col(f"_by_{b}")) for b in by))


def carried_sums(df: DataFrame, by: list[str], part: str, order: list[str | Column], sums: dict[str, str], through: bool = False) -> DataFrame:
    """The same over ranges that are there already: ``part`` grows with ``order``. With ``through``, this row's own value counts."""
    totals = df.groupBy(*by, part).agg(*(F.sum(c).alias(f"_total_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col(part).alias("_part"), *(F.sum(f"_total_{n}").over(earlier).alias(f"_base_{n}") for n in sums))
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    own = df.withColumns({f"_own_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    on = _same(own, by) & (own[part] == F.col("_part")) if by else own[part] == F.col("_part")
    zero = F.lit(0)
    return own.join(carried, on, "left").select(*df.columns, *((F.coalesce(f"_base_{n}", zero) + F.coalesce(f"_own_{n}", zero)).alias(n) for n in sums))


def sliding_sums(df: DataFrame, at: str, values: list[str], windows: dict[str, tuple[int, int]], slot: int) -> DataFrame:
    """``df``, one row a whole number ``at``, with a struct for each (name: (oldest, newest)): the sums of ``values`` over the rows
    whose ``at`` is ``oldest`` to ``newest`` before this row's, both ends included.

    Each row is an event that enters a window ``newest`` after it and one that leaves it after ``oldest``; one running sum of signed values gives
    all windows. Slots of ``slot`` numbers hold few rows whatever the table, since ``at`` is distinct.
    """
    names = [(w, v) for w in windows for v in values]
    moves = [(0, None, 0)] + [(shift, w, sign) for w, (oldest, newest) in windows.items() for shift, sign in ((newest, 1), (oldest + 1, -1))]
    row = lambda shift, w, sign: F.struct(
        (F.col(at) + shift).alias("_at"), F.lit(w is None).alias("_point"), *((F.col(v) * sign if n == w else F.lit(0)).cast("bigint").alias(f"_d_{n}_{v}") for n, v in names), *((F.col(c) if w is None else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes)
    )
    events = df.select(F.explode(F.array(*(row(*m) for m in moves))).alias("e")).select("e.*").withColumn("_slot", F.floor(F.col("_at") / slot))
    run = carried_sums(events, [], "_slot", ["_at", "_point"], {f"_s_{n}_{v}": f"_d_{n}_{v}" for n, v in names}, through=True)
    return run.where("_point").select(*df.columns, *(F.struct(*(F.col(f"_s_{w}_{v}").alias(v) for v in values)).alias(w) for w in windows))


def in_slots(df: DataFrame, at: str, slot: int, reach: int) -> DataFrame:
    """Each row in its slot of ``slot`` numbers, and once more (``_own`` false) in the next if that is within ``reach``, which is no longer than a slot."""
    home = F.floor(F.col(at) / slot)
    both = F.array_distinct(F.array(home, F.floor((F.col(at) + reach) / slot)))
    return df.withColumn("_slot", F.explode(both)).withColumn("_own", F.col("_slot") == home)
