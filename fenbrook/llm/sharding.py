"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The counts of rows that each input partition sends to each shard are drawn before
any row moves: they are a random matrix whose rows sum to the partition sizes, whose
columns sum to the shard sizes, distributed as a uniform permutation would make it.
Then each partition permutes its rows locally and cuts them by its matrix row, the
pieces are exchanged, and each shard is permuted again. Every row moves once, and
no global sort is needed. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

_U = "shiftrightunsigned(xxhash64({parts}), 11) / 9007199254740992D"


def _hypergeometric(good: str, total: str, draws: str, seed: str) -> str:
    """SQL that draws how many of ``draws`` balls are good, of ``total`` with ``good`` good ones.

    Walks the support from the mode, up and then down, with weights by the recurrence of
    the density, and keeps each value with its share of the weight so far; weights beyond
    twelve deviations are below what a double resolves.
    """
    u = _U.format(parts=f"{seed}, k")
    x = "if(k <= p.up, p.mode + k, p.mode - (k - p.up))"
    up = f"(p.good - ({x} - 1)) * (p.draws - ({x} - 1)) / (cast({x} as double) * (p.total - p.good - p.draws + {x}))"
    down = f"({x} + 1D) * (p.total - p.good - p.draws + {x} + 1) / ((p.good - {x}) * cast(p.draws - {x} as double))"
    w = f"CASE WHEN k = 0 THEN 1D WHEN k <= p.up THEN s.w * {up} WHEN k = p.up + 1 THEN {down} ELSE s.w * {down} END"
    start = f"""transform(array(named_struct(
        'good', {good}, 'total', {total}, 'draws', {draws},
        'lo', greatest(0L, {draws} - ({total} - {good})), 'hi', least({draws}, {good}),
        'reach', 30L + cast(ceil(12 * sqrt(greatest(0D, {draws} * ({good} / greatest(1D, {total})) * (1 - {good} / greatest(1D, {total})) * ({total} - {draws}) / greatest(1D, {total} - 1D)))) as bigint))),
        q -> named_struct('good', q.good, 'total', q.total, 'draws', q.draws, 'lo', q.lo, 'hi', q.hi, 'reach', q.reach,
        'mode', least(q.hi, greatest(q.lo, cast(floor((q.draws + 1D) * (q.good + 1D) / (q.total + 2D)) as bigint)))))"""
    start = f"""transform({start}, q -> named_struct('good', q.good, 'total', q.total, 'draws', q.draws, 'mode', q.mode,
        'up', least(q.hi - q.mode, q.reach), 'down', least(q.mode - q.lo, q.reach)))"""
    return f"""transform({start}, p -> aggregate(sequence(0L, p.up + p.down), named_struct('w', 0D, 'sum', 0D, 'pick', p.mode),
        (s, k) -> transform(array({w}), w -> named_struct('w', w, 'sum', s.sum + w,
            'pick', if(({u}) * (s.sum + w) < w, {x}, s.pick)))[0]).pick)[0]"""


def communication_matrix(counts: DataFrame, n_parts: int, n_shards: int, seed: int) -> DataFrame:
    """(part, row array<bigint>): how many rows partition ``part`` sends to each shard.

    ``counts`` has part in 0..n_parts-1 and n. The matrix is drawn by halving: the counts
    of the left half of the partitions are multivariate hypergeometric given those of the
    whole, and so on down, so each level is one narrow step and levels grow with the
    logarithm of the number of partitions.
    """
    levels = max(0, math.ceil(math.log2(max(1, n_parts))))
    size = 1 << levels
    filled = counts.sparkSession.range(size).select(F.col("id").cast("int").alias("part")).join(counts, "part", "left")
    node = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("part", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))), lambda s: s["n"]).alias("counts"))
    node = node.select(F.lit(0).alias("first"), "counts", F.expr("aggregate(counts, 0L, (a, b) -> a + b)").alias("rows"))
    node = node.select("first", "counts", F.expr(f"transform(sequence(0, {n_shards - 1}), j -> cast(rows div {n_shards} + if(j < rows % {n_shards}, 1, 0) as bigint))").alias("caps"))
    for level in range(levels):
        half = size >> (level + 1)
        x = _hypergeometric("caps[j]", "t.total", "t.draws", f"{seed}, {level}, first, j")
        left = f"""aggregate(sequence(0, {n_shards - 1}),
            named_struct('draws', aggregate(slice(counts, 1, {half}), 0L, (a, b) -> a + b), 'total', aggregate(counts, 0L, (a, b) -> a + b), 'out', cast(array() as array<bigint>)),
            (t, j) -> transform(array({x}), x -> named_struct('draws', t.draws - x, 'total', t.total - caps[j], 'out', concat(t.out, array(x))))[0]).out"""
        both = f"""flatten(transform(array({left}), l -> array(
            named_struct('first', first, 'counts', slice(counts, 1, {half}), 'caps', l),
            named_struct('first', first + {half}, 'counts', slice(counts, {half + 1}, {half}), 'caps', zip_with(caps, l, (a, b) -> a - b)))))"""
        node = node.select(F.explode(F.expr(both)).alias("c")).select("c.*")
        if level == 9:
            node = node.repartition(200, "first")
    return node.where(F.col("first") < n_parts).select(F.col("first").alias("part"), F.col("caps").alias("row"))


def shuffle_into_shards(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 50_000) -> DataFrame:
    """Deal all rows of ``docs`` into ``n_shards`` shards whose counts are at most one apart.

    Returns id, size (UTF-8 bytes of the text plus 8), text_crc32, law 'rows', shard, slot
    (gapless from 0 in each shard) and grown_shard (null: this law has none).

    Null and empty texts have size 8 and crc32 0. Null ids, equal texts and repeated rows are
    rows like others; each lands in a place of its own. No rows give no rows. Other columns are
    ignored. The same seed, input files and split settings give the same shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    thin = docs.select(F.col(id_col).alias("doc_id"), (F.length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    # Permute locally: a random order inside each input partition; a row's place there is its rank.
    local = thin.select("*", F.spark_partition_id().alias("part"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("key"))
    local = stage(local.sortWithinPartitions("key").select("doc_id", "size", "text_crc32", "part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("rank")))
    counts = stage(local.groupBy("part").agg(F.count("*").alias("n")))
    found = counts.agg(F.max("part"), F.sum("n")).first()
    n_parts, rows = (found[0] or 0) + 1, found[1] or 0
    matrix = stage(communication_matrix(counts, n_parts, n_shards, seed).select("part", F.expr("transform(sequence(1, size(row)), i -> aggregate(slice(row, 1, i), 0L, (a, b) -> a + b))").alias("ends")))
    shard = F.expr("cast(size(filter(ends, e -> e <= rank)) as int)")
    bits = max(3, math.ceil(math.log2(max(1, rows / n_shards / rows_per_block))))
    again = F.xxhash64(F.lit(seed + 1), "part", "rank")
    # Exchange, and permute again: random keys, of which the leading bits name a block, so that no shard is one task.
    dealt = stage(local.join(matrix, "part").select("doc_id", "size", "text_crc32", shard.alias("shard"), F.shiftrightunsigned(again, 64 - bits).alias("block"), again.alias("key"), "part", "rank"))
    blocks = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("key", "part", "rank")
    ranked = dealt.withColumn("i", F.row_number().over(inside) - 1)
    return ranked.join(blocks, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("i")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
