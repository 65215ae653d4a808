"""Mix sources to target weights by Efraimidis-Spirakis sampling without replacement.

Every document draws an exponential number, divided by its quality weight: in the order of these keys, the documents
of a source are a weighted sample without replacement of every length at once. A source gives as many complete epochs
as its target holds, and the first documents by key, up to the words that are left. Sources are cut into blocks by
key range, so that running sums of the largest source are made by many tasks. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, spread_join, stage
from .textstats import SPACE, SYMBOLS, words


def text_quality(text: Column, n_words: Column) -> Column:
    """0.25 to 1: less for repeated lines and for symbols among the words; 0.25 for a text without words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    fresh = F.size(F.array_distinct(lines)).cast("double") / F.greatest(F.size(lines), F.lit(1))
    plain = n_words / F.greatest(n_words + F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)), F.lit(1))
    return F.lit(0.25) + F.lit(0.75) * fresh * plain


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sources`` (one row each: source, total) with ``target``.

    All targets together are ``share`` of all totals, in proportion to ``weights``, which repeat over the sources in
    code point order, null last; what exceeds ``most`` times a total is shared again by weight until none does. In the order
    of most * total / weight, a source is at its limit as long as that is no more than the level at which the rest would stand,
    so one running sum finds the level.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    s = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("total")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (F.lit(share) * F.sum("total").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", rest)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every)
    return s.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))).drop("cap", "ratio", "level")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, quality: Column | None = None, seed: int = 13, rows_per_block: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (words), source_size and target of its source, taken (words that the mix takes).

    ``quality`` is a positive weight per document (``text_quality`` if not given). A source takes every document
    floor(target / source_size) times, then documents in the order of their keys as long as at least half of the next
    one is within what is left of the target: so it ends within half a document of it.

    Null and empty texts have size 0 and are taken 0 times. A null source is a source of its own, last in order. Null
    ids are ids like others; repeated rows have equal keys, are counted before they are sorted and each give a row, some of
    which may be taken once more than others. No rows give no rows. Other columns are ignored, whatever their names. Keys hash seed,
    id and text, so that reruns agree. The table of sources, one row each, is ranked in one task.
    """
    size = F.size(words(F.col("text"))).cast("bigint")
    thin = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), (F.lit(None) if quality is None else quality).cast("double").alias("own")).withColumn("size", size)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    weight = F.coalesce("own", text_quality(F.col("text"), F.col("size")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / F.lit(float(1 << 52))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    thin = stage(thin.select("doc_id", "source", name.alias("name"), "size", weight.alias("w"), (-F.log(u) / weight).alias("key"), digest.alias("digest")))
    sources = thin.groupBy("source", "name").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.avg("w").alias("w"))
    sources = source_targets(sources, weights, share, most)
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    sources = stage(sources.select("name", "total", "n", "target", F.col("w").alias("pace"), epochs.alias("epochs"), (F.col("target") - epochs * F.col("total")).alias("rest"), F.greatest(F.lit(8), F.ceil(F.col("n") / rows_per_block)).alias("blocks")))
    # Keys are near exponential with the mean weight as rate, so this deals a source about evenly and keeps the order.
    block = F.least(F.floor((1 - F.exp(-F.col("key") * F.col("pace"))) * F.col("blocks")), F.col("blocks") - 1)
    own = ["name", "total", "target", "epochs", "rest"]
    placed = spread_join(thin.drop("source", "w"), sources, "name", "n").withColumn("block", block)
    kinds = stage(placed.groupBy(*own, "block", "key", "doc_id", "digest", "size").agg(F.count("*").alias("copies")))
    mass = F.col("size") * F.col("copies")
    sums = kinds.groupBy("name", "block").agg(F.sum(mass).alias("mass"))
    earlier = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("name", "block", F.coalesce(F.sum("mass").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("name", "block").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    ranked = kinds.withColumn("before", F.coalesce(F.sum(mass).over(inside), F.lit(0))).join(sums, ["name", "block"])
    each = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    once = F.col("base") + F.col("before") + F.col("copy") * F.col("size") + F.col("size") / 2 <= F.col("rest")
    out = each.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("size") * (F.col("epochs") + once.cast("bigint"))).cast("bigint").alias("taken"))
    release(thin)
    return out
