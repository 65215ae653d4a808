"""A training corpus from raw documents, in stages that each read what the last one wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenbrook.llm.common import stage, table
from fenbrook.llm.decontam import decontaminate
from fenbrook.llm.minhash import near_duplicates
from fenbrook.llm.packing import pack
from fenbrook.llm.quality_rules import quality_rules
from fenbrook.llm.suffix_dedup import cut_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_id`` telling rows of different id or text apart, and the id that they have as ``_id``.

    An id that one row has stays. Rows without an id, and rows that share one, get a number from the hash of id and text, above those of
    real ids, rows without an id last; rows that are equal in both keep one number: they have the same verdict.
    """
    odd = stage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    own = docs.select(*COLUMNS).withColumn("_id", F.col("doc_id"))
    if not odd.take(1):
        return own
    made = F.when(F.col("_id").isNull(), F.lit(3 << 61)).otherwise(F.lit(1 << 62)) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 3)
    marked = own.join(odd.where("doc_id is not null").withColumn("_odd", F.lit(True)), "doc_id", "left")
    return marked.withColumn("doc_id", F.when(F.col("_id").isNull() | F.col("_odd"), made).otherwise(F.col("_id"))).drop("_odd")


def _back(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("_id")).select(*COLUMNS)


def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned rules keep, with an id, without one or with one that others have too.

    The texts go along with their statistics, so no verdict is looked up by its id.
    """
    return quality_rules(docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:]).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8), that of the smallest id; rows with an id of their own come
    before rows that share one, and these before rows without one. Of rows that are equal in id and text the first in the order of the other columns stays."""
    keyed = _keyed(docs)
    verdicts = stage(near_duplicates(keyed, k=5))
    left = keyed.join(verdicts.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")
    twice = stage(verdicts.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.take(1):
        return _back(left)
    same = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars", "_id")).alias("r")).select("doc_id", "r.*")
    return _back(left.join(twice, "doc_id", "left_anti").unionByName(same))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that a document of smaller id has; those of which no word is left go."""
    rest = cut_repeats(docs, length=50, keep_text=True, keep=("lang", "source", "n_chars"))
    whole = F.col("n_removed") == 0
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.length("kept_text").cast("bigint"))
    return rest.where(whole | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = _keyed(docs)
    found = decontaminate(keyed, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return _back(keyed.join(found, "doc_id", "left_anti"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", pass_quality_rules),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The learned rules, the tokenizer and the packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
