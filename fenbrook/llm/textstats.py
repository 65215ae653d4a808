"""Statistics of whole texts as Spark expressions.

Words are runs of other characters than space and U+0009 to U+000D. Null text counts
as empty. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def with_text_stats(df: DataFrame, text_col: str = "text", repeats: bool = True) -> DataFrame:
    """``df`` without the text, with these long columns of each whole text:

    n_chars_all, n_words, word_chars, n_symbols, n_upper, n_digits, n_bangs, n_stops,
    n_lines (with a word), n_dup_lines (equal to an earlier one), n_distinct_words and,
    if ``repeats``, n_repeat_words (words in 3-word windows that occur twice or more).
    Windows are compared by 64-bit hashes inside one text. Names of other columns that
    clash with these are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    names = ("n_chars_all", "n_words", "word_chars", "n_symbols", "n_upper", "n_digits", "n_bangs", "n_stops", "n_lines", "n_dup_lines", "n_distinct_words", "n_repeat_words")
    own = [c for c in df.columns if c != text_col and c not in names]
    a = df.select(
        *own,
        F.length(text).cast("bigint").alias("n_chars_all"),
        words(F.col(text_col)).alias("_words"),
        lines.alias("_lines"),
        *(F.regexp_count(text, F.lit(p)).cast("bigint").alias(n) for n, p in (("n_symbols", SYMBOLS), ("n_upper", "[A-Z]"), ("n_digits", "[0-9]"), ("n_bangs", "!"), ("n_stops", "[.,;:?]"))),
    )
    n = F.size("_words")
    b = a.select(
        *own, "n_chars_all", "n_symbols", "n_upper", "n_digits", "n_bangs", "n_stops",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("_words")).cast("bigint").alias("n_distinct_words"),
        *([F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2)))).alias("_h")] if repeats else []),
    )
    if not repeats:
        return b
    # Only texts with a window that occurs twice sort theirs: equal neighbours are repeats.
    kept = [c for c in b.columns if c != "_h"]
    c = b.select(*kept, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("_s"))
    same = lambda e, j: F.coalesce(F.get(F.col("_s"), j)["x"] == e["x"], F.lit(False))
    d = c.select(*kept, F.sort_array(F.transform(F.filter("_s", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])).alias("_p"))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n")),
        lambda s: s["n"],
    )
    return d.select(*kept, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))
