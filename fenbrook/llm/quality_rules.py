"""Quality rules as a learned decision list.

Sequential covering over labelled statistics: a rule is a conjunction of thresholds,
grown by information gain on two thirds of the labelled rows and pruned on the rest;
rows that it covers are set aside and the next rule is grown. The result is an ordered
Spark conditional expression. Learning reads counts by feature and bin that Spark
aggregates, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, stage, uniform
from .textstats import ratio, with_text_stats



def features() -> dict[str, Column]:
    return {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "upper_share": ratio("n_upper", "n_chars_all"),
        "bangs_per_word": ratio("n_bangs", "n_words"),
        "digit_share": ratio("n_digits", "n_chars_all"),
        "stops_per_word": ratio("n_stops", "n_words"),
        "words_per_line": ratio("n_words", "n_lines"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "distinct_share": ratio("n_distinct_words", "n_words"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn_decision_list(rows: DataFrame, names: list[str], bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_cover: int = 5, seed: int = 5) -> list[Rule]:
    """Ordered rules that mark rows with bad = 1, from columns ``names`` and ``bad`` (0/1) and ``doc_id``.

    A rule stays if at least ``min_precision`` of what it covers on the pruning third is bad
    (or, where that third has none, on the growing rows). Without rows of both classes there are no rules.
    """
    rows = rows.withColumn("_grow", uniform(F.lit(seed), F.col("doc_id")) < 2 / 3)
    cuts_row = rows.agg(*(F.percentile_approx(n, [i / bins for i in range(1, bins)], 1000).alias(n) for n in names)).first()
    cuts = {n: sorted({x for x in (cuts_row[n] or []) if x is not None}) for n in names}
    reached = lambda n: F.size(F.filter(F.array(*map(F.lit, cuts[n])), lambda t: t <= F.col(n)))
    binned = F.array(*(F.struct(F.lit(k).alias("f"), reached(n).alias("b")) for k, n in enumerate(names) if cuts[n]))
    if not any(cuts.values()):
        return []
    rows = stage(rows.select("bad", "_grow", *names, binned.alias("_bins")))
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            counted = rows.where(F.col("_grow") & left & _all(rule)).select("bad", F.explode("_bins").alias("c")).groupBy("c.f", "c.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
            best = _best_condition(counted, names, cuts, min_cover)
            if best is None:
                break
            rule, pure = (*rule, best[0]), best[1]
            if pure:
                break
        if not rule:
            break
        sums = rows.where(left).agg(*(F.sum(F.when(_all(rule[:k]) & part & (F.col("bad") == v), 1).otherwise(0)) for k in range(1, len(rule) + 1) for part in (~F.col("_grow"), F.col("_grow")) for v in (1, 0))).first()
        scored = []
        for k in range(len(rule)):
            p, n, gp, gn = (x or 0 for x in sums[4 * k : 4 * k + 4])
            p, n = (p, n) if p + n else (gp, gn)
            scored.append(((p - n) / max(1, p + n), -k, p / max(1, p + n), p + n))
        value, short, precision, covered = max(scored)
        rule = rule[: 1 - short]
        if precision < min_precision or not covered:
            break
        rules.append(rule)
        left = left & ~_all(rule)
    return rules


def _best_condition(counted: list, names: list[str], cuts: dict, min_cover: int) -> tuple[Condition, bool] | None:
    """The threshold of the largest information gain on bad rows, and whether only bad rows are left."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counted:
        by.setdefault(r["f"], {})[r["b"]] = (int(r["p"]), int(r["n"] - r["p"]))
    best, found = 1e-9, None
    for f, hist in by.items():
        p_all, n_all = (sum(x[i] for x in hist.values()) for i in (0, 1))
        if not p_all or not n_all:
            continue
        base = math.log2(p_all / (p_all + n_all))
        p = n = 0
        for k, t in enumerate(cuts[names[f]]):
            p, n = p + hist.get(k, (0, 0))[0], n + hist.get(k, (0, 0))[1]
            for at_least, a, b in ((False, p, n), (True, p_all - p, n_all - n)):
                if a >= min_cover and (gain := a * (math.log2(a / (a + b)) - base)) > best:
                    best, found = gain, (Condition(names[f], at_least, float(t)), b == 0)
    return found


def apply_decision_list(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, else 0, as one ordered conditional."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(_all(rule), F.lit(k)) if out is None else out.when(_all(rule), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def quality_rules(docs: DataFrame, labels: DataFrame, bound: int = 20_000, min_words: int = 50, max_repeat_percent: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, rule (0: none), kept, and the columns ``keep``, which may hold the text.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent`` of the words in
    repeated 3-word windows. Of the others, those that a rule covers are not kept. Rules are learned
    from at most about ``bound`` labelled rows outside the held-out fold. Null and empty texts have
    counts of 0 and fail the base rule; without labels nothing but the base rule rejects. Repeated
    rows each give a row. Other columns are ignored.
    """
    # What is kept goes with the statistics, so that a verdict needs no join.
    stats = stage(with_text_stats(docs.select("doc_id", "text", *(F.col(c).alias(f"_keep_{c}") for c in keep))))
    own = features()
    seen = stats.select("*", *(c.alias(n) for n, c in own.items()), ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"))
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", (1 - F.col("quality")).alias("bad"))
    marked = bounded_sample(marked, "doc_id", bound, 8)
    rules = learn_decision_list(seen.where(~F.col("base_failed")).join(marked, "doc_id").select("doc_id", "bad", *own), list(own))
    rule = apply_decision_list(rules)
    return seen.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        rule.alias("rule"), (~F.col("base_failed") & (rule == 0)).alias("kept"), *(F.col(f"_keep_{c}").alias(c) for c in keep),
    )
