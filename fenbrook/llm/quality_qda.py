"""Quality scores by regularised quadratic discriminant analysis.

Statistics of the text are transformed to be nearly normal, each class gets a mean and a
covariance shrunk towards the pooled one and towards a multiple of the identity, and a
document's score is the logistic of the difference of the two log densities. Moments are
summed by Spark over all labelled rows outside the held-out fold; the Cholesky factors are
made once on the driver, where only moments arrive, and reused for every batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, ship, stage
from .textstats import ratio, with_text_stats


def transformed() -> dict[str, Column]:
    """Log scales for counts, square roots for shares."""
    root = lambda a, b: F.sqrt(ratio(a, b))
    return {
        "log_words": F.log1p("n_words"),
        "log_lines": F.log1p(ratio("n_words", "n_lines")),
        "word_chars": F.log1p(ratio("word_chars", "n_words")),
        "symbols": root("n_symbols", "n_words"),
        "upper": root("n_upper", "n_chars_all"),
        "bangs": root("n_bangs", "n_words"),
        "digits": root("n_digits", "n_chars_all"),
        "stops": root("n_stops", "n_words"),
        "distinct": F.log1p("n_words") - F.log1p("n_distinct_words"),
        "dup_lines": root("n_dup_lines", "n_lines"),
    }


@dataclass
class Discriminant:
    """For classes 0 and 1: prior, mean, inverse Cholesky factor, log determinant."""

    log_prior: list[float]
    mean: list[np.ndarray]
    inverse: list[np.ndarray]
    log_det: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), np.exp(self.log_prior[1]))
        log = [p - 0.5 * (d + (((x - m) @ i.T) ** 2).sum(axis=1)) for p, m, i, d in zip(self.log_prior, self.mean, self.inverse, self.log_det, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """From each class's count, sums and sums of products. A class without rows gives a constant score."""
    n = {k: v[0] for k, v in moments.items()}
    total = sum(n.values())
    prior = [np.log((n.get(k, 0) + 1) / (total + 2)) for k in (0, 1)]
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return Discriminant(prior, [], [], [])
    mean = [moments[k][1] / n[k] for k in (0, 1)]
    scatter = [moments[k][2] - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / total
    inverse, log_det = [], []
    for k in (0, 1):
        s = (1 - shrink) * scatter[k] / n[k] + shrink * pooled
        s = (1 - ridge) * s + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(s))
        low = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(prior, mean, inverse, log_det)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrink: float = 0.2, ridge: float = 0.02) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: label 1 likelier), predicted.

    Labels count only outside the fold crc32(doc_id) mod 5 = 0. Null and empty texts have
    statistics of 0 and are scored like others. Labels that are null are ignored; without both
    classes the score is the prior. Repeated rows each give a row; a repeated label counts as often
    as it occurs. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    own = transformed()
    names = list(own)
    seen = stage(with_text_stats(docs.select("doc_id", "text"), repeats=False).select("doc_id", *(c.cast("double").alias(n) for n, c in own.items())))
    known = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", 5) != 0)).select("doc_id", F.col("quality").alias("y"))
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = seen.join(known, "doc_id").groupBy("y").agg(F.count("*").alias("n"), *(F.sum(n).alias(f"s{i}") for i, n in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs)).collect()
    moments = {}
    for r in sums:
        m = np.zeros((d, d))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        moments[r["y"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), m)
    model = fit(moments, shrink, ridge)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in cols])))

    out = seen.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), score(*names).alias("score"))
    return out.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
