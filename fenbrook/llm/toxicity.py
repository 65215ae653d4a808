"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes: insult, threat, target, negation, reported speech, other. Small
transducers read a clause: one follows negation scopes, one reported speech, one targets
that have been named, one, from the right, targets that are still to come, and one turns insults and threats into events. Their
composition is one automaton whose state is the tuple of theirs and whose outputs are events such as "insult, aimed, not
negated, not reported". A document's score is a logistic function of the weighted
events of its clauses. Insults are a short fixed list and word stems learnt from a bounded sample
of labelled rows; event weights are learnt there too, pulled towards their prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, ship, stage

# Word lists in English, German, French and Spanish.
INSULTS = (
    "idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "trash", "scum", "clown", "dumb", "jerk", "vermin", "filth", "imbecile", "coward",
    "dummkopf", "trottel", "vollidiot", "abschaum", "dreckskerl", "versager", "feigling", "widerlich", "wertlos",
    "crétin", "abruti", "minable", "ordure", "salaud", "lâche", "imbécile", "débile", "dégoûtant",
    "idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "cobarde", "asqueroso", "inútil", "patético",
)
THREATS = (
    "kill", "hurt", "destroy", "crush", "stab", "shoot", "strangle", "beat", "burn",
    "töten", "umbringen", "vernichten", "verprügeln", "tuer", "frapper", "détruire", "écraser", "matar", "golpear", "destruir", "quemar",
)
TARGETS = (
    "you", "your", "yours", "yourself", "u", "he", "she", "him", "her", "they", "them", "these", "those", "people",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "ihn", "tu", "toi", "te", "vous", "votre", "elle", "eux", "ils", "ella", "tú", "ti", "usted", "ustedes", "ellos", "ellas",
)
NEGATIONS = ("not", "no", "never", "neither", "nor", "without", "hardly", "don't", "isn't", "aren't", "wasn't", "won't", "cannot", "nicht", "kein", "keine", "nie", "ohne", "ne", "pas", "jamais", "sans", "nunca", "sin")
REPORTS = ("said", "says", "called", "calls", "wrote", "claimed", "claims", "quoted", "quote", "alleged", "sagte", "schrieb", "behauptet", "disait", "dit", "écrit", "dijo", "dice", "escribió")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, HINT, MARK, SURE = range(9)
#: Learnt stems are kinds of their own: those that no clean row has, those that few have, and those that some have.
KINDS = ("insult", "threat", "hint", "mark", "sure")
_KIND = {INSULT: "insult", THREAT: "threat", HINT: "hint", MARK: "mark", SURE: "sure"}
#: (kind, aimed, negated, reported); the number of an event is its place here.
EVENTS = [(k, a, n, r) for k in KINDS for a in (False, True) for n in (False, True) for r in (False, True)]
_NUMBER = {e: i for i, e in enumerate(EVENTS)}
_FIXED = {w: c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INSULT, INSULTS)) for w in ws}
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_STOP = re.compile(r"[.,;:!?\n]")
NEGATION_REACH, TARGET_REACH = 3, 5
STEMS = range(4, 9)


def _negation(state: int, c: int) -> tuple[int, bool]:
    return (NEGATION_REACH, False) if c == NEGATION else (max(0, state - 1), state > 0)


def _report(state: int, c: int) -> tuple[int, bool]:
    return (1 if c == REPORT else state), bool(state)


def _target(state: int, c: int) -> tuple[int, bool]:
    return (TARGET_REACH, False) if c == TARGET else (max(0, state - 1), state > 0)


@lru_cache(maxsize=4096)
def step(state: tuple[int, int, int], c: int, ahead: bool) -> tuple[tuple[int, int, int], int]:
    """The composed transducer, of a word's class and what the one from the right says of it: next state and the event put out (-1: none)."""
    (n, negated), (r, reported), (t, before) = _negation(state[0], c), _report(state[1], c), _target(state[2], c)
    aimed = before or ahead
    event = _NUMBER[_KIND[c], aimed, negated, reported] if c in _KIND and (c != THREAT or aimed) else -1
    return (n, r, t), event


def clause_events(classes: list[int]) -> list[int]:
    """Events of a clause: the target transducer reads it from the right, then the composed one from the left."""
    coming, ahead = 0, []
    for c in reversed(classes):
        coming, seen = _target(coming, c)
        ahead.append(seen)
    state, out = (0, 0, 0), []
    for c, a in zip(classes, reversed(ahead), strict=True):
        state, e = step(state, c, a)
        if e >= 0:
            out.append(e)
    return out


@dataclass
class Grammar:
    stems: dict[str, int] = field(default_factory=dict)  # HINT, MARK or SURE
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self) -> None:
        self._find = None

    def find(self) -> re.Pattern:
        if self._find is None:
            exact = sorted(w for w, c in _FIXED.items() if c in (INSULT, THREAT))
            stems = sorted(self.stems)
            self._find = re.compile(r"\b(?:(?:" + "|".join(map(re.escape, exact)) + r")\b" + ("|" + "|".join(map(re.escape, stems)) if stems else "") + ")")
        return self._find

    def word_class(self, word: str) -> int:
        c = _FIXED.get(word, OTHER)
        if c == OTHER:
            return max((self.stems[word[:n]] for n in STEMS if word[:n] in self.stems), default=OTHER)
        return c

    def events(self, text: str | None) -> np.ndarray:
        """How many events of each kind the clauses of a text have."""
        counts = np.zeros(len(EVENTS))
        end = 0
        low = text.lower() if text else ""
        for m in self.find().finditer(low):
            if m.start() < end:
                continue  # of a clause that has been read
            a = m.start()
            while a > 0 and low[a - 1] not in ".,;:!?\n":
                a -= 1
            b = _STOP.search(low, m.end())
            end = b.start() if b else len(low)
            for e in clause_events([self.word_class(w) for w in _WORD.findall(low, a, end)]):
                counts[e] += 1
        return counts

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(counts) @ self.weights, -500, 500)))


def _prior(e: tuple) -> float:
    kind, aimed, negated, reported = e
    return {"insult": 4.0, "threat": 3.0, "hint": 1.5, "mark": 3.0, "sure": 5.0}[kind] * (1.2 if aimed else 1.0) * (0.3 if negated else 1.0) * (0.4 if reported else 1.0)


PRIOR = np.array([-3.0, *map(_prior, EVENTS)])


def design(counts: np.ndarray) -> np.ndarray:
    counts = np.atleast_2d(counts)
    return np.column_stack([np.ones(len(counts)), np.log2(1 + counts)])


def fit_weights(counts: np.ndarray, y: np.ndarray, pull: float = 0.5, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, with a quadratic pull to the prior weights."""
    x, w = design(counts), PRIOR.copy()
    if not len(y):
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def learn_stems(sample: DataFrame, min_docs: int = 5, min_share: float = 0.02, hint_odds: float = 8.0, mark_odds: float = 30.0) -> dict[str, int]:
    """Word beginnings of 4 to 8 letters that mark toxic rows of ``sample`` (text, y) and hardly any other: SURE if no other has it, MARK or HINT by its odds.

    Copies and near copies count once: rows with equal minima of three hashes of their long words are one.
    Spark counts, for each beginning, the rows of either class that have it; the driver sees those in
    ``min_docs`` toxic rows and ``min_share`` of them at least. A longer one is left out if a shorter one says as much.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    least = lambda k: F.array_min(F.transform(F.filter("words", lambda w: F.length(w) >= 7), lambda w: F.xxhash64(F.lit(k), w)))
    alone = sample.select("y", "text", words.alias("words")).select("y", "words", F.coalesce(F.xxhash64(least(1), least(2), least(3)), F.xxhash64("text")).alias("sketch"))
    alone = stage(alone.where(F.size("words") > 0).dropDuplicates(["y", "sketch"]).select("y", "words"))
    n = {r["y"]: r["n"] for r in alone.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    stems = F.array_distinct(F.flatten(F.transform("words", lambda w: F.transform(F.filter(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[-1])), lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n)))))
    odds = ((F.col("a") + 0.5) / (n[1] + 1)) / ((F.col("b") + 0.5) / (n[0] + 1))
    counted = alone.select("y", F.explode(stems).alias("s")).groupBy("s").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    rows = counted.where((F.col("a") >= max(min_docs, min_share * n[1])) & (odds >= hint_odds)).select("s", "b", (odds >= mark_odds).alias("marks")).collect()
    best: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (len(r["s"]), r["s"])):
        own = SURE if not r["b"] else MARK if r["marks"] else HINT
        if all(best.get(r["s"][:k], OTHER) < own for k in range(STEMS[0], len(r["s"]))):
            best[r["s"]] = own
    return best


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = 10_000) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: label 1 likelier), predicted, n_events.

    Labels count only outside the fold crc32(doc_id) mod 5 = 0, of at most about ``bound`` rows of each class.
    Null and empty texts have no events and get the score of none. Null labels are ignored; without
    labels the fixed lists and prior weights hold. Repeated rows each give a row. Other columns are ignored.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    known = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0)).select("doc_id", F.col("toxic").cast("bigint").alias("y"))
    marked = bounded_sample(known.where("y = 1"), "doc_id", bound, 71).union(bounded_sample(known.where("y = 0"), "doc_id", bound, 72))
    # At most about 2 * bound ids: small enough to send everywhere, so that no text is shuffled.
    sample = stage(base.join(F.broadcast(marked), "doc_id"))
    grammar = Grammar(learn_stems(sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [grammar.events(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(each, pa.list_(pa.float64()))], ["y", "x"])

    rows = sample.select("y", "text").mapInArrow(count, "y bigint, x array<double>").collect()
    grammar.weights = fit_weights(np.array([r["x"] for r in rows]).reshape(-1, len(EVENTS)), np.array([r["y"] for r in rows], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = np.array([grammar.events(t.as_py()) for t in batch.column("text")]).reshape(-1, len(EVENTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(grammar.score(each), pa.float64()), pa.array(each.sum(axis=1).astype(np.int64))], ["doc_id", "score", "n_events"])

    scored = base.mapInArrow(score, "doc_id bigint, score double, n_events bigint")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_events")
