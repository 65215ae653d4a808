"""Language identification with a string kernel.

The kernel of two texts is the cosine of the sets of 1- to 3-grams of letters present in
them (blended spectrum, presence). Texts are compared with landmark texts only (Nyström):
the kernel matrix among landmarks is whitened, one-versus-rest ridge regression is solved
in that space, and both fold into one matrix, so a batch of texts is scored by two matrix
products. Training rows are a bounded sample; every text is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, ship, stage, uniform

SYMBOL_BITS = 7
_OTHER = 1  # a letter outside the alphabet; 0 is anything but a letter


@dataclass
class Spectrum:
    """Maps texts to presence vectors over the n-grams that landmarks have."""

    symbol: np.ndarray  # of each code point below 0x10000
    column: list[np.ndarray]  # for n = 1, 2, 3: column of each n-gram, or the last, unused one
    width: int

    def codes(self, text: str) -> np.ndarray:
        return _codes(self.symbol, text)

    def rows(self, grams: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Unit rows of the n-grams present, given as their codes for n = 1, 2, 3."""
        x = np.zeros((len(grams), self.width + 1), np.float32)
        for i, each in enumerate(grams):
            for n, g in enumerate(each):
                x[i, self.column[n][g]] = 1
        x = x[:, :-1]
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return x

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit rows of present n-grams, and whether the text has a letter."""
        codes = [self.codes(t) for t in texts]
        letter = np.array([bool(c.any()) for c in codes], bool)
        return self.rows([tuple(_grams(c)) if ok else () for c, ok in zip(codes, letter, strict=True)]), letter


def _codes(symbol: np.ndarray, text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = symbol[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        far = np.flatnonzero(points > 0xFFFF)
        out = out.copy()
        out[far] = [_OTHER * chr(points[i]).isalpha() for i in far]
    return out


def _grams(s: np.ndarray) -> Iterator[np.ndarray]:
    s = s.astype(np.int32)
    yield s
    two = (s[:-1] << SYMBOL_BITS) | s[1:]
    yield two
    yield (two[:-1] << SYMBOL_BITS) | s[2:]


def letters(text: str) -> Counter:
    return Counter(c for c in text.lower() if c.isalpha() and ord(c) < 0x10000)


def alphabet(counts: dict[str, int]) -> np.ndarray:
    """The symbol of each code point: the 126 most frequent letters have one each; all other letters are one, so that
    languages of large scripts are told apart by what they share with the landmarks and by where such letters stand."""
    number = {c: k for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: (1 << SYMBOL_BITS) - 2], 2)}
    return np.array([number.get(chr(p).lower()[:1], _OTHER) if chr(p).isalpha() else 0 for p in range(0x10000)], np.uint8)


def present(symbol: np.ndarray, text: str) -> tuple[np.ndarray, ...]:
    """Which n-grams a text has, each once."""
    return tuple(np.unique(g) for g in _grams(_codes(symbol, text)))


def spectrum(symbol: np.ndarray, landmarks: list[tuple[np.ndarray, ...]]) -> Spectrum:
    """The columns are the n-grams that the landmarks have."""
    s = Spectrum(symbol, [], 0)
    seen = [np.zeros(1 << SYMBOL_BITS * n, bool) for n in (1, 2, 3)]
    for grams in landmarks:
        for n, g in enumerate(grams):
            seen[n][g] = True
    for x in seen:
        x[0] = False  # blanks only
    s.width = int(sum(x.sum() for x in seen))
    at = 0
    for x in seen:
        c = np.full(len(x), s.width, np.int32)
        c[x] = np.arange(at, at + x.sum())
        at += int(x.sum())
        s.column.append(c)
    return s


def whiten(kernel: np.ndarray, least: float = 1e-6) -> np.ndarray:
    value, vector = np.linalg.eigh(kernel)
    keep = value > least * max(value.max(), least)
    return vector[:, keep] / np.sqrt(value[keep])


def ridge(features: np.ndarray, y: np.ndarray, n_classes: int, penalty: float) -> np.ndarray:
    """One column of weights for each class against the rest; classes weigh the same in total."""
    count = np.bincount(y, minlength=n_classes).clip(1)
    w = (1 / count)[y][:, None] * len(y) / n_classes
    a = features.T @ (features * w) + penalty * np.eye(features.shape[1])
    return np.linalg.solve(a, features.T @ (np.eye(n_classes)[y] * w))


def identify_languages(docs: DataFrame, n_landmarks: int = 96, train_bound: int = 4000, penalty: float = 1.0, seed: int = 6) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and lang of rows outside the fold crc32(doc_id) mod 4 = 2, at most about
    ``train_bound`` of them in equal parts by language. Letters beyond the 126 most frequent ones of the landmarks are one symbol. ``und`` with score 0 for null text, text without a letter,
    and where nothing could be learnt. Rows without a lang are scored but not learnt from. Equal scores go to the
    language that sorts first. Repeated rows each give a row. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    known = docs.where(~held & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in docs.where(~held & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    out = "doc_id bigint, lang_pred string, score double"
    base = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    share = max(1, train_bound // max(1, len(langs)))
    u = uniform(F.lit(seed), F.col("doc_id"))
    chosen = F.lit(False)
    for lang in langs:
        chosen = chosen | ((F.col("lang") == lang) & (u < min(1.0, share / counts[lang])))
    sample = stage(known.where(chosen).withColumn("u", u))
    first = Window.partitionBy("lang").orderBy("u", "doc_id")
    marks = stage(sample.withColumn("i", F.row_number().over(first)).where(F.col("i") <= max(1, n_landmarks // max(1, len(langs)))).select("lang", "i", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter()
            for t in batch.column("text").to_pylist():
                n.update(letters(t))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["c", "n"])

    # However long the landmarks are, the driver sees letters and n-grams, of which there are few: at most 2^21 a landmark.
    counts_of = {r["c"]: r["n"] for r in marks.mapInArrow(count, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    symbol = alphabet(counts_of)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [present(symbol, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("i"), *(pa.array([e[n].astype(np.int32).tobytes() for e in each], pa.binary()) for n in range(3))], ["lang", "i", "g1", "g2", "g3"])

    rows = marks.mapInArrow(grams, "lang string, i int, g1 binary, g2 binary, g3 binary").collect()
    if not rows:
        return base.select("doc_id", held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found = [tuple(np.frombuffer(r[g], np.int32) for g in ("g1", "g2", "g3")) for r in sorted(rows, key=lambda r: (r["lang"], r["i"]))]
    s = spectrum(symbol, found)
    own = s.rows(found)
    white = whiten((own @ own.T).astype(float))

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                x, _ = s.presence(batch.column("text").slice(k, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(k, 256), pa.array((x @ own.T).astype(float).tolist(), pa.list_(pa.float64()))], ["lang", "k"])

    rows = sample.select("lang", "text").mapInArrow(kernels, "lang string, k array<double>").collect()
    phi = np.array([r["k"] for r in rows]) @ white
    phi = np.column_stack([phi, np.ones(len(phi))])
    index = {x: i for i, x in enumerate(langs)}
    beta = ridge(phi, np.array([index[r["lang"]] for r in rows]), len(langs), penalty)
    weights, bias = (own.T @ (white @ beta[:-1])).astype(np.float32), beta[-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                x, letter = s.presence([t or "" for t in batch.column("text").slice(k, 256).to_pylist()])
                f = x @ weights + bias
                best = f.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(k, 256),
                        pa.array([langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)], pa.string()),
                        pa.array(np.where(letter, f.max(axis=1).clip(0, 1), 0.0), pa.float64()),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    return base.mapInArrow(score, out).select("doc_id", held.alias("held_out"), "lang_pred", "score")
