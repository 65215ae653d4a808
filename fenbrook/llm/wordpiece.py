"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes with an end-of-word symbol. Each node has a failure
link and the number of pieces that leaving it by that link completes, both computed once,
so a word is read symbol by symbol without backtracking and no piece is ever built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

END = 256
_CACHE_WORDS = 500_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 is itself, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary with word ends, as symbols."""
    chars = _byte_of_char()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = []
    for w in vocab:
        body, tail = (w[: -len(end)], (END,)) if w.endswith(end) else (w, ())
        if all(c in chars for c in body):
            out.append((*(chars[c] for c in body), *tail))
    return out


class LongestMatch:
    """The automaton: ``count`` gives the greedy pieces of a word, or None where the vocabulary cannot spell it."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for p in {*pieces, (END,)}:
            at = 0
            for c in p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = self.next[at][c]
            final[at] = bool(p)
        self.fail: list[int] = [-1] * len(self.next)
        self.popped: list[int] = [0] * len(self.next)
        level = [(0, c, v) for c, v in self.next[0].items()]
        while level:
            for parent, c, v in level:
                if final[v]:
                    self.fail[v], self.popped[v] = 0, int(parent > 0 or c != END)
                    continue
                z, popped = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.next[z]:
                    popped += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], popped
            level = [(v, c, w) for _, _, v in level for c, w in self.next[v].items()]

    def count(self, word: bytes) -> int | None:
        nxt, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for c in (*word, END):
            while (to := nxt[at].get(c)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return None
            at = to
        while at > 0:
            n += popped[at]
            at = fail[at]
        return n if at == 0 else None


class _Counts(dict):
    """Counts of words, kept for the next use up to a bound; a word that cannot be spelt counts as one piece."""

    def __init__(self, path: str):
        super().__init__()
        self.automaton = LongestMatch(read_vocabulary(path))

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        n = 1 if n is None else n
        if len(word) <= 64:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


_COUNTS: dict[str, _Counts] = {}


def counts_of(path: str) -> _Counts:
    if path not in _COUNTS:
        _COUNTS[path] = _Counts(path)
    return _COUNTS[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_pieces, max_word_pieces (0 without words).

    Words are runs of characters other than space and U+0009 to U+000D of the lower-cased text; each is
    cut greedily into the longest pieces of ``vocabulary``, the last of which holds the word end. Null and empty
    texts count 0. Repeated rows each give a row. Other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = counts_of(vocabulary).__getitem__
        for batch in batches:
            words, pieces, most = [], [], []
            for t in batch.column("text"):
                s = t.as_py()
                each = list(map(get, s.lower().encode("utf-8", "surrogatepass").split())) if s else []
                words.append(len(each))
                pieces.append(sum(each))
                most.append(max(each, default=0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, pieces, most))], ["doc_id", "n_words", "n_pieces", "max_word_pieces"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_words bigint, n_pieces bigint, max_word_pieces bigint")
