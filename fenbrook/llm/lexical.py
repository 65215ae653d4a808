"""Ranked lexical search by norm buckets with Cauchy-Schwarz and coordinate bounds.

A document is the vector of its impacts on the terms of the queries, a query that of its term counts, each coordinate
times the root of the term's weight. Vectors are ordered by length and cut into buckets. A bucket whose longest vector
times the length of a query cannot reach the query's present k-th score is not looked at for that query. In the others,
the exact product over the query's focus coordinates plus the product of the lengths of the two rests bounds each
score; survivors are scored again in integers. The bounds are only ever too high, so the result is that of the full product.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, ship, stage

#: Bytes that are no part of a term become spaces, A to Z become a to z.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SLACK = 1 + 1e-9
_LAST = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with a term: all terms, and those of the vocabulary by number with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keep, ids, tfs, ends = [], [], [], [], [0]
            for at, text in enumerate(batch.column("text")):
                found = terms(text.as_py())
                if not found:
                    continue
                own = sorted(Counter(t for t in map(vocabulary.get, found) if t is not None).items())
                keep.append(at)
                n.append(len(found))
                ids.extend(t for t, _ in own)
                tfs.extend(c for _, c in own)
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((ids, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def _ends(lists: pa.ListArray) -> np.ndarray:
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0]


class Queries:
    """Queries of one block as vectors: numbers and integer coefficients of their terms, lengths, focus coordinates."""

    def __init__(self, counts: list[dict[int, int]], weights: np.ndarray, focus: float):
        self.weights, self.root = weights, np.sqrt(weights.astype(np.float64))
        self.terms, self.coef, self.norm, self.focus, self.rest = [], [], np.zeros(len(counts)), [], np.zeros(len(counts))
        for i, own in enumerate(counts):
            t = np.array(sorted(own), np.int64)
            c = np.array([own[x] for x in sorted(own)], np.int64)
            self.terms.append(t)
            self.coef.append(c * weights[t])
            square = (c * self.root[t]) ** 2
            order = np.argsort(-square, kind="stable")
            held = np.cumsum(square[order])
            k = int(np.searchsorted(held, focus * held[-1])) + 1 if len(held) else 0
            self.norm[i] = math.sqrt(square.sum())
            self.focus.append((t[order[:k]], (c * self.root[t])[order[:k]]))
            self.rest[i] = math.sqrt(max(0.0, square[order[k:]].sum()))

    def groups(self, active: np.ndarray, size: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Parts of the active queries: their numbers, the columns of their focus, and the focus coordinates and marks on these."""
        for at in range(0, len(active), size):
            part = active[at : at + size]
            columns = np.unique(np.concatenate([self.focus[q][0] for q in part]))
            value, mark = np.zeros((len(columns), len(part))), np.zeros((len(columns), len(part)))
            for j, q in enumerate(part):
                t, x = self.focus[q]
                rows = np.searchsorted(columns, t)
                value[rows, j], mark[rows, j] = x, 1
            yield part, columns, value, mark


class Bucket:
    """Vectors of one range of lengths, longest first: flat sorted (row, term) keys with their impacts."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, width: int):
        self.ids, self.norms, self.width = ids, norms, width
        self.rows = np.repeat(np.arange(len(ids)), np.diff(ends))
        self.terms, self.keys, self.impacts = terms.astype(np.int64), self.rows * width + terms, impacts

    def survivors(self, queries: Queries, columns: np.ndarray, value: np.ndarray, mark: np.ndarray, part: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in part) of the pairs whose bound reaches the query's least score."""
        at = np.searchsorted(columns, self.terms)
        here = columns[np.minimum(at, len(columns) - 1)] == self.terms
        x = np.zeros((len(self.ids), len(columns)))
        x[self.rows[here], at[here]] = self.impacts[here] * queries.root[self.terms[here]]
        bound = x @ value
        rest = np.maximum((self.norms**2)[:, None] * _SLACK - (x * x) @ mark, 0)
        bound += np.sqrt(rest) * queries.rest[part][None, :]
        return np.nonzero(bound * _SLACK + 1e-3 >= least[part][None, :])

    def score(self, rows: np.ndarray, terms: np.ndarray, coef: np.ndarray) -> np.ndarray:
        """Exact scores of some rows for one query."""
        if not len(self.keys):
            return np.zeros(len(rows), np.int64)
        want = rows[:, None] * self.width + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (np.where(self.keys[at] == want, self.impacts[at], 0) * coef[None, :]).sum(axis=1)


class Best:
    """The k best (score, id) of each query so far, by descending score, then ascending id, null last."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, least.astype(np.float64), {}

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.least[q])
        if not good.any():
            return
        s, i = scores[good], ids[good]
        if q in self.found:
            s, i = np.concatenate([self.found[q][0], s]), np.concatenate([self.found[q][1], i])
        top = np.lexsort((i, -s))[: self.k]
        self.found[q] = (s[top], i[top])
        if len(top) == self.k:
            self.least[q] = max(self.least[q], s[top[-1]])


def _search(queries: Queries, least: np.ndarray, k: int, width: int, rows: int, first_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, done = Best(k, least), False
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                ids = part.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
                norms, lists = part.column("norm").to_numpy(), part.column("terms")
                bucket = Bucket(ids, norms, _ends(lists), lists.flatten().to_numpy(), part.column("impacts").flatten().to_numpy(), width)
                active = np.nonzero((queries.norm > 0) & (queries.norm * norms.max() * _SLACK + 1e-3 >= best.least))[0]
                done = first_only or not len(active)  # what follows is shorter still
                for own, columns, value, mark in queries.groups(active):
                    row, place = bucket.survivors(queries, columns, value, mark, own, best.least)
                    order = np.argsort(place, kind="stable")
                    row, cuts = row[order], np.searchsorted(place[order], np.arange(len(own) + 1))
                    for j in np.nonzero(np.diff(cuts))[0]:
                        q, some = int(own[j]), row[cuts[j] : cuts[j + 1]]
                        best.add(q, bucket.score(some, queries.terms[q], queries.coef[q]), ids[some])
                if done:
                    break
            if done:
                break
        q = np.concatenate([np.full(len(s), q) for q, (s, _) in best.found.items()] or [np.zeros(0)])
        s, i = (np.concatenate([x[j] for x in best.found.values()] or [np.zeros(0)]).astype(np.int64) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, pa.int64(), mask=i == _LAST), pa.array(s, pa.int64())], ["q", "doc_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, focus: float = 0.95, bucket_rows: int = 1024, block_bytes: int = 4 << 20) -> DataFrame:
    """The ``k`` best documents of each row of ``items`` (item_id, text): item_id, rank (from 1), doc_id, score.

    Scores are those of the integer ranking function of the contract; only scores above 0 count, equal ones by ascending
    doc_id. Items go to the workers in blocks of about ``block_bytes`` of text by hash (a longer item alone), against all documents
    each; ``focus`` is the share of a query's squared length that its focus coordinates hold.

    Null and empty texts and texts without a term have no score and do not count in N. Null ids are last among equal scores.
    Repeated rows of either table are rows of their own; without documents or items there are no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    total = items.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    kind, out = dict(items.dtypes)["item_id"], None
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    stats = None
    for b in range(n_blocks):
        rows = items.where(block == b).select("item_id", F.col("text").cast("string").cast("binary").alias("text")).collect()
        found, stats = _search_block(docs, [(r["item_id"], bytes(r["text"]) if r["text"] is not None else None) for r in rows], kind, stats, k, focus, bucket_rows)
        out = found if out is None else out.union(found)
    return out


def _search_block(docs: DataFrame, items: list[tuple], kind: str, stats: tuple | None, k: int, focus: float, bucket_rows: int) -> tuple[DataFrame, tuple]:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    counts = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(text)) for _, text in items]
    thin = stage(term_counts(docs, vocabulary))
    stats = stats or tuple(x or 0 for x in thin.agg(F.count("*"), F.sum("n")).first())
    n_docs, n_terms = stats
    # One number a term of the block.
    df = {r["t"]: r["n"] for r in thin.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))] or [0], np.int64)
    queries, width = Queries(counts, weights, focus), max(1, len(vocabulary))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            t, tf, ends = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy(), _ends(lists)
            m = np.repeat(batch.column("m").to_numpy(), np.diff(ends))
            impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            norm = np.sqrt(np.add.reduceat(impacts.astype(np.float64) ** 2 * weights[t], ends[:-1])) if len(t) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(norm), lists, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(impacts))], ["doc_id", "norm", "terms", "impacts"])

    m = F.expr(f"cast(25 as bigint) + (cast(75 as decimal(20,0)) * cast(n as decimal(18,0)) * cast({n_docs} as decimal(18,0))) div cast({max(1, n_terms)} as decimal(18,0))")
    flat = thin.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs").mapInArrow(vectors, "doc_id bigint, norm double, terms array<int>, impacts array<bigint>")
    # Equal lengths are common among copies: the id deals them out.
    long_first = [F.desc("norm"), F.xxhash64("doc_id")]
    ordered = stage(flat.repartitionByRange(max(1, math.ceil(n_docs / (16 * bucket_rows))), *long_first).sortWithinPartitions(*long_first))
    schema = "q int, doc_id bigint, score bigint"
    heads = ordered.mapInArrow(_search(queries, np.zeros(len(items)), k, width, bucket_rows, True), schema)
    least = np.zeros(len(items))
    for r in _top(heads, k).where(F.col("rank") == k).select("q", "score").collect():  # one row an item of the block
        least[r["q"]] = r["score"]
    found = stage(_top(ordered.mapInArrow(_search(queries, least, k, width, bucket_rows, False), schema), k))
    release(thin, ordered)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"q int, item_id {kind}")
    return found.join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), stats
