"""Phrase collocations by mergeable Misra-Gries summaries, counted exactly in a second pass.

The first pass sums n-grams by hash inside chunks of text and sends the sums to hash partitions. Each partition merges them
into one Misra-Gries summary: whenever it holds more counters than its mass divided by the threshold, the largest
counter beyond that number is taken from all and those without rest go. So no counter loses as much as the threshold, and every
n-gram that reaches it survives. Survivors become bits of a map of fixed size. One and two words go first; longer n-grams are
looked at only where all their pairs survive. The second pass counts the n-grams whose bit is set as what they are, not
by hash, so collisions and survivors too many cost time but change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, ship, stage

#: Whatever ends a piece becomes a full stop, which no word holds; A to Z become a to z.
_PIECES = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Words of some text of one language as numbers; number 0 is the end of a piece."""

    def __init__(self, text: bytes, lang: str):
        own = _Ids()
        own[b"."] = 0
        found = text.replace(b".", b" . ").split()
        self.ids = np.fromiter(map(own.__getitem__, found), np.int64, len(found))
        self.words, self.lang = list(own), lang
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hash = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)[self.ids]
        self.run = self.ids != 0

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each place are in one piece."""
        size = max(0, len(self.ids) - n + 1)
        ok = self.run[:size].copy()
        for j in range(1, n):
            ok &= self.run[j : size + j]
        return ok

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n words from each place."""
        size = max(0, len(self.ids) - n + 1)
        x = self.hash[:size].copy()
        for j in range(1, n):
            x = x * _M1 + self.hash[j : size + j]
        return _mix(x + np.uint64(n))


def chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[Chunk]:
    """All texts by language in chunks of about ``chunk_bytes``; they end where a piece ends."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def cut(lang: str) -> Iterator[Chunk]:
        text, at = b".".join(held.pop(lang)), 0
        del size[lang]
        while at < len(text):
            end = text.find(b".", at + chunk_bytes)
            end = len(text) if end < 0 else end
            yield Chunk(text[at:end], lang)
            at = end

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            lang = lang.as_py()
            raw = text.as_py().translate(_PIECES)
            held.setdefault(lang, []).append(raw)
            size[lang] = size.get(lang, 0) + len(raw)
            if size[lang] >= chunk_bytes:
                yield from cut(lang)
            elif sum(size.values()) >= 2 * chunk_bytes:
                for x in list(held):
                    yield from cut(x)
    for x in list(held):
        yield from cut(x)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one with the sum of their counts, in the order of keys."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Summary:
    """A mergeable Misra-Gries summary: at most ``capacity`` counters; ``lost`` is the most that any counter has lost."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        k, c = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(k) > self.capacity:
            less = int(np.partition(c, len(c) - self.capacity - 1)[len(c) - self.capacity - 1])
            left = c > less
            k, c, self.lost = k[left], c[left] - less, self.lost + less
        self.keys, self.counts = k, c

    def may_reach(self, least: int) -> np.ndarray:
        return self.keys[self.counts + self.lost >= least]


class BitMap:
    """2^bits bits, of which the first ``bits`` bits of a hash name one."""

    def __init__(self, data: bytes, bits: int):
        self.bytes, self.shift = np.frombuffer(data, np.uint8), np.uint64(64 - bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def surviving(docs: DataFrame, lengths: tuple[int, ...], least: int, n_buckets: int, bits: int, chunk_bytes: int, held_sums: int, pairs=None) -> bytes:
    """The bit map of all n-grams of these lengths that occur ``least`` times or more in a language, and some others.

    ``docs`` has text (binary) and lang, neither null. ``pairs``: a broadcast map; only n-grams with all their pairs in it count.
    """
    level = n_buckets.bit_length() - 1
    back, low = np.uint64(64 - level), np.uint64(32 - level)

    def flush(keys: list, counts: list) -> pa.RecordBatch:
        k, c = _summed(np.concatenate(keys), np.concatenate(counts))
        at = np.searchsorted(k >> back if level else np.zeros(len(k), np.uint64), np.arange(n_buckets + 1))
        some = np.flatnonzero(np.diff(at))
        mass = np.add.reduceat(c, at[some]) if len(some) else np.zeros(0, np.int64)
        sent, ends = (k >> low).astype(np.uint32), np.concatenate([at[some], [len(k)]]).astype(np.int32) * 4
        blob = lambda a: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(a)])
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(mass, pa.int64()), blob(sent), blob(c.astype(np.uint32))], ["bucket", "mass", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BitMap(pairs.value, bits) if pairs else None
        keys, counts, held = [], [], 0
        for chunk in chunks(batches, chunk_bytes):
            two = known.has(chunk.grams(2)) if known else None
            for n in lengths:
                ok = chunk.inside(n)
                for j in range(n - 1) if known else ():
                    ok &= two[j : j + len(ok)]
                k, c = np.unique(chunk.grams(n)[ok], return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
            if held >= held_sums:
                yield flush(keys, counts)
                keys, counts, held = [], [], 0
        if held:
            yield flush(keys, counts)

    sums = stage(docs.mapInArrow(count, "bucket int, mass bigint, keys binary, counts binary"))
    capacity = sums.groupBy("bucket").agg((F.floor(F.sum("mass") / least) + 1).alias("capacity"))  # more than mass / least

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slice_of(bucket: int, s: Summary) -> pa.RecordBatch:
            # The bucket's part of the map: the bits after the bucket's own.
            on = np.zeros(max(8, 1 << (bits - level)), np.uint8)
            on[s.may_reach(least) >> np.uint32(32 - (bits - level))] = 1
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

        at, own = None, None
        for batch in batches:
            for bucket, room, k, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "capacity", "keys", "counts")), strict=True):
                if bucket != at:
                    if own:
                        yield slice_of(at, own)
                    at, own = bucket, Summary(room)
                own.merge(np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint32).astype(np.int64))
        if own:
            yield slice_of(at, own)

    # All sums of a bucket meet in one task, which holds one summary at a time.
    dealt = sums.select("bucket", "keys", "counts").join(F.broadcast(capacity), "bucket").repartition("bucket").sortWithinPartitions("bucket")
    out = bytearray(1 << (bits - 3))
    step = len(out) // n_buckets
    for r in dealt.mapInArrow(merge, "bucket int, bits binary").collect():  # the map, a fixed size in all
        out[r["bucket"] * step : (r["bucket"] + 1) * step] = r["bits"]
    release(sums)
    return bytes(out)


def count_frequent(docs: DataFrame, longest: int, least: int, maps: list, bits: int, chunk_bytes: int) -> DataFrame:
    """(lang, size, phrase, f) exactly, of every phrase up to ``longest`` words with f >= least, and (lang, 0, '', words of the language)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = (BitMap(m.value, bits) for m in maps)
        for chunk in chunks(batches, chunk_bytes):
            ids, words = chunk.ids, chunk.words
            out: list[tuple[int, str, int]] = [(0, "", int(chunk.run.sum()))]
            for n in range(1, longest + 1):
                at = np.flatnonzero(chunk.inside(n) & (short if n < 3 else long).has(chunk.grams(n)))
                code = ids[at]
                for j in range(1, n):  # the number of the part so far, then that of the next word: equal codes are equal words
                    code = np.unique(code, return_inverse=True)[1].reshape(-1) * len(words) + ids[at + j]
                _, first, f = np.unique(code, return_index=True, return_counts=True)
                for place, times in zip(at[first].tolist(), f.tolist(), strict=True):
                    out.append((n, b" ".join([words[w] for w in ids[place : place + n].tolist()]).decode("utf-8", "replace"), times))
            size, phrase, f = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([chunk.lang] * len(out)), pa.array(size, pa.int32()), pa.array(phrase), pa.array(f, pa.int64())], ["lang", "size", "phrase", "f"])

    sums = docs.mapInArrow(count, "lang string, size int, phrase string, f bigint").groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return sums.where((F.col("f") >= least) | (F.col("size") == 0))


def _score(a: str, l: str, r: str) -> str:  # noqa: E741
    return f"(cast(2000000 as decimal(7,0)) * cast({a} as decimal(19,0))) div (cast({l} as decimal(19,0)) + cast({r} as decimal(19,0)))"


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, bits: int = 27, bucket_bytes: int = 4 << 20, chunk_bytes: int = 4 << 20, held_sums: int = 3_000_000) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words: lang, rank (from 1), phrase, a, l, r, n, score.

    a is how often the phrase occurs, l and r how often the two parts do at the cut of the lowest score floor(2000000 a / (l + r)), ties
    to the shortest first part, n the words of the language. Phrases that lie inside a longer one that occurs ``least`` times
    and at least 0.8 times as often go. The order is score and a descending, phrase ascending by UTF-8 bytes.

    ``bits`` sets the size of the two bit maps sent to the workers (2^bits bits each, 16 MB), ``bucket_bytes`` the text a hash partition stands for;
    a worker reads ``chunk_bytes`` of text at a time and holds about ``held_sums`` sums before it sends them.
    Null text counts as empty, a null language as 'und'. Repeated rows count each. Without a phrase that is frequent enough, and
    without documents, there are no rows. Other columns are ignored, whatever their names.
    """
    if longest > 4 or longest < 2:
        raise ValueError("phrases have 2 to 4 words")
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where(F.length("text") > 0)
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_buckets = 1 << min(16, max(3, math.ceil(math.log2(max(1, total / bucket_bytes)))))
    short = sc.broadcast(surviving(texts, (1, 2), least, n_buckets, bits, chunk_bytes, held_sums))
    long = sc.broadcast(surviving(texts, tuple(range(3, longest + 1)), least, n_buckets, bits, chunk_bytes, held_sums, short))
    found = stage(count_frequent(texts, longest, least, [short, long], bits, chunk_bytes))
    short.destroy()
    long.destroy()
    n = found.where("size = 0").select("lang", F.col("f").alias("n"))
    known = found.where("size > 0")
    candidates = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda i, k: F.array_join(F.slice("w", i, k), " ")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("first"), part(k + 1, F.col("size") - k).alias("rest")))).alias("c")).select("lang", "phrase", "a", "c.*")
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(_score("a", "l", "r")).alias("score"), "k", "l", "r")).alias("s"))
    inner = lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: part(i, k))
    covers = [candidates.where(f"size > {k}").select("lang", F.explode(inner(F.lit(k))).alias("phrase"), F.col("a").alias("longer")) for k in range(2, longest)]
    kept = scored
    if covers:
        inside = covers[0]
        for c in covers[1:]:
            inside = inside.union(c)
        kept = scored.join(inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"], "left").where("longer is null or cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * 80")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
