"""Packing of token sequences by the configuration linear program.

Lengths are at most the capacity, so the input of the program is a histogram of bounded
size whatever the number of documents. A configuration is a multiset of lengths that fits
one sequence. Multiplicative weights solve the covering program approximately: lengths
covered less than their share get higher prices, a knapsack dynamic program over the
capacity prices the best completion for each length that lags, and the configurations get
mass; the prices bound what any solution needs. Masses are rounded down to whole uses; where they are below one, the largest are used once as far as lengths are
left. What is left then is a smaller histogram, whose program is solved again, until no
sequence can be filled; the few last lengths are packed by best fit with a small share of the plan. Best fit
decreasing alone is the measure: if it ever needs fewer sequences, its plan is taken. Spark then gives each piece its
place by its rank among pieces of its length.
"""

from __future__ import annotations

import math
import string
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, ship, stage

_CACHE_CHUNKS = 400_000


class ChunkTokenizer(dict):
    """Token ids of whole texts, with the ids of chunks between blanks kept for reuse up to a bound.

    The tokenizer splits at white space before anything else, so a text's ids are its
    chunks' ids in a row. Only ASCII blanks split here; others stay inside a chunk. A word of Latin-1 letters is one
    pre-token and, but for case, its own normal form, so the model alone encodes it; marks after it are the next one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Byte-level vocabularies write bytes that are not printable as characters from 256 on.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.printed = {b: 256 + i for i, b in enumerate(odd)}

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(string.punctuation)
        if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
            ids = self.get(core) or self.word(core)
            if len(core) < len(chunk):
                ids += self[chunk[len(core) :]]
        else:
            ids = _bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= 64:
            if len(self) > _CACHE_CHUNKS:
                self.clear()
                self[""] = b""
            self[chunk] = ids
        return ids

    def word(self, core: str) -> bytes:
        low = core.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.printed)
        return _bytes([t.id for t in self.model.tokenize(low)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): pieces, ranked among their length in a partition."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        seen = [0] * (capacity + 1)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), t.encode([x or "" for x in part.column("text").to_pylist()]), strict=True):
                    ids += end
                    for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, piece, a // 4, n, zlib.crc32(own), seen[n]))
                        seen[n] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    pieces = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
    return pieces.withColumn("part", F.spark_partition_id())


class Knapsack:
    """Best values within each capacity, with at most as many copies of a length as there are."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.size, self.of = [], []
        for i, (s, n) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
            left, k = min(n, capacity // s), 1
            while left > 0:  # copies in powers of two and a rest
                k = min(k, left)
                self.size.append(s * k)
                self.of.append((i, k))
                left, k = left - k, 2 * k
        self.capacity = capacity

    def solve(self, price: np.ndarray) -> np.ndarray:
        """The best value within each capacity at these prices of lengths; the choices are kept for ``filled``."""
        best = np.zeros(self.capacity + 1)
        self.last = np.full((len(self.size) + 1, self.capacity + 1), -1, np.int16)
        for j, (w, (i, k)) in enumerate(zip(self.size, self.of, strict=True)):
            with_ = best[: self.capacity + 1 - w] + k * price[i]
            take = with_ > best[w:] + 1e-12
            row = self.last[j + 1]
            row[:] = self.last[j]
            row[w:][take] = j
            best[w:] = np.where(take, with_, best[w:])
        return best

    def filled(self, room: int) -> dict[int, int]:
        """How many copies of each length (by its number) the best filling of ``room`` has."""
        out: dict[int, int] = {}
        j = int(self.last[-1, room])
        while j >= 0:
            i, k = self.of[j]
            out[i] = out.get(i, 0) + k
            room -= self.size[j]
            j = int(self.last[j, room])
        return out


def configuration_masses(histogram: dict[int, int], capacity: int, rounds: int = 24, eta: float = 4.0) -> tuple[dict[tuple, float], float]:
    """Masses of configurations that together cover each length its count of times at least, and a lower bound of such a sum.

    In round r of ``rounds`` each length is brought to the share r / rounds of its count. Prices are a length's
    share of the capacity times exp(eta * (target - covered share)); those of a round, over the best value of a sequence,
    bound the sum from below. Lengths that lag in one round fill up with the same dear ones, so short lengths are covered
    more than once; whole uses take them only as far as there are any, and what is left is priced again.
    """
    lengths = np.array(sorted(histogram, reverse=True))
    need = np.array([histogram[s] for s in lengths], float)
    covered, bound = np.zeros(len(lengths)), 0.0
    knapsack = Knapsack(lengths, need.astype(np.int64), capacity)
    masses: dict[tuple, float] = {}
    for r in range(1, rounds + 1):
        target = r / rounds
        price = lengths / capacity * np.exp(eta * (target - covered / need))
        bound = max(bound, float(need @ price) / float(knapsack.solve(price)[capacity]))
        for i, s in enumerate(lengths.tolist()):
            lag = target * need[i] - covered[i]
            if lag <= 1e-9:
                continue
            fill = knapsack.filled(capacity - s)
            fill[i] = fill.get(i, 0) + 1
            c = tuple(sorted(((int(lengths[j]), k) for j, k in fill.items()), reverse=True))
            t = lag / fill[i]
            for j, k in fill.items():
                covered[j] += t * k
            masses[c] = masses.get(c, 0) + t
    return masses, bound


Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def program_plan(histogram: dict[int, int], capacity: int, passes: int = 40) -> tuple[Plan, dict[int, int]]:
    """Configurations of the program, each with how often it is used, and what of the histogram is left."""
    left = {int(s): int(n) for s, n in histogram.items() if n}
    plan: dict[tuple, int] = {}

    def use(c: tuple, most: int) -> int:
        m = min(most, *(left.get(s, 0) // n for s, n in c))
        if m > 0:
            plan[c] = plan.get(c, 0) + m
            for s, n in c:
                left[s] -= n * m
                if not left[s]:
                    del left[s]
        return m

    fills = lambda c: sum(s * n for s, n in c) == capacity
    for k in range(passes):
        if not left or sum(s * n for s, n in left.items()) <= capacity:
            break
        masses, _ = configuration_masses(left, capacity, 24 if k == 0 or len(left) < 500 else 8)
        # Only full sequences are used: lengths of others are priced again with what is left, or go where they fit best.
        ranked = sorted((x for x in masses.items() if fills(x[0])), key=lambda x: (-x[1], x[0]))
        used = sum(use(c, int(x)) for c, x in ranked if x >= 1)
        if not used:
            # Half of the fractional mass at most, so that the next prices see what lags.
            budget = max(1, int(0.5 * sum(masses.values())))
            for c, _ in ranked:
                used += use(c, 1)
                if used >= budget:
                    break
        if not used:
            break
    return list(plan.items()), left


def pack_histogram(histogram: dict[int, int], capacity: int) -> Plan:
    """Configurations, each with how often it is used, that use up the histogram exactly."""
    plan, left = program_plan(histogram, capacity)
    ours = mended(plan, left, capacity)
    plain = best_fit({int(s): int(n) for s, n in histogram.items() if n}, capacity)
    return min(ours, plain, key=lambda p: sum(m for _, m in p))


def mended(plan: Plan, left: dict[int, int], capacity: int, share: float = 0.05) -> Plan:
    """The plan with what is left: large lengths alone would waste their room, so they are packed by best fit together with
    the lengths of those of the plan's sequences that have the most pieces, a small share of it."""
    pool, kept, taken = dict(left), [], 0
    budget = math.ceil(share * sum(m for _, m in plan)) if left else 0
    for c, m in sorted(plan, key=lambda x: (-sum(n for _, n in x[0]), x)):
        k = min(m, budget - taken)
        for s, n in c if k else ():
            pool[s] = pool.get(s, 0) + n * k
        taken += k
        if m > k:
            kept.append((c, m - k))
    return kept + best_fit(pool, capacity)


def best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing by counts: open sequences with the same room and content move as one class."""
    rooms: list[int] = []  # sorted rooms that have open sequences
    open_: dict[int, list[tuple[tuple, int]]] = {}

    def add(room: int, c: tuple, m: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((c, m))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                if n >= each:
                    add(capacity - each * s, ((s, each),), n // each)
                if n % each:
                    add(capacity - n % each * s, ((s, n % each),), 1)
                break
            room = rooms[i]
            c, m = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            # As many copies as fit go to each sequence of the class before the next class is looked at.
            each = min(room // s, n)
            used = min(m, n // each)
            if used < m:
                add(room, c, m - used)
            add(room - each * s, (*c, (s, each)), used)
            n -= each * used
    return [x for room in open_.values() for x in room]


def _places(plan: list[tuple[tuple, int]]) -> tuple[np.ndarray, ...]:
    """Segments of ranks by length: key, times used, first sequence, offset of the first copy."""
    rows, used, sequence = [], {}, 0
    for c, m in plan:
        offset = 0
        for s, n in c:
            start = used.get(s, 0)
            rows.append(((s << 44) + start, m, sequence, offset))
            used[s] = start + n * m
            offset += s * n
        sequence += m
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(a.T)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then ``end_id``; only one longer than ``capacity`` is cut, into pieces
    of that length and a rest. Null and empty texts are one piece of length 1. Repeated rows and null ids are
    packed like others. No rows give no rows. Other columns are ignored. Special tokens in a text are what the tokenizer as
    loaded makes of them. The plan has at most a configuration for each priced length, round and pass, so its size is
    bounded by the capacity.
    """
    ship(docs.sparkSession)
    pieces = stage(token_pieces(docs, vocabulary, capacity, end_id))
    counts = pieces.groupBy("length", "part").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(pack_histogram(histogram, capacity))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, first, offset = places
        for batch in batches:
            length, k = (batch.column(c).to_numpy() for c in ("length", "k"))
            at = np.searchsorted(keys, (length << 44) + k, "right") - 1
            i = k - (keys[at] & ((1 << 44) - 1)) if len(k) else k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(first[at] + i % times[at], pa.int64()), pa.array(offset[at] + i // times[at] * length, pa.int64())], names)

    ranked = pieces.join(bases.select("length", "part", "base"), ["length", "part"]).withColumn("k", F.col("base") + F.col("rank"))
    return ranked.select(*names[:5], "k").mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
