"""Repeated passages across documents by suffix arrays and their common-prefix intervals.

The suffixes of the corpus are dealt into independent suffix arrays by content: any 50
bytes contain a 20-byte gram of least hash, and all places of equal 50 bytes have the same
one. Neighbouring starts with the same least gram form a run. A first pass finds, from four
bytes of hash a run, which grams occur in two documents. A second pass sends the bytes of those
runs, equal ones of a flush once, to the bucket of their gram. There all runs form enhanced
suffix arrays (order, common prefixes, left bytes) whose common-prefix intervals a stack
scan reads off: an interval of at least 50 bytes is a string with all its places. Where
its left neighbours are diverse a group begins, a repeat with all its places, which
runs on as long as the places stay the same. A place loses its group's bytes if the group also starts in a
document with a smaller id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

GRAM = 20
_BLOCK = 1 << 18
_FLUSH_RUNS = 3_000_000
_FLUSH_BYTES = 64_000_000
_START, _BETWEEN = 0xFF, 0xFE  # bytes that UTF-8 never has
_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BYTES = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """The hash of each 20-byte gram, from those of 1, 2, 4, 8 and 16 bytes."""
    x = _BYTES[b]
    parts = {1: x}
    for k in (1, 2, 4, 8):
        x = x[:-k] * _A[k.bit_length() - 1] + x[k:]
        parts[2 * k] = x
    return _mix(x[: len(b) - GRAM + 1] * _A[4] + parts[4][16 : 16 + len(b) - GRAM + 1])


def _window_least(h: np.ndarray, width: int) -> np.ndarray:
    have, x = 1, h
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(h) - width + 1], x[width - have : len(h) - have + 1]) if have < width else x


def runs(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, end (past the last start) and least gram of each run of starts of ``length``-byte strings."""
    n = len(b) - length + 1
    lo, hi, gram = [], [], []
    for s in range(0, max(n, 0), _BLOCK):
        e = min(n, s + _BLOCK)
        m = _window_least(_gram_hashes(b[s : e + length - 1]), length - GRAM + 1)
        cut = np.flatnonzero(m[1:] != m[:-1]) + 1
        first = np.concatenate([[0], cut])
        lo.append(first + s)
        hi.append(np.append(cut, len(m)) + s)
        gram.append(m[first])
    if not lo:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(lo), np.concatenate(hi), _mix(np.concatenate(gram) * _A[0])


def _pack(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else a.tobytes())


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _planes(a: np.ndarray) -> np.ndarray:
    """Bytes of 32-bit numbers, all lowest bytes first: small numbers compress well so."""
    return a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy()


def _whole(planes: np.ndarray) -> np.ndarray:
    return planes.reshape(4, -1).T.copy().view(np.uint32).ravel()


def _array(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)


def _by_group(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of equal values of a sorted array."""
    if len(key):
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True)


# --- first pass: which runs have a gram that another document has ---
#
# A flush is what a task holds at a time. Documents have numbers in their flush; one row of each flush tells their ids
# and the hashes of their texts, by which rows that repeat an id are told apart.

_GRAMS = "bucket int, flush bigint, grams binary, known binary, docs binary, counts binary, steps binary, first bigint, sizes binary, data binary, ids binary, keys binary"
_OF_FLUSH = "flush bigint, docs binary, sizes binary, data binary, ids binary, keys binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(columns)], [n for n, _ in columns])


def _of_flush(flush: int, doc: np.ndarray, items: np.ndarray) -> tuple:
    """Items (rows of bytes) of a flush's documents as one row."""
    order = np.argsort(doc, kind="stable")
    doc, items = doc[order], items[order]
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    return (flush, _pack(doc[cuts].astype(np.int32)), _pack(np.diff(cuts, append=len(doc)).astype(np.int32)), _pack(items), None, None)


def _items(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers and items of all rows of a flush in the order of documents, and the flush's ids and keys."""
    doc, data, ids, keys = [np.empty(0, np.int32)], [np.empty((0, width), np.uint8)], np.empty(0, np.int64), np.empty(0, np.int64)
    for r in rows:
        if r["ids"] is not None:
            ids, keys = _unpack(r["ids"], np.int64), _unpack(r["keys"], np.int64)
        else:
            doc.append(np.repeat(_unpack(r["docs"], np.int32), _unpack(r["sizes"], np.int32)))
            data.append(_unpack(r["data"], np.uint8).reshape(-1, width))
    doc, data = np.concatenate(doc), np.concatenate(data)
    order = np.argsort(doc, kind="stable")
    return doc[order], data[order], ids, keys


def _by_doc(width: int):
    """Of a flush: one row for each document that has items, with all of them."""

    def run(table: pa.Table) -> pa.Table:
        doc, data, ids, keys = _items(table.to_pylist(), width)
        cuts = list(_by_group(doc))
        at = doc[[a for a, _ in cuts]] if cuts else doc
        return pa.table({"doc_id": pa.array(ids[at], pa.int64()), "key": pa.array(keys[at], pa.int32()), "items": pa.array([data[a:b].tobytes() for a, b in cuts], pa.binary())})

    return run


def _grams_of(length: int, bits: int):
    """Rows of three kinds: grams for a bucket, each distinct one of a flush once; what is found on the spot, runs
    of a gram that two documents of the flush have; and the flush's documents."""

    def flush(number: int, docs: list[int], keys: list[int], counts: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
        g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        n = np.array(counts, np.int64)
        ends = np.cumsum(n)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort(g, kind="stable")
        s = g[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
        last = np.append(first[1:], len(s)) - 1
        shared = doc[order[first]] != doc[order[last]] if len(s) else np.empty(0, bool)
        member = order[np.repeat(shared, last - first + 1)]
        at = np.sort(order[first])
        known = np.zeros(len(g), bool)
        known[order[first[shared]]] = True
        bucket = (g[at] >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        low = ((g[at] >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = []
        for a, b in _by_group(bucket):
            own = at[a:b]
            d = doc[own]
            cuts = np.flatnonzero(np.diff(d, prepend=-1))
            run = (own - (ends - n)[d]).astype(np.uint32)
            rows.append((int(bucket[a]), number, _pack(low[a:b]), _pack(np.packbits(known[own])), _pack(_planes(np.diff(d[cuts], prepend=0))), _pack(_planes(np.diff(cuts, append=b - a).astype(np.uint32))), _pack(_planes(np.diff(run, prepend=run[:1]))), int(run[0]), None, None, None, None))
        found = _of_flush(number, doc[member], (member - (ends - n)[doc[member]]).astype(np.uint32).view(np.uint8).reshape(-1, 4))
        home = number % (1 << bits)
        rows.append((home, number, None, None, found[1], None, None, None, found[2], found[3], None, None))
        rows.append((home, number, *[None] * 8, _pack(np.array(docs, np.int64)), _pack(np.array(keys, np.int64))))
        return _rows(_GRAMS, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys, counts, grams, held, number = [], [], [], [], 0, TaskContext.get().partitionId() << 20
        for batch in batches:
            for doc, key, text in zip(batch.column("doc_id"), batch.column("key"), batch.column("text"), strict=True):
                b = _array(text.as_py())
                if len(b) < length or not doc.is_valid:
                    continue
                g = runs(b, length)[2]
                docs.append(doc.as_py())
                keys.append(key.as_py())
                counts.append(len(g))
                grams.append(g)
                held += len(g)
                if held >= _FLUSH_RUNS:
                    yield flush(number, docs, keys, counts, grams)
                    docs, keys, counts, grams, held, number = [], [], [], [], 0, number + 1
        if docs:
            yield flush(number, docs, keys, counts, grams)

    return run


def _met(table: pa.Table) -> pa.Table:
    """Of one bucket: runs whose gram came from two flushes or more and that are not known to be shared yet, by
    flush; and, as they are, the rows of other kinds."""
    is_other = table.column("grams").is_null()
    other = table.filter(is_other).select([x.split()[0] for x in _OF_FLUSH.split(", ")])
    rows = table.filter(pc.invert(is_other)).select(["flush", "grams", "known", "docs", "counts", "steps", "first"]).to_pylist()
    if not rows:
        return other
    low, flush, doc, run, known = [], [], [], [], []
    for r in rows:
        g = _unpack(r["grams"], np.uint32)
        low.append(g)
        flush.append(np.full(len(g), r["flush"]))
        doc.append(np.repeat(np.cumsum(_whole(_unpack(r["docs"], np.uint8)), dtype=np.int64), _whole(_unpack(r["counts"], np.uint8))))
        run.append((np.cumsum(_whole(_unpack(r["steps"], np.uint8)), dtype=np.uint32) + np.uint32(r["first"])).astype(np.int64))
        known.append(np.unpackbits(_unpack(r["known"], np.uint8), count=len(g)).astype(bool))
    low, flush, doc, run, known = (np.concatenate(x) for x in (low, flush, doc, run, known))
    order = np.argsort(low, kind="stable")
    s = low[order]
    same = s[1:] == s[:-1]
    met = np.append(same, False) | np.append(False, same)
    pick = order[met]
    pick = pick[~known[pick]]
    pick = pick[np.argsort(flush[pick], kind="stable")]
    items = run[pick].astype(np.uint32).view(np.uint8).reshape(-1, 4)
    found = [_of_flush(int(flush[pick[a]]), doc[pick[a:b]], items[a:b]) for a, b in _by_group(flush[pick])]
    return pa.concat_tables([other, pa.Table.from_batches([_rows(_OF_FLUSH, found)])])


# --- second pass: bytes of those runs, to buckets ---

_SENT = "bucket int, grams binary, sizes binary, data binary, counts binary, docs binary, keys binary, starts binary"
_OF_PART = "part int, docs binary, keys binary, sizes binary, data binary"


def _send(length: int, bits: int):
    """Distinct runs of the documents at hand, each with the places where it stands, by bucket.

    A run's bytes begin with the byte before it (0xFF at the start of a text)."""

    def flush(seen: dict[bytes, int], grams: list[int], places: list[list[tuple[int, int]]], ids: list[int], keys: list[int]) -> pa.RecordBatch:
        g, id_of, key_of = np.array(grams, np.uint64), np.array(ids, np.int64), np.array(keys, np.int64).astype(np.int32)
        bucket = (g >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        segments, rows = list(seen), []
        for a, b in _by_group(bucket[order]):
            own = order[a:b]
            where = np.array([p for i in own for p in places[i]], np.int64).reshape(-1, 2)
            rows.append(
                (
                    int(bucket[own[0]]), _pack((g[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), _pack(_planes(np.array([len(segments[i]) for i in own]))), _pack(b"".join(segments[i] for i in own)),
                    _pack(_planes(np.array([len(places[i]) for i in own]))), _pack(id_of[where[:, 0]]), _pack(key_of[where[:, 0]]), _pack(where[:, 1].copy()),
                )
            )
        return _rows(_SENT, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grams, places, ids, keys, held = {}, [], [], [], [], 0
        for batch in batches:
            for doc, key, text, found in zip(*(batch.column(c) for c in ("doc_id", "key", "text", "found")), strict=True):
                if not found.is_valid or not text.is_valid:
                    continue
                raw = text.as_py().encode("utf-8", "surrogatepass")
                lo, hi, g = runs(np.frombuffer(raw, np.uint8), length)
                ours = np.unique(np.frombuffer(found.as_py(), np.uint32))
                # The first pass names one run of each gram in a document; a repeat may stand at any of them.
                ours = np.flatnonzero(np.isin(g, g[ours[ours < len(lo)]]))
                n = len(ids)
                ids.append(doc.as_py())
                keys.append(key.as_py())
                for a, b, gram in zip(lo[ours].tolist(), hi[ours].tolist(), g[ours].tolist(), strict=True):
                    segment = raw[a - 1 : b + length - 1] if a else b"\xff" + raw[: b + length - 1]
                    i = seen.setdefault(segment, len(grams))
                    if i == len(grams):
                        grams.append(gram)
                        places.append([])
                        held += len(segment) + 350
                    places[i].append((n, a))
                    held += 120
                if held >= _FLUSH_BYTES:
                    yield flush(seen, grams, places, ids, keys)
                    seen, grams, places, ids, keys, held = {}, [], [], [], [], 0
        if grams:
            yield flush(seen, grams, places, ids, keys)

    return run


# --- in a bucket: enhanced suffix array and its intervals ---


def enhanced_suffix_array(data: np.ndarray, starts: np.ndarray, room: np.ndarray, depth: int = 56) -> tuple[np.ndarray, np.ndarray]:
    """The ``starts`` in the order of their suffixes and the common prefix of each with the one before.

    Suffixes are sorted as big-endian words, to ``depth`` bytes (a multiple of 8) or to the ``room`` that a start has.
    """
    words = np.append(data, np.zeros(depth + 8, np.uint8)).astype(np.uint64)
    for k in (1, 2, 4):
        words = (words[:-k] << np.uint64(8 * k)) | words[k:]
    keys = []
    for k in range(0, depth, 8):
        w = words[starts + k]
        if len(room) and int(room.min()) < k + 8:
            beyond = np.uint64(8) * (8 - np.clip(room - k, 0, 8)).astype(np.uint64)
            w = np.where(beyond >= 64, np.uint64(0), (w >> np.minimum(beyond, np.uint64(63))) << np.minimum(beyond, np.uint64(63)))
        keys.append(w)
    order = np.lexsort(keys[::-1])
    common, going = np.zeros(max(len(order) - 1, 0), np.int64), np.ones(max(len(order) - 1, 0), bool)
    for w in keys:
        differ = w[order][1:] ^ w[order][:-1]
        high, low = differ >> np.uint64(32), differ & np.uint64(0xFFFFFFFF)
        zeros = np.where(high > 0, 32 - np.frexp(high.astype(np.float64))[1], 64 - np.frexp(low.astype(np.float64))[1])
        same = zeros >> 3
        common += np.where(going, same, 0)
        going &= differ == 0
    return order, np.append(0, np.minimum(common, np.minimum(room[order][:-1], room[order][1:])))


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int, bool]]:
    """(depth, first, last, outermost) of each common-prefix interval of depth ``least`` or more, by a stack scan."""
    out, stack = [], []  # of (depth, first)
    previous = -2
    for i in np.flatnonzero(np.append(common, 0) >= least).tolist() + [len(common)]:
        if i != previous + 1 or i == len(common):
            while stack:
                depth, first = stack.pop()
                out.append((depth, first, previous, not stack))
        if i == len(common):
            break
        depth, first = int(common[i]), i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i - 1, False))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
        previous = i
    return out


_CHUNK = 400_000


class Bucket:
    """The runs of one bucket and the enhanced suffix arrays of all their starts, a few grams at a time.

    An interval of ``length`` bytes or more is a string and all its places: those of each run that has it. A run that
    stands at several places is such a string by itself at each of its starts. Along a run, a start opens a new group
    if its string has diverse left neighbours or another number of places than the start before; the starts
    after it that do not are the same places one byte further, so a group is a repeat with all its places.
    """

    def __init__(self, table: pa.Table, length: int, named: bool):
        self.length, self.named = length, named
        index: dict[bytes, int] = {}
        gram, run, doc, key, start = [], [], [], [], []
        for r in table.to_pylist():
            data = zstandard.ZstdDecompressor().decompress(r["data"])
            at, own = 0, []
            for size, g in zip(_whole(_unpack(r["sizes"], np.uint8)).tolist(), _unpack(r["grams"], np.uint32).tolist(), strict=True):
                i = index.setdefault(data[at : at + size], len(gram))
                if i == len(gram):
                    gram.append(g)
                own.append(i)
                at += size
            run.append(np.repeat(np.array(own, np.int64), _whole(_unpack(r["counts"], np.uint8))))
            doc.append(_unpack(r["docs"], np.int64))
            key.append(_unpack(r["keys"], np.int32))
            start.append(_unpack(r["starts"], np.int64))
        self.run, self.doc, self.key, self.start = (np.concatenate(x) for x in (run, doc, key, start))
        n = len(gram)
        self.segments = list(index)
        windows = np.array([len(s) for s in self.segments], np.int64) - length
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, self.run, self.doc)
        np.maximum.at(high, self.run, self.doc)
        count = np.bincount(self.run, minlength=n)
        self.at = np.cumsum(windows) - windows
        self.of = np.repeat(np.arange(n), windows)
        self.low, self.high, self.count = low[self.of], high[self.of], count[self.of]
        self.diverse = np.zeros(len(self.of), bool)
        ordered = np.argsort(np.array(gram, np.uint64), kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(np.array(gram, np.uint64)[ordered]) != 0)) if n else np.empty(0, np.int64)
        upto, a = np.cumsum(windows[ordered]), 0
        while a < n:  # whole grams, as equal strings have one gram
            over = np.searchsorted(upto, (upto[a - 1] if a else 0) + _CHUNK, "right")
            k = np.searchsorted(begins, max(over, a + 1), "left")
            b = int(begins[k]) if k < len(begins) else n
            self._scan(ordered[a:b], windows)
            a = b
        head = np.zeros(len(self.of), bool)
        head[self.at] = True
        same = np.append(False, self.count[1:] == self.count[:-1])
        self.first = np.flatnonzero(head | self.diverse | ~same)
        self.long = np.diff(self.first, append=len(self.of))

    def _scan(self, picked: np.ndarray, windows: np.ndarray) -> None:
        """The interval tree of the starts of some runs: what its outermost intervals say of their starts."""
        data = np.frombuffer(bytes([_BETWEEN]).join(self.segments[i] for i in picked), np.uint8)
        w = windows[picked]
        sizes = w + self.length
        base = np.cumsum(sizes + 1) - sizes - 1
        inside = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        starts = np.repeat(base, w) + 1 + inside
        slot = np.repeat(self.at[picked], w) + inside
        order, common = enhanced_suffix_array(data, starts, np.repeat(base + sizes, w) - starts, -(-self.length // 8) * 8)
        slot, left = slot[order], data[starts[order] - 1]
        self.diverse[slot] = left == _START
        outer = np.array(sorted((a, b) for _, a, b, outermost in intervals(common, self.length) if outermost), np.int64).reshape(-1, 2)
        if not len(outer):
            return
        n = outer[:, 1] - outer[:, 0] + 1
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first - outer[:, 0], n)
        mine, left = slot[at], left[at]
        self.low[mine] = np.repeat(np.minimum.reduceat(self.low[mine], first), n)
        self.high[mine] = np.repeat(np.maximum.reduceat(self.high[mine], first), n)
        self.count[mine] = np.repeat(np.add.reduceat(self.count[mine], first), n)
        least, most = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
        self.diverse[mine] = np.repeat((least != most) | (most == _START), n)

    def places(self, bits: int) -> pa.Table:
        """Places of the groups of two documents or more, by part of the documents: the bytes that they cover in documents which
        are not the group's first, or, if ``named``, all places with the group's number of places, whether it goes on from the
        run before, and its name."""
        keep = self.low[self.first] < self.high[self.first]
        first, long = self.first[keep], self.long[keep]
        own = self.of[first]
        offset = first - self.at[own]
        upto = np.searchsorted(own, np.arange(len(self.segments) + 1))
        each = upto[self.run + 1] - upto[self.run]  # groups of each place
        place = np.repeat(np.arange(len(each)), each)
        group = np.repeat(upto[self.run] - np.cumsum(each) + each, each) + np.arange(len(place))
        if not self.named:
            hit = self.low[first[group]] < self.doc[place]
            place, group = place[hit], group[hit]
        a = self.start[place] + offset[group]
        b = a + long[group]
        item = np.column_stack([a, b + (0 if self.named else self.length - 1)]).astype(np.int64).view(np.uint8).reshape(-1, 16)
        if self.named:
            names = np.zeros((len(first), 16), np.uint8)
            for i, (r, o) in enumerate(zip(own.tolist(), offset.tolist(), strict=True)):
                names[i] = np.frombuffer(hashlib.sha256(self.segments[r][o + 1 : o + 1 + self.length]).digest()[:16], np.uint8)
            joins = (offset == 0) & ~self.diverse[first]
            more = np.column_stack([self.count[first][group], joins[group].astype(np.int64)]).astype(np.int64).view(np.uint8).reshape(-1, 16)
            item = np.column_stack([item, more, names[group]])
        doc, key = self.doc[place], self.key[place]
        part = (_mix(doc.astype(np.uint64) * _A[1]) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((key, doc, part))
        doc, key, part, item = doc[order], key[order], part[order], item[order]
        rows = []
        for x, y in _by_group(part):
            cuts = np.flatnonzero(np.append(True, (doc[x + 1 : y] != doc[x : y - 1]) | (key[x + 1 : y] != key[x : y - 1])))
            rows.append((int(part[x]), _pack(doc[x:y][cuts]), _pack(key[x:y][cuts]), _pack(np.diff(cuts, append=y - x).astype(np.int32)), _pack(item[x:y])))
        return pa.Table.from_batches([_rows(_OF_PART, rows)])


def _of_part(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, key, data = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty((0, width), np.uint8)]
    for r in table.to_pylist():
        n = _unpack(r["sizes"], np.int32)
        doc.append(np.repeat(_unpack(r["docs"], np.int64), n))
        key.append(np.repeat(_unpack(r["keys"], np.int32), n))
        data.append(_unpack(r["data"], np.uint8).reshape(-1, width))
    return np.concatenate(doc), np.concatenate(key), np.concatenate(data)


def _spans(table: pa.Table) -> pa.Table:
    """Of a part of the documents: one row for each, with its spans; those that touch or overlap are one."""
    doc, key, data = _of_part(table, 16)
    span = np.ascontiguousarray(data).view(np.int64)
    order = np.lexsort((span[:, 0], key, doc))
    doc, key, a, b = doc[order], key[order], span[order, 0], span[order, 1]
    opens = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) if len(doc) else np.empty(0, bool)
    shift = (np.cumsum(opens) - 1) << 40  # keeps the ends of a document below all of the next
    reach = np.maximum.accumulate(b + shift) if len(b) else b
    first = np.flatnonzero(np.append(True, (a + shift)[1:] > reach[:-1])) if len(a) else np.empty(0, np.int64)
    merged = np.column_stack([a[first], np.append(reach[first[1:] - 1], reach[-1:]) - shift[first]]) if len(a) else np.empty((0, 2), np.int64)
    begins = np.flatnonzero(opens[first]) if len(first) else first
    own = first[begins]
    return pa.table({"doc_id": pa.array(doc[own], pa.int64()), "key": pa.array(key[own], pa.int32()), "_spans": pa.array([merged[x:y].astype(np.int64).tobytes() for x, y in zip(begins, [*begins[1:], len(merged)], strict=True)], pa.binary())})


def _chained(length: int):
    """Of a part of the documents: groups that follow one another in a document at the same places are one repeat."""

    def run(table: pa.Table) -> pa.Table:
        doc, key, data = _of_part(table, 48)
        number = np.ascontiguousarray(data[:, :32]).view(np.int64)
        order = np.lexsort((number[:, 0], key, doc))
        doc, key, names, number = doc[order], key[order], data[order, 32:], number[order]
        a, b, count, joins = (number[:, i] for i in range(4))
        on = np.append(False, (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (a[1:] == b[:-1]) & (count[1:] == count[:-1]) & (joins[1:] == 1)) if len(doc) else np.empty(0, bool)
        first = np.flatnonzero(~on)
        last = np.append(first[1:], len(doc)) - 1 if len(first) else first
        return pa.table({"repeat": pa.array([names[i].tobytes().hex() for i in first], pa.string()), "length": pa.array(b[last] - a[first] + length - 1, pa.int64()), "doc_id": pa.array(doc[first], pa.int64()), "start": pa.array(a[first], pa.int64())})

    return run


def _bits(docs: DataFrame, text_mb: int = 6) -> int:
    """Enough bucket bits that a bucket holds the grams of about ``text_mb`` MB of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(3, min(31, math.ceil(math.log2(max(1, total / (text_mb * 1e6))))))


def _located(docs: DataFrame, length: int, bits: int, named: bool) -> DataFrame:
    """Rows of ``_OF_PART``: the places that repeats have in the documents.

    The join is an outer one over all columns of ``docs``: so it deals the texts just as that of ``cut_repeats`` does, and
    one exchange serves both. ``_send`` skips documents in which nothing was found."""
    met = docs.select("doc_id", "key", "text").mapInArrow(_grams_of(length, bits), _GRAMS).groupBy("bucket").applyInArrow(_met, _OF_FLUSH)
    found = met.groupBy("flush").applyInArrow(_by_doc(4), "doc_id bigint, key int, items binary")
    # Rows that repeat both id and text have the same runs, so any of theirs will do.
    one = found.groupBy("doc_id", "key").agg(F.max("items").alias("found"))
    sent = docs.join(one, ["doc_id", "key"], "left").mapInArrow(_send(length, bits), _SENT)
    return sent.groupBy("bucket").applyInArrow(lambda t: Bucket(t, length, named).places(bits), _OF_PART)


def _prepared(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    key = F.shiftright(F.shiftleft(F.xxhash64(text), 32), 32).cast("int")  # the low half tells rows of one id apart
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), text.alias("text"), *keep)


def maximal_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(repeat, length, doc_id, start): every place of each repeat of at least ``length`` bytes in two documents or more.

    A repeat is as long as all its ``length``-byte strings have the same places: it cannot grow to either side without losing
    a place or meeting others. A passage inside it that stands elsewhere too is a repeat of its own between its
    two other parts, which reach ``length`` - 1 bytes into it. ``repeat`` names its first ``length`` bytes. Null, empty and
    short texts and rows without an id have none.
    """
    base = _prepared(docs)
    return _located(base, length, _bits(base), True).groupBy("part").applyInArrow(_chained(length), "repeat string, length bigint, doc_id bigint, start bigint")


def cut_repeats(docs: DataFrame, length: int = 50, keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``keep_text`` the rest as kept_text, and the columns ``keep``.

    Removed is each byte that lies in a string of ``length`` bytes which also starts in a document of smaller
    id, judged on the input. Null text is empty; empty and short texts lose nothing. Rows without an id are
    kept whole and are not compared. Rows that repeat an id do not shorten each other, and each loses its own
    passages. kept_text drops a character of which only part is left. Other columns are ignored.
    """
    base = _prepared(docs, keep)
    covered = _located(base, length, _bits(base), False).groupBy("part").applyInArrow(_spans, "doc_id bigint, key int, _spans binary")
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]
    kinds = dict(base.dtypes)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text string" if keep_text else "") + "".join(f", `{c}` {kinds[c]}" for c in keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part, out = batch.slice(k, 2000), []
                for text, spans in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist(), strict=True):
                    b = (text or "").encode("utf-8", "surrogatepass")
                    kept, removed, n = b, 0, 0
                    if spans:
                        edge = np.zeros(len(b) + 1, np.int32)
                        pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, pairs[:, 1], -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed, n = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
                    out.append((len(b), removed, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text and text is not None else None))
                columns = [part.column("doc_id"), *(pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(len(own))), *(part.column(c) for c in keep)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *own, *keep])

    return base.join(covered, ["doc_id", "key"], "left").select("doc_id", "text", "_spans", *keep).mapInArrow(cut, schema)
