"""Near-duplicate documents by HyperMinHash registers, banding and full verification.

A document's word shingles are hashed to 64 bits. Each of 128 buckets keeps its smallest
hash as a count of leading zeros and ten mantissa bits, 256 bytes a document; empty
buckets borrow from others in a fixed order. Bands of four registers name candidates:
a pair at the threshold of 0.8 shares none of 32 bands with probability 5e-8. Members of
a band are compared with its first member, and then, wherever a band still joins several
components, across components; pairs inside one component need no test. A
collision-corrected estimate drops hopeless pairs, and every link is confirmed on the
full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, spread_join, stage
from .graph import components

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
ROWS_PER_BAND = 4
#: The expected share of equal registers of unrelated sets is this over 2**MANTISSA.
CHANCE = 0.1699
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: Registers of the estimate, of eight bits each: 0 for an empty bucket.
FINE_BITS = 8
FINE = 1 << FINE_BITS
#: Shingles of either side that a block comparison holds on average.
BLOCK = 600_000
_CACHE_WORDS = 300_000


class _WordHashes(dict):
    """64-bit hashes of words, kept for the next use up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE_WORDS and len(word) <= 64:
            self[word] = h
        return h


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, k: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; of fewer words, of all of them as one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    if n < k:
        h = (w * _MULTIPLIERS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n * 0x589965CC75374CC3 & 0xFFFFFFFFFFFFFFFF)
    else:
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h += w[i : n - k + 1 + i] * _MULTIPLIERS[i]
    return np.unique(_mix(h))


def _borrow_order(tries: int = 2048) -> np.ndarray:
    """For each try, the bucket that each bucket looks at: fixed for all documents."""
    i = np.arange(tries * BUCKETS, dtype=np.uint64) + np.uint64(1)
    return (_mix(i * _MULTIPLIERS[0]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64).reshape(tries, BUCKETS)


_BORROW = _borrow_order()


def _minima(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of 2**bits buckets, whether it has a hash, and its minimum as leading zeros and mantissa."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    at = np.searchsorted(hashes, edges)
    full = np.diff(np.append(at, len(hashes))) > 0
    rest = hashes[np.minimum(at, len(hashes) - 1)] << np.uint64(bits)
    zeros = np.where(rest == 0, 62, 64 - np.frexp(rest.astype(np.float64))[1]).clip(0, 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return full, ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 compressed registers of a non-empty sorted set; empty buckets borrow from full ones."""
    full, out = _minima(hashes, BUCKET_BITS)
    if full.all():
        return out
    empty = np.flatnonzero(~full)
    tries = min(len(_BORROW), 16 * BUCKETS // int(full.sum()) + 16)
    seen = full[_BORROW[:tries, empty]]
    source = np.where(seen.any(axis=0), _BORROW[seen.argmax(axis=0), empty], np.flatnonzero(full)[0])
    out[empty] = out[source]
    return out


def fine_registers(hashes: np.ndarray) -> np.ndarray:
    """256 registers for the estimate: the compressed minimum folded to 1..255, or 0 if the bucket is empty."""
    full, out = _minima(hashes, FINE_BITS)
    return np.where(full, 1 + ((out.astype(np.uint32) * np.uint32(40503)) >> np.uint32(4)) % np.uint32(255), 0).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of fine registers, less what unrelated minima would share, and the buckets that they rest on."""
    used = ((a | b) > 0).sum(axis=-1).clip(1)
    both = ((a > 0) & (b > 0)).sum(axis=-1)
    equal = ((a == b) & (a > 0)).sum(axis=-1)
    e = CHANCE / (1 << MANTISSA) + 1 / 255
    return ((equal - e * both) / (1 - e) / used), used


def hopeful(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair may reach the threshold: sizes allow it, and the estimate lies at most six deviations below.

    The buckets sample the union without replacement, so the deviation falls to 0 as they come to hold it whole.
    """
    share, used = estimate(a, b)
    t = percent / 100
    union = (n_a + n_b) / (1 + t)
    deviation = np.sqrt(t * (1 - t) * np.maximum(0, 1 / used - 1 / np.maximum(union, used)))
    return (share >= t - 0.015 - 6 * deviation) & (n_a * percent <= n_b * 100) & (n_b * percent <= n_a * 100)


def sketch(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, n, set_hash, sig, fine): size of the shingle set, its hash and registers; null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, fine = [], [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), k)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(registers(s).tobytes() if len(s) else None)
                fine.append(fine_registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, sigs, fine))], ["doc_id", "n", "set_hash", "sig", "fine"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n bigint, set_hash binary, sig binary, fine binary")


def band_keys(sigs: DataFrame) -> DataFrame:
    """(key, doc_id): one row for each document and band."""
    width = 2 * ROWS_PER_BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // ROWS_PER_BAND - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    return sigs.select("doc_id", F.explode(keys).alias("key"))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have 100 * intersection >= percent * union."""
    wanted = pairs.groupBy(F.col("b").alias("doc_id")).agg(F.collect_list("a").alias("partners"))
    firsts = pairs.select(F.col("a").alias("doc_id")).distinct().withColumn("first", F.lit(True))
    need = wanted.join(firsts, "doc_id", "full")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s = [], [], []
            for doc, text, partners, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "partners", "first")), strict=True):
                blob = shingle_set(text, k).tobytes()
                for p in ([doc] if first else []) + (partners or []):
                    a.append(p)
                    b.append(doc)
                    s.append(blob)
                    if len(s) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.binary())], ["a", "b", "s"])
                        a, b, s = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.binary())], ["a", "b", "s"])

    # Ids have no bound: texts are never joined by a copy of all of them, whatever the size.
    blobs = texts.join(need.hint("merge"), "doc_id").select("doc_id", "text", "partners", "first").mapInArrow(sets, "a bigint, b bigint, s binary")
    # Each set goes once to each first member that it is compared with; that one's own set has a = b.
    blobs = stage(blobs)
    fan = pairs.groupBy("a").agg(F.count("*").alias("w"))
    # The sets of at most a few hundred centres that very many documents are compared with go everywhere.
    met = spread_join(blobs.where("a <> b"), blobs.where("a = b").select("a", F.col("s").alias("t")).join(fan, "a"), "a", "w", parts=200)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("s"), batch.column("t"), strict=True):
                x, y = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stage(met.select("a", "b", "s", "t").mapInArrow(compare, "a bigint, b bigint"))
    release(blobs)
    return out


def _worth_testing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that may reach the threshold."""
    side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"f_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in ("f_a", "f_b"))
                keep = hopeful(x, y, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    centres = side("a").join(pairs.groupBy("a").agg(F.count("*").alias("w")), "a")
    return spread_join(pairs, centres, "a", "w").join(side("b"), "b").select("a", "b", "n_a", "n_b", "f_a", "f_b").mapInArrow(run, "a bigint, b bigint")


_CELL = "a bigint, i int, j int, b bigint, c bigint, as_x boolean, as_y boolean, s binary"


def _across(met: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Links (a, b) between different components among the documents that share a centre, by full sets.

    Of each centre, the documents outside its component are compared with all, by the estimate first. Both sides are dealt into blocks of
    about ``BLOCK`` shingles; a task holds two blocks, and gives one link for each document and component that it meets.
    """
    named = labels.select(F.col("node"), "component")
    member = met.union(met.select("a", F.col("a").alias("b")).distinct())
    own = member.join(named, F.col("b") == F.col("node"), "left").select("a", "b", F.coalesce("component", "b").alias("c")).join(classes.select(F.col("doc_id").alias("b"), "n"), "b")
    centres = stage(member.groupBy("a").agg(F.count("*").alias("w")).join(named, F.col("a") == F.col("node"), "left").select("a", F.coalesce("component", "a").alias("c_a"), "w"))
    own = stage(spread_join(own, centres, "a", "w").select("a", "b", "c", "n", (F.col("c") != F.col("c_a")).alias("is_x")))
    groups = own.groupBy("a").agg(F.count("*").alias("g"), F.sum("n").alias("y"), F.sum(F.when(F.col("is_x"), F.col("n"))).alias("x")).where("g > 2 and x > 0")
    groups = stage(groups.select("a", "g", *(F.ceil(F.col(v) / BLOCK).cast("int").alias(f"n{v}") for v in "xy")))
    block = lambda n, seed: F.pmod(F.xxhash64("b", F.lit(seed)), F.col(n)).cast("int")
    mixed = spread_join(own, groups, "a", "g").select("a", "b", "c", "is_x", block("nx", 1).alias("i"), block("ny", 2).alias("j"), "nx", "ny")
    # A document stands in each (i, j) where it is of x-block i, or of y-block j.
    cells = F.expr("""concat(
        transform(sequence(0, nx - 1), r -> named_struct('a', a, 'i', r, 'j', j, 'c', c, 'as_x', is_x and r = i, 'as_y', true)),
        if(is_x, transform(filter(sequence(0, ny - 1), r -> r <> j), r -> named_struct('a', a, 'i', i, 'j', r, 'c', c, 'as_x', true, 'as_y', false)), array()))""")
    need = mixed.select("b", F.explode(cells).alias("o")).groupBy(F.col("b").alias("doc_id")).agg(F.collect_list("o").alias("cells"))
    names = [x.split()[0] for x in _CELL.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                blob = shingle_set(r["text"], k).tobytes()
                for o in r["cells"]:
                    rows.append((o["a"], o["i"], o["j"], r["doc_id"], o["c"], o["as_x"], o["as_y"], blob))
                    held += len(blob) + 100
                if held > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def compare(table: pa.Table) -> pa.Table:
        doc, comp, as_x, as_y = (table.column(c).to_numpy() for c in ("b", "c", "as_x", "as_y"))
        each = [np.frombuffer(s, np.uint64) for s in table.column("s").to_pylist()]
        size = np.array([len(s) for s in each])
        ids = np.split(np.unique(np.concatenate(each), return_inverse=True)[1], np.cumsum(size)[:-1])
        fine = np.stack([fine_registers(s) for s in each])
        y = np.flatnonzero(as_y)
        mark = np.zeros(int(size.sum()), bool)
        a, b = [], []
        for x in np.flatnonzero(as_x).tolist() if len(y) else ():
            # The estimate leaves few to be compared in full.
            other = y[comp[y] != comp[x]]
            other = other[hopeful(fine[x], fine[other], size[x], size[other], percent)]
            mark[ids[x]] = True
            linked: set[int] = set()
            for t in other.tolist():
                if comp[t] not in linked:
                    common = int(np.count_nonzero(mark[ids[t]]))
                    if 100 * common >= percent * (size[x] + size[t] - common):
                        linked.add(comp[t])
                        a.append(min(doc[x], doc[t]))
                        b.append(max(doc[x], doc[t]))
            mark[ids[x]] = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    held = texts.join(need.hint("merge"), "doc_id").select("doc_id", "text", "cells").mapInArrow(sets, _CELL)
    return held.groupBy("a", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 4) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents are linked when 100 * intersection >= ``percent`` * union of their ``k``-word shingle
    sets (words lower-cased in A-Z only); component_id is the smallest id reachable. Null, empty and
    wordless texts have n_shingles 0 and link with nothing. Equal sets are one class, represented by the smallest
    id; a hot one is split. Rows without an id are never linked, are kept and have a null component. Rows that repeat an id are
    one node. Other columns are ignored.
    """
    ship(docs.sparkSession)
    sketched = stage(sketch(docs, k))
    linked = sketched.where(F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull())
    classes = stage(linked.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n", "sig", "fine")).alias("r"), F.count("*").alias("copies")).select("set_hash", "copies", "r.*"))
    bands = band_keys(classes)
    sizes = stage(bands.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"))
    # Compared first with the member of each band that meets most others over all its bands: the centre of a cluster of copies.
    members = stage(spread_join(bands, sizes.withColumn("w", F.col("g")), "key", "w").select("key", "g", F.col("doc_id").alias("b")))
    degrees = members.groupBy("b").agg(F.sum("g").alias("degree"))
    ranked = stage(members.drop("g").join(degrees, "b"))
    release(members, sizes)
    centres = stage(ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("b")).alias("minus"))).alias("m"), F.count("*").alias("w")).select("key", (-F.col("m.minus")).alias("a"), "w"))
    met = stage(spread_join(ranked, centres, "key", "w").where("a <> b").select("a", "b").distinct())
    pairs = stage(_worth_testing(met, classes, percent))
    near = ranked.select(F.col("b").alias("doc_id")).distinct()
    texts = stage(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(near.hint("merge"), "doc_id", "left_semi"))
    release(ranked, centres)
    edges = _verified(pairs, texts, percent, k)
    labels = stage(components(edges))
    more = stage(_across(met, labels, classes, texts, percent, k))
    if more.take(1):
        labels = stage(components(edges.union(more)))
    named = classes.join(labels, F.col("doc_id") == F.col("node"), "left").select("set_hash", "copies", F.coalesce("component", "doc_id").alias("component_id"))
    named = stage(named)
    release(met, pairs, texts, edges, more, labels, classes)
    out = spread_join(sketched.select("doc_id", "n", "set_hash"), named, "set_hash", "copies", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
