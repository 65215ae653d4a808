"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so a question asked again with other
values has the same template. Windows of five words, as templates and as they stand, are
hash-joined between benchmark items and documents. A template window with too few plain
words is widened to either side until it has enough; an item of fewer words is one window, and so is one of four words or more that has
fewer plain words, but one at least. A capital word that opens a
sentence may be a name or not, so windows over it are templates in both ways. Matches are gathered
along each alignment of a document with an item; windows with slots count only if each
value of the item always became the same value of the document. A document is contaminated
by an item of whose words such windows cover four fifths.

Documents keep only windows that pass a bit map of the benchmark's hashes, of a fixed size at most, which is
sent to every worker. Windows that many items share name no candidates: an item that they cannot cover by themselves has
a rarer one in every document that holds it, and they are looked up for those documents only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, ship, spread_join, stage

# Units of measure.
UNITS = frozenset(
    "mm cm dm m km inch inches in ft foot feet yard yards mile miles mg g kg lb lbs oz ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent pct degree degrees celsius fahrenheit kelvin "
    "dollar dollars euro euros pound pounds cent cents usd eur gbp hz khz mhz ghz w kw mw v kv a ma j kj kcal cal n pa kpa bar mol kb mb gb tb kmh mph".split()
)
PLAIN, NUMBER, UNIT, CAPITAL, EMPTY = range(5)
_SLOT = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F], dtype=np.uint64)  # of numbers, units, names
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_CACHE_WORDS = 300_000
MAP_BITS = 27  # of the bit map that windows of documents must pass: 16 MB at most, whatever the benchmark's size
LEAST_SPARSE = 4  # words of an item with fewer plain words than a window needs, to be found with other values
COMMON = 64  # items that share a window which names no candidates


class _Words:
    """Number, hash, kind and sentence end of each distinct raw word, kept for reuse up to a bound."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.plain: list[str] = []
        self.table = (np.empty(1024, np.uint64), np.empty(1024, np.int8), np.empty(1024, bool))

    def add(self, raw: str) -> int:
        bare = raw if raw.isalnum() else raw[:-1] if raw[:-1].isalnum() else "".join(c for c in raw if c.isalnum())
        low = bare.lower()
        if not bare:
            kind = EMPTY
        elif bare[0].isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if bare[0].isupper() and not (len(bare) > 1 and bare.isupper()) else PLAIN
        self.index[raw] = i = len(self.plain)
        self.plain.append(low)
        if i >= len(self.table[0]):
            self.table = tuple(np.resize(t, 2 * len(t)) for t in self.table)
        hashes, kinds, ends = self.table
        hashes[i], kinds[i], ends[i] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")), kind, raw[-1] in ".!?:\"'"
        return i

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if len(self.index) > _CACHE_WORDS:
            self.clear()
        get, add = self.index.get, self.add
        ids = np.array([i if (i := get(w)) is not None else add(w) for w in text.split()], np.int64)
        return ids, *(t[ids] for t in self.table)


_WORDS = _Words()


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's words: their numbers, their hashes, those of the template, the slot type (0: none), and whether
    it may be a name that opens a sentence.

    Punctuation is dropped and case folded. A number begins with a digit; a unit follows a number; a name has a
    capital first letter only and does not open a sentence.
    """
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, bool)
    ids, h, kind, ends = _WORDS.read(text)
    real = kind != EMPTY
    # Marks that stand alone end a sentence as marks on a word do.
    opens = np.append(True, ends[:-1])[real] if len(ids) else np.empty(0, bool)
    ids, h, kind = ids[real], h[real], kind[real]
    slot = np.zeros(len(h), np.int8)
    slot[kind == NUMBER] = 1
    slot[(kind == UNIT) & np.append(False, kind[:-1] == NUMBER)[: len(kind)]] = 2
    slot[(kind == CAPITAL) & ~opens] = 3
    return ids, h, np.where(slot > 0, _SLOT[slot], h), slot, (kind == CAPITAL) & opens


def spelled(ids: np.ndarray) -> list[str]:
    """The words of ``canonical``'s numbers, while the text is at hand."""
    return [_WORDS.plain[i] for i in ids.tolist()]


def _combine(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    out = np.full(len(h) - k + 1, salt, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _A[i]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(29))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            base = int(_A[5])
            self.up, self.down = (np.append(np.uint64(1), np.cumprod(np.full(2 * n, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _templates(t: np.ndarray, slot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, size and hash of the template windows with one slot at least. Those of ``k`` words stand if most
    are plain; others are widened, once to the right and once to the left, until ``k // 2 + 1`` are."""
    before = np.append(0, np.cumsum(slot > 0))
    n = before[k:] - before[:-k]
    first = np.flatnonzero((n > 0) & (2 * n < k))
    size, own = np.full(len(first), k), _combine(t, k, 2)[first]
    dense, plain, need = np.flatnonzero(2 * n >= k), np.flatnonzero(slot == 0), k // 2 + 1
    if not len(dense) or len(plain) < need:
        return first, size, own
    right, left = np.searchsorted(plain, dense) + need - 1, np.searchsorted(plain, dense + k) - need
    a = np.concatenate([dense[right < len(plain)], plain[left[left >= 0]]])
    b = np.concatenate([plain[right[right < len(plain)]] + 1, (dense + k)[left >= 0]])
    a, b = np.divmod(np.unique(a * (len(t) + 1) + b), len(t) + 1)
    up, down = _POWERS.of(len(t))
    sums = np.append(np.uint64(0), np.cumsum(t * up))
    h = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _A[6]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.append(first, a), np.append(size, b - a), np.append(own, h ^ (h >> np.uint64(29)))


def _whole_templates(t: np.ndarray, slot: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of windows as long as an item of fewer than ``k`` words: they need as many plain words as others."""
    before = np.append(0, np.cumsum(slot > 0))
    n = before[m:] - before[:-m]
    first = np.flatnonzero((n > 0) & (m - n >= k // 2 + 1))
    return first, np.full(len(first), m), _combine(t, m, 2 + 4 * m)[first]


def _sparse_templates(t: np.ndarray, slot: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of windows as long as a whole item that has a plain word, but fewer than ``k // 2 + 1``."""
    if len(t) < m:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    before = np.append(0, np.cumsum(slot > 0))
    plain = m - (before[m:] - before[:-m])
    first = np.flatnonzero((plain > 0) & (plain < k // 2 + 1))
    up, down = _POWERS.of(len(t))
    sums = np.append(np.uint64(0), np.cumsum(t * up))
    h = (sums[first + m] - sums[first]) * down[first] + np.full(1, m, np.uint64) * _A[7]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return first, np.full(len(first), m), h ^ (h >> np.uint64(29))


def bit_map(hashes: DataFrame) -> tuple[bytes, int]:
    """Which leading bits the hashes (h) have, eight to a byte: built in tasks, and never over 2**MAP_BITS bits."""
    bits = min(MAP_BITS, max(16, int(np.ceil(np.log2(max(1, hashes.count())))) + 8))
    number = F.shiftrightunsigned("h", 64 - bits) + 1
    parts = hashes.select(F.bitmap_bucket_number(number).alias("b"), F.bitmap_bit_position(number).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = bytearray((1 << bits) // 8)
    for r in parts:
        out[(r["b"] - 1) * len(r["m"]) : r["b"] * len(r["m"])] = r["m"][: len(out)]
    return bytes(out), bits


def _windows(key: str, k: int, short: list[int] | None = None, shared=None, bits: int = 0, sparse: list[int] = ()):
    """Rows (key, pos, size, h, slots, loose) of windows as they stand (no slots) and as templates: of all items, whose
    text is one window if it is shorter or has few plain words, or of documents, those of ``k`` and of ``short`` words, and templates
    of ``sparse`` words, that pass the shared bit map.
    Loose windows take a capital word that opens a sentence for a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.frombuffer(shared.value, np.uint8) if shared is not None else None

        def pick(h: np.ndarray) -> np.ndarray:
            if near is None:
                return np.arange(len(h))
            i = (h >> np.uint64(64 - bits)).astype(np.int64)
            return np.flatnonzero((near[i >> 3] >> (i & 7)) & 1)

        for batch in batches:
            for c in range(0, batch.num_rows, 500):
                part = batch.slice(c, 500)
                keys, pos, sizes, hashes, slots, loose = [], [], [], [], [], []

                def put(name: int, at: np.ndarray, size: np.ndarray, h: np.ndarray, said: list, names: bool) -> None:
                    keys.extend([name] * len(at))
                    pos.extend(at.tolist())
                    sizes.extend(size.tolist())
                    hashes.append(h)
                    slots.extend(said)
                    loose.extend([names] * len(at))

                for name, text in zip(part.column(key).to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids, h, t, slot, opener = canonical(text)
                    if name is None or not len(h):
                        continue
                    widths = ([k] if len(h) >= k else [len(h)]) if short is None else [m for m in (*short, k) if m <= len(h)]
                    for m in widths:
                        own = _combine(h, m, 1 + 4 * m)
                        at = pick(own)
                        put(name, at, np.full(len(at), m), own[at], [[]] * len(at), False)
                    for names in (False, True):
                        if names and opener.any():
                            t, slot = np.where(opener, _SLOT[3], t), np.where(opener, np.int8(3), slot)
                        elif names or not slot.any():
                            continue
                        before = np.append(0, np.cumsum(opener))
                        whole = ([len(h)] if len(h) >= LEAST_SPARSE else []) if short is None else sparse
                        for m, make in [*((m, _templates if m == k else _whole_templates) for m in widths), *((m, _sparse_templates) for m in whole)]:
                            first, size, own = _templates(t, slot, k) if make is _templates else make(t, slot, m, k)
                            at = pick(own)
                            if names:
                                at = at[before[first[at] + size[at]] > before[first[at]]]
                            said = [spelled(ids[p : p + n][slot[p : p + n] > 0]) for p, n in zip(first[at].tolist(), size[at].tolist(), strict=True)]
                            put(name, first[at], size[at], own[at], said, names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()), pa.array(pos, pa.int32()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64) if hashes else [], pa.int64()),
                        pa.array(slots, pa.list_(pa.string())), pa.array(loose, pa.bool_()),
                    ],
                    [key, "pos", "size", "h", "slots", "loose"],
                )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, coverage, changed): pairs of a document and an item of which it has at least ``least``.

    coverage: the share of the item's words in matched windows; changed: whether a slot has another value. An item of fewer
    than ``k`` words, or with fewer plain ones than ``k // 2 + 1``, must be there whole; with other values it is found if it has that many plain words, or at least
    one and four words in all. Rows without an id and null texts match nothing. Items with equal ids are one; items of equal text are
    looked for once, whatever their number, and told apart in the result.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "{} bigint, pos int, size int, h bigint, slots array<string>, loose boolean"
    given = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    # An id with several texts stays as it is.
    single = given.groupBy("item_id").agg(F.count("*").alias("n"), F.min("text").alias("text"))
    leads = single.where("n = 1").groupBy("text").agg(F.min("item_id").alias("lead"))
    members = stage(single.where("n = 1").join(leads, "text").select("item_id", "lead").union(single.where("n > 1").select("item_id", F.col("item_id").alias("lead"))))
    items = given.join(members.where("item_id = lead"), "item_id", "left_semi")
    items = stage(items.mapInArrow(_windows("item_id", k), schema.format("item_id")))
    n_items = stage(items.groupBy("item_id").agg(F.max(F.col("pos") + F.col("size")).alias("n_item")))
    short = sorted(r["n_item"] for r in n_items.where(F.col("n_item") < k).select("n_item").distinct().collect())  # fewer than k numbers
    few = F.col("size") - F.size("slots") < k // 2 + 1
    sparse = sorted(r["size"] for r in items.where((F.size("slots") > 0) & few).select("size").distinct().collect())  # lengths of items with few plain words
    found, bits = bit_map(items.select("h").distinct())
    seen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_windows("doc_id", k, short, spark.sparkContext.broadcast(found), bits, sparse), schema.format("doc_id"))
    seen = stage(seen.join(items.select("h").distinct(), "h", "left_semi"))
    shared = items.groupBy("h").agg((F.count_distinct("item_id") > COMMON).alias("common"))
    theirs = items.join(shared, "h").select("item_id", F.col("pos").alias("item_pos"), F.col("size").alias("item_size"), "h", F.col("slots").alias("item_slots"), F.col("loose").alias("item_loose"), "common")
    reach = F.array_distinct(F.flatten(F.collect_set(F.sequence("item_pos", F.col("item_pos") + F.col("item_size") - 1))))
    wide = theirs.where("common").groupBy("item_id").agg(F.size(reach).alias("w")).join(n_items, "item_id").where(F.col("w") >= least * F.col("n_item")).select("item_id", F.lit(True).alias("wide"))
    theirs = stage(theirs.join(wide, "item_id", "left").withColumn("names", ~F.col("common") | F.coalesce("wide", F.lit(False))).drop("common", "wide"))
    one = F.struct("item_id", "item_pos", "item_slots", "item_loose")
    named = theirs.where("names").groupBy("h").agg(F.collect_list(one).alias("items")).join(seen.groupBy("h").agg(F.count("*").alias("weight")), "h")
    pair = lambda df: df.select("doc_id", "item_id", "item_pos", "size", (F.col("pos") - F.col("item_pos")).alias("shift"), "slots", "item_slots", (F.col("loose") | F.col("item_loose")).alias("loose"))
    met = stage(pair(spread_join(seen, named, "h", "weight").withColumn("i", F.explode("items")).select("doc_id", "pos", "size", "slots", "loose", "i.*")))
    if theirs.where("not names").take(1):
        more = met.select("doc_id", "item_id").distinct().join(theirs.where("not names"), "item_id").join(seen, ["doc_id", "h"])
        met = stage(met.union(pair(more)))
    release(items)
    # Along an alignment each value of the item must have become one value of the document; of loose windows, also together with the others.
    values = met.where(F.size("slots") > 0).select("doc_id", "item_id", "shift", "loose", F.explode(F.arrays_zip("item_slots", "slots")).alias("v"))
    values = values.groupBy("doc_id", "item_id", "shift", F.col("v.item_slots").alias("was"), F.col("v.slots").alias("now")).agg(F.min("loose").alias("loose"))
    other = F.col("now") != F.col("was")
    each = values.groupBy("doc_id", "item_id", "shift", "was").agg(F.count("*").alias("n"), F.count_if(~F.col("loose")).alias("n_strict"), F.max(other).alias("other"), F.max(other & ~F.col("loose")).alias("other_strict"))
    slots = each.groupBy("doc_id", "item_id", "shift").agg((F.max("n") == 1).alias("all_consistent"), (F.max("n_strict") <= 1).alias("strict_consistent"), F.max("other").alias("other"), F.max("other_strict").alias("other_strict"))
    consistent = F.when(F.col("loose"), F.col("all_consistent")).otherwise(F.col("strict_consistent"))
    changed = F.when(F.size("slots") > 0, F.when(F.col("loose"), F.col("other")).otherwise(F.col("other_strict")))
    kept = met.join(slots, ["doc_id", "item_id", "shift"], "left").where((F.size("slots") == 0) | consistent)
    words = F.array_distinct(F.flatten(F.collect_set(F.sequence("item_pos", F.col("item_pos") + F.col("size") - 1))))
    covered = kept.groupBy("doc_id", "item_id").agg(F.size(words).alias("n"), F.coalesce(F.max(changed), F.lit(False)).alias("changed"))
    share = F.col("n") / F.col("n_item")
    pairs = covered.join(n_items, "item_id").where(share >= least).select("doc_id", F.col("item_id").alias("lead"), share.alias("coverage"), "changed")
    return pairs.join(members, "lead").select("doc_id", "item_id", "coverage", "changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (sorted), coverage (of the best), changed.

    Null, empty and short texts and rows without an id are clean. Repeated rows each give a row; rows that
    repeat an id share a verdict. Other columns are ignored.
    """
    found = find_contamination(docs, benchmark, k, least)
    by_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.max("changed").alias("changed"))
    return docs.select(F.col("doc_id").cast("bigint")).join(by_doc, "doc_id", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("int").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("changed", F.lit(False)).alias("changed"),
    )
