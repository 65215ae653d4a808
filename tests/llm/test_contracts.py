"""The training-data operators against brute force, on small fixtures with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fenbrook.llm import decontam, langid, packing, quality_qda, suffix_dedup, toxicity, wordpiece
from fenbrook.llm.decontam import decontaminate, find_contamination
from fenbrook.llm.graph import components
from fenbrook.llm.langid import identify_languages
from fenbrook.llm.minhash import estimate, fine_registers, near_duplicates
from fenbrook.llm.packing import best_fit, pack, pack_histogram
from fenbrook.llm.quality_qda import quality_scores
from fenbrook.llm.quality_rules import quality_rules
from fenbrook.llm.queries import ORACLE, QUERIES
from fenbrook.llm.sharding import communication_matrix, shuffle_into_shards
from fenbrook.llm.suffix_dedup import cut_repeats, maximal_repeats
from fenbrook.llm.toxicity import toxicity_scores
from fenbrook.llm.wordpiece import token_counts

from ..conftest import SF

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key string"
RNG = random.Random(4)
WORDS = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choices(WORDS, k=n))


def documents():
    rng = random.Random(11)
    base = [prose(rng.randint(60, 200), rng) for _ in range(30)]
    texts = list(base) + [base[0]] * 6 + [None, "", " \n\t ", "one", "one two", "ONE two three", "é ü ß 中文 words", "x" * 30_000, prose(6000, rng), "\n".join(["same line here"] * 30), "word " * 300]
    for t in base[:8]:  # near copies: a few words differ
        for k in (1, 2, 6):
            w = t.split()
            for i in rng.sample(range(len(w)), min(k, len(w))):
                w[i] = "changed"
            texts.append(" ".join(w))
    texts += [prose(20, rng) + " " + base[3][50:200] + " " + prose(20, rng) for _ in range(5)]
    return [(i, t, ("en", "de", None)[i % 3], "s", 0, 1, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(60)] + [(None, 1, 0), (3, None, None), (10**9, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- sharding ---


def test_shards_are_exact(docs):
    rows = shuffle_into_shards(docs, 7).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in documents())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {d[0]: (d[1] or "").encode() for d in documents()}
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["grown_shard"] is None and r["law"] == "rows" for r in rows)


def test_shards_of_few_or_no_rows(spark, empty):
    assert shuffle_into_shards(empty, 4).count() == 0
    rows = shuffle_into_shards(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string"), 24).collect()
    assert len(rows) == 3 and len({(r["shard"], r["slot"]) for r in rows}) == 3


def test_communication_matrix_follows_its_law(spark):
    """Sums are exact; over many seeds a cell has the mean and variance of a hypergeometric count."""
    counts = spark.createDataFrame([(0, 30), (1, 0), (2, 50)], "part int, n long")
    cells = []
    for seed in range(60):
        m = {r["part"]: r["row"] for r in communication_matrix(counts, 3, 4, seed).collect()}
        assert [sum(m[p]) for p in range(3)] == [30, 0, 50]
        assert [sum(m[p][j] for p in range(3)) for j in range(4)] == [20] * 4
        cells += m[0]
    mean, var = 7.5, 20 * (30 / 80) * (50 / 80) * (60 / 79)
    assert abs(np.mean(cells) - mean) < 1e-9  # rows sum to 30 over four shards
    assert 0.6 * var < np.var(cells) < 1.5 * var


# --- quality rules ---


def test_rule_counts(docs, labels):
    got = {r["doc_id"]: r for r in quality_rules(docs, labels).collect()}
    for i, t, *_ in documents():
        w, r = words(t), got[i]
        seen, covered = defaultdict(int), set()
        for k in range(len(w) - 2):
            seen[tuple(w[k : k + 3])] += 1
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_rules_find_what_labels_mark(spark):
    rng = random.Random(2)
    rows = [(i, prose(80, rng) + (" $$$ %%%" * 30 if i % 4 == 0 else "")) for i in range(400)]
    marked = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 400)], "doc_id long, quality int")
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), marked).collect()
    wrong = sum(r["kept"] != (r["doc_id"] % 4 != 0) for r in got)
    assert wrong <= 8
    unlabelled = quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), marked.where("false"))
    assert unlabelled.where("not kept").count() == 0


# --- suffix arrays ---


def brute_cut(rows, n=50):
    first, out = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first.setdefault(b[p : p + n], i) < i:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def test_cut_repeats(docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in cut_repeats(docs).collect()}
    assert got == brute_cut(documents())


def test_cut_repeats_without_rows_or_ids(spark, empty):
    assert cut_repeats(empty).count() == 0
    rows = cut_repeats(spark.createDataFrame([(None, "y" * 80), (1, "y" * 80), (2, "é" * 40)], "doc_id long, text string"), keep_text=True).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in rows} == {(None, 0), (1, 0), (2, 0)}


def test_cut_repeats_at_later_places_of_a_document(spark):
    """Passages that stand twice in a document and whose partner is in another partition."""
    rng = random.Random(12)
    passage = [prose(40, rng) for _ in range(20)]
    rows = [(i, f"{prose(20, rng)} {p} {prose(20, rng)}") for i, p in enumerate(passage)]
    rows += [(100 + i, f"{prose(20, rng)} {p} {prose(20, rng)} {p} {prose(20, rng)} {p[40:120]}") for i, p in enumerate(passage)]
    # The later place of the smaller document is the one that repeats; its first has the same gram only in part.
    rows += [(200 + i, f"{p[:60]} {prose(20, rng)} {p} {prose(20, rng)}") for i, p in enumerate(prose(40, rng) for _ in range(20))]
    rows += [(300 + i, f"{prose(20, rng)} {t.split(' ', 40)[-1]}") for i, t in list(rows) if i >= 200]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 10), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in cut_repeats(docs).collect()}
    assert got == brute_cut(rows)


def test_rows_that_repeat_an_id_lose_their_own_passages(spark):
    rng = random.Random(3)
    x, z = prose(60, rng)[:300], prose(60, rng)[:300]
    rows = [(1, x), (2, x), (2, z), (2, x), (3, z), (None, x), (3, z[:60] + x[:60])]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted([(1, 300, 0), (2, 300, 300), (2, 300, 0), (2, 300, 300), (3, 300, 300), (0, 300, 0), (3, 120, 120)])


def test_other_columns_go_through_the_cut(spark):
    rows = [(1, "a" * 60, "en", "x"), (2, "a" * 70, "de", "y"), (3, None, None, "z")]
    got = {r["doc_id"]: (r["kept_text"], r["lang"]) for r in cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, items string"), keep_text=True, keep=("lang",)).collect()}
    assert got == {1: ("a" * 60, "en"), 2: ("", "de"), 3: (None, None)}


def brute_repeats(rows, n=50):
    """Each repeat with its length and all its places: strings of n bytes whose places are the same, byte after byte, are one."""
    places = defaultdict(set)
    text = {i: (t or "").encode() for i, t, *_ in rows}
    for i, b in text.items():
        for p in range(len(b) - n + 1):
            places[b[p : p + n]].add((i, p))
    shared = {s: w for s, w in places.items() if len({i for i, _ in w}) > 1}
    goes_on = lambda a, b: a in shared and b in shared and {(i, p + 1) for i, p in shared[a]} == shared[b]
    out = set()
    for s, w in shared.items():
        i, p = min(w)
        b = text[i]
        if p and goes_on(b[p - 1 : p - 1 + n], s):
            continue
        k = p
        while goes_on(b[k : k + n], b[k + 1 : k + 1 + n]):
            k += 1
        out.add((k - p + n, frozenset(w)))
    return out


def _repeats(df):
    groups = defaultdict(set)
    for r in maximal_repeats(df).collect():
        groups[r["repeat"], r["length"]].add((r["doc_id"], r["start"]))
    return {(n, frozenset(w)) for (_, n), w in groups.items()}


def test_maximal_repeats_are_all_there(spark, docs):
    assert _repeats(docs) == brute_repeats(documents())
    rng = random.Random(5)
    long, core = prose(400, rng), prose(20, rng)
    rows = [(1, long), (2, long), (3, core + long[200:900] + core), (4, prose(30, rng) + core + core), (5, "ab" * 200), (6, "x" + "ab" * 90), (7, "ab" * 20), (8, None)]
    assert _repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute_repeats(rows)


def test_enhanced_suffix_array_and_intervals():
    data = np.frombuffer(b"abracadabra" * 3 + b"xyz", np.uint8)
    starts = np.arange(len(data))
    order, common = suffix_dedup.enhanced_suffix_array(data, starts, len(data) - starts)
    raw = data.tobytes()
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in starts)
    for i in range(1, len(order)):
        a, b = raw[order[i - 1] :], raw[order[i] :]
        assert common[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for depth, a, b, _ in suffix_dedup.intervals(common, 2):
        group = {raw[i : i + depth] for i in order[a : b + 1]}
        assert len(group) == 1 and raw.count(b"") and min(common[a + 1 : b + 1]) == depth


def test_maximal_repeats_have_all_their_places(docs):
    text = {i: (t or "").encode() for i, t, *_ in documents()}
    groups = defaultdict(set)
    for r in maximal_repeats(docs).collect():
        groups[r["repeat"], r["length"]].add((r["doc_id"], r["start"]))
    assert groups
    for (_, n), places in groups.items():
        strings = {text[d][p : p + n] for d, p in places}
        assert len(strings) == 1
        s = strings.pop()
        assert {(d, m.start()) for d, b in text.items() for m in re.finditer(b"(?=" + re.escape(s) + b")", b)} == places


# --- SQL twins ---


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(ORACLE[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


# --- near duplicates ---


def brute_near(rows, k=4):
    sets = {}
    for i, t, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == brute_near(documents())


def test_cluster_whose_members_miss_their_centre(spark):
    """Copies with ever more edits: links run along the chain, not all to one member."""
    rng = random.Random(9)
    w = prose(160, rng).split()
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        for k in rng.sample(range(len(w)), 3):
            w[k] = f"edit{i}{k}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_without_rows_or_ids(spark, empty):
    assert near_duplicates(empty).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (7, 7, True), (7, 7, True)]


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:3000]), np.unique(pool[500:3500])
    share, _ = estimate(fine_registers(a)[None], fine_registers(b)[None])
    assert abs(share[0] - 2500 / 3500) < 0.12


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}


# --- packing ---


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rows = pack(docs, VOCABULARY).collect()
    whole = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x, *_ in documents()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in whole.items():
        assert sorted(by_doc[i]) == [(k, 2048 * k, min(2048, len(ids) - 2048 * k)) for k in range(math.ceil(len(ids) / 2048))]
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by_sequence) <= math.ceil(sum(map(len, whole.values())) / 2048) + 1


def test_packing_uses_up_histograms():
    rng = random.Random(8)
    for _ in range(20):
        h = {rng.randint(1, 100): rng.randint(1, 200) for _ in range(rng.randint(1, 40))}
        plan = pack_histogram(h, 100)
        used = defaultdict(int)
        for c, m in plan:
            assert sum(s * n for s, n in c) <= 100
            for s, n in c:
                used[s] += n * m
        assert used == h
        n = sum(m for _, m in plan)
        plain = sum(m for _, m in best_fit(dict(h), 100))
        assert math.ceil(sum(s * k for s, k in h.items()) / 100) <= n <= plain


def test_most_sequences_come_from_the_program():
    rng = np.random.default_rng(3)
    for times in (1, 10):
        h = defaultdict(int)
        for n in np.minimum(2048, rng.lognormal(5.5, 1.0, 1000).astype(int) + 1).tolist():
            h[n] += times
        plan, left = packing.program_plan(h, 2048)
        multi = lambda p: sum(m for c, m in p if sum(n for _, n in c) > 1)
        out = pack_histogram(h, 2048)
        total = lambda p: sum(m for _, m in p)
        assert multi(plan) >= 0.9 * multi(out) and total(out) <= total(best_fit(dict(h), 2048))
        assert total(out) <= 1.002 * sum(s * n for s, n in h.items()) / 2048 + 1 and sum(left.values()) < 0.05 * sum(h.values())
        masses, bound = packing.configuration_masses(dict(h), 2048)
        assert 0.99 * total(out) - 1 <= bound <= total(out) + 1e-6
        for s in h:
            assert sum(x * dict(c).get(s, 0) for c, x in masses.items()) >= h[s] - 1e-6


def test_packing_repeated_rows_null_ids_and_special_tokens(spark):
    from tokenizers import Tokenizer

    rows = [(1, "a b"), (1, "a b"), (None, "c <|endoftext|> d"), (2, None), (3, "x<|startoftext|>y Z<|endoftext|>")]
    t = Tokenizer.from_file(VOCABULARY)
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, capacity=8).collect()
    want = sorted((i or 0, zlib.crc32(np.array((t.encode(x or "", add_special_tokens=False).ids + [0])[k : k + 8], "<u4").tobytes())) for i, x in rows for k in range(0, len(t.encode(x or "", add_special_tokens=False).ids) + 1, 8))
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in got) == want
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_chunk_tokenizer_is_exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    texts = [x or "" for _, x, *_ in documents()] + ["Straße «œuvre» naïve don't été, İstanbul ÀÉÎ. µm ª ΣΑΣ <|endoftext|> a b c"]
    assert packing.ChunkTokenizer(VOCABULARY).encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_no_rows(empty):
    assert pack(empty, VOCABULARY).count() == 0


# --- word pieces ---


def test_counts_are_greedy(docs):
    pieces = {*wordpiece.read_vocabulary(VOCABULARY), (wordpiece.END,)}
    longest = max(map(len, pieces))

    def greedy(word):
        s, n = (*word.encode(), wordpiece.END), 0
        while s:
            k = next(k for k in range(min(longest, len(s)), 0, -1) if s[:k] in pieces)
            s, n = s[k:], n + (s[:k] != (wordpiece.END,))
        return n

    got = {r["doc_id"]: r for r in token_counts(docs, VOCABULARY).collect()}
    for i, t, *_ in documents():
        each = [greedy(w) for w in words((t or "").lower())]
        assert (got[i]["n_words"], got[i]["n_pieces"], got[i]["max_word_pieces"]) == (len(each), sum(each), max(each, default=0))


def test_automaton_on_random_vocabularies():
    rng = random.Random(3)
    for _ in range(50):
        pieces = {tuple(rng.choices([97, 98], k=rng.randint(1, 5))) for _ in range(6)} | {(97,), (98,), (wordpiece.END,)}
        a = wordpiece.LongestMatch(sorted(pieces))
        for _ in range(20):
            s = bytes(rng.choices([97, 98], k=rng.randint(0, 12)))
            rest, n = (*s, wordpiece.END), 0
            while rest:
                k = next(k for k in range(len(rest), 0, -1) if rest[:k] in pieces)
                rest, n = rest[k:], n + (rest[:k] != (wordpiece.END,))
            assert a.count(s) == n


# --- decontamination ---


def test_verbatim_and_changed_questions(spark):
    item = "Then farmer Alice sold 12 apples and 30 kg of pears to Bob for 45 dollars in the old market near the river"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    rng = random.Random(6)
    pad = lambda: prose(30, rng)
    rows = [
        (1, f"{pad()}. {item} {pad()}"),
        (2, f"{pad()}. {item.replace('Alice', 'Carol').replace('12', '77').replace('45', '91').replace('kg', 'lb')} {pad()}"),
        (3, pad()),
        (4, f"{pad()} {' '.join(item.split()[:6])} {pad()}"),
        (5, None),
        (6, ""),
        (7, item.upper()),
    ]
    got = {r["doc_id"]: r for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} >= {1, 2} and not any(got[i]["contaminated"] for i in (3, 4, 5, 6))
    assert got[1]["item_ids"] == [1] and not got[1]["changed"] and got[2]["changed"]


def test_one_value_must_stay_one_value(spark):
    item = "the first train takes 40 minutes and the second train takes 40 minutes so both trains take the same time on the line"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    broken = item.replace("40", "17", 1).replace("40", "23", 1)
    docs = spark.createDataFrame([(1, item.replace("40", "55")), (2, broken)], "doc_id long, text string")
    found = {r["doc_id"]: r["coverage"] for r in find_contamination(docs, bench, least=0.0).collect()}
    assert found[1] == 1.0 and found[2] < 0.8


def test_dense_items_and_names_that_open_sentences(spark):
    items = [
        (1, "A train covers 12 km in 3 hours and 18 km in 4 hours how far"),
        (2, "Alice has 5 apples in a basket. Bob has 7 pears in a box. Who has more fruit in the end?"),
        (3, "17 kg 12 km of rope cost 40 euros 25 cents per 3 m 2 cm"),
    ]
    texts = [
        (1, "A train covers 95 km in 6 hours and 41 km in 2 hours how far"),
        (2, "Carol has 6 apples in a basket. Dave has 8 pears in a box. Who has more fruit in the end?"),
        (3, "88 kg 31 km of rope cost 70 euros 99 cents per 5 m 4 cm"),
        (4, "A boat covers 95 km in 6 hours but 41 km in 2 hours was slow"),
        (5, "Carol has 6 apples in a basket. Carol has 8 pears in a box. Who has 3 plums of that kind?"),
        (6, "17 kg 12 km 40 euros 25 cents 3 m 2 cm"),
    ]
    rng = random.Random(6)
    rows = [(i, f"{prose(30, rng)} 4 5. {t} 9 8 {prose(30, rng)}") for i, t in texts] + [(10 + i, t) for i, t in texts]
    found = {(r["doc_id"], r["item_id"]): r for r in find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(found) == {(i, i % 10) for i in (1, 2, 3, 11, 12, 13)}
    # "5. A train" reads as five amperes.
    assert all(r["coverage"] == (15 / 16 if k == (1, 1) else 1.0) and r["changed"] for k, r in found.items())


def brute_items(rows, items, k=5, least=0.8):
    """Every window of every item against every window of every document, values along alignments, by plain loops."""

    def parsed(text):
        out, after = [], True
        raws = (text or "").split()
        for raw in raws:
            bare = "".join(c for c in raw if c.isalnum())
            opens, after = after, raw[-1] in ".!?:\"'"
            if bare:
                out.append((bare, opens))
        kinds = []
        for j, (w, opens) in enumerate(out):
            number = w[0].isdigit()
            unit = j > 0 and out[j - 1][0][0].isdigit() and w.lower() in decontam.UNITS
            name = not number and w.lower() not in decontam.UNITS and w[0].isupper() and not (len(w) > 1 and w.isupper())
            kinds.append("N" if number else "U" if unit else "C" if name and not opens else "O" if name else "")
        return [w.lower() for w, _ in out], kinds

    def windows(text, sizes, sparse=()):
        w, kinds = parsed(text)
        out = {(p, m): ("as is", tuple(w[p : p + m]), None, False) for m in sizes for p in range(len(w) - m + 1)}
        found = [(p, m, v) for (p, m), v in out.items()]
        for loose in (False, True):
            kk = [("C" if x == "O" else x) if loose else ("" if x == "O" else x) for x in kinds]
            spans = set()
            for m in sizes:
                for p in range(len(w) - m + 1):
                    plain = sum(not x for x in kk[p : p + m])
                    if plain == m:
                        continue
                    if plain >= k // 2 + 1:
                        spans.add((p, m))
                    elif m == k:
                        at = [j for j in range(p, len(w)) if not kk[j]]
                        if len(at) >= k // 2 + 1:
                            spans.add((p, at[k // 2] + 1 - p))
                        at = [j for j in range(p + m) if not kk[j]]
                        if len(at) >= k // 2 + 1:
                            spans.add((at[-(k // 2 + 1)], p + m - at[-(k // 2 + 1)]))
            whole = {(p, m) for m in sparse for p in range(len(w) - m + 1) if 0 < sum(not x for x in kk[p : p + m]) < k // 2 + 1}
            for p, m, name in [(*x, "template") for x in spans] + [(*x, "sparse") for x in whole]:
                if loose and "O" not in kinds[p : p + m]:
                    continue
                found.append((p, m, (name, tuple(x or y for x, y in zip(kk[p : p + m], w[p : p + m], strict=True)), tuple(y for x, y in zip(kk[p : p + m], w[p : p + m], strict=True) if x), loose)))
        return found, len(w)

    out = set()
    shorts = {n for _, t in items if 0 < (n := windows(t, [])[1]) < k}
    whole = {n for _, t in items if (n := windows(t, [])[1]) >= decontam.LEAST_SPARSE and any(x[2][0] == "sparse" for x in windows(t, [], [n])[0])}
    for i, t in items:
        n = windows(t, [])[1]
        own, _ = windows(t, [min(n, k)] if n else [], [n] if n in whole else [])
        for d, x in rows:
            theirs, _ = windows(x, [*shorts, k], whole)
            if d is None:
                continue
            shifts = defaultdict(list)
            for q, m, (kind, pattern, said, loose) in own:
                for p, m2, (kind2, pattern2, said2, loose2) in theirs:
                    if m == m2 and kind == kind2 and pattern == pattern2:
                        shifts[p - q].append((q, m, said, said2, loose or loose2))
            covered = set()
            for hits in shifts.values():
                strict_, all_ = defaultdict(set), defaultdict(set)
                for _, _, said, said2, loose in hits:
                    for a, b in zip(said or (), said2 or (), strict=True):
                        all_[a].add(b)
                        if not loose:
                            strict_[a].add(b)
                fine = {True: all(len(v) == 1 for v in all_.values()), False: all(len(v) == 1 for v in strict_.values())}
                for q, m, said, _, loose in hits:
                    if said is None or fine[loose]:
                        covered |= set(range(q, q + m))
            if n and len(covered) >= least * n:
                out.add((d, i))
    return out


def test_contamination_by_brute_force(spark, monkeypatch):
    """Random items and documents with pieces of them, values changed, in part also where all windows are common ones."""
    rng = random.Random(21)
    vocabulary = ["the", "train", "sold", "market", "river", "near", "old", "fast", "Anna", "Bob", "12", "7", "km", "kg", "and", "of", "then.", "has"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.choice((1, 3, 4, 4, 6, 9, 14)))) for i in range(14)] + [(20, None), (21, ""), (22, "the old market has"), (22 + 1, "the old market has")]
    change = lambda t: t.replace("12", rng.choice(("12", "99"))).replace("Anna", rng.choice(("Anna", "Zoe"))).replace("km", rng.choice(("km", "kg")))
    rows = [(100 + j, f"{say(6)} {change(rng.choice(items[:14])[1])} {say(rng.choice((0, 5)))}") for j in range(60)] + [(None, items[0][1]), (300, None), (301, items[5][1]), (301, items[5][1])]
    want = brute_items(rows, items)
    assert len(want) > 20
    for common in (64, 1):
        monkeypatch.setattr(decontam, "COMMON", common)
        docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id long")
        found = find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_decontaminate_repeated_rows_ties_and_clashing_columns(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    bench = spark.createDataFrame([(1, item, 5), (2, item, 6), (2, item, 6)], "item_id long, text string, doc_id long")
    rows = [(1, item, True), (1, item, False), (2, "nothing of that", None), (None, item, None)]
    got = [tuple(r)[:4] for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string, contaminated boolean"), bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, True, 2, [1, 2]), (1, True, 2, [1, 2]), (2, False, 0, []), (None, False, 0, [])]))


def test_decontaminate_without_rows(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(empty, none).count() == 0
    assert decontaminate(docs, none).where("contaminated").count() == 0


# --- classifiers ---


def test_quality_scores(spark, docs, labels, empty):
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality_scores(docs, labels.where("false")).collect()} == {0.5}


def test_quality_scores_by_brute_force(spark):
    """Statistics, moments, shrinkage and densities anew, from the rows and with plain determinants and inverses."""
    rng = random.Random(13)
    rows = [(i, (prose(rng.randint(5, 60), rng) + rng.choice(("", "!!", " A1 B2", " ### $", "\nsame\nsame", "")) * rng.randint(0, 4)) if i % 17 else None) for i in range(160)]
    marked = [(i, int(rng.random() < 0.6)) for i in range(150)] + [(7, 1), (7, 1), (None, 1), (8, None)]  # a label that is repeated counts each time
    df = spark.createDataFrame([*rows, (5, rows[5][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_scores(df, spark.createDataFrame(marked, "doc_id long, quality int")).collect()}

    def stats(t):
        t = t or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        per = lambda a, b: a / max(b, 1)
        n = lambda p: len(re.findall(p, t))
        return [math.log1p(len(w)), math.log1p(per(len(w), len(lines))), math.log1p(per(sum(map(len, w)), len(w))), math.sqrt(per(n(r"[#*$%&|<>]"), len(w))), math.sqrt(per(n("[A-Z]"), len(t))), math.sqrt(per(n("!"), len(w))),
            math.sqrt(per(n("[0-9]"), len(t))), math.sqrt(per(n("[.,;:?]"), len(w))), math.log1p(len(w)) - math.log1p(len(set(w))), math.sqrt(per(len(lines) - len(set(lines)), len(lines)))]

    x = {i: np.array(stats(t)) for i, t in rows}
    train = [(x[i], y) for i, y in marked if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5]
    train += [(x[5], y) for i, y in marked if i == 5 and zlib.crc32(b"5") % 5]
    by = {k: np.array([v for v, y in train if y == k]) for k in (0, 1)}
    total = len(train)
    cov = {k: np.cov(by[k].T, bias=True) for k in by}
    pooled = sum(len(by[k]) * cov[k] for k in by) / total
    log = {}
    for k in by:
        c = 0.98 * (0.8 * cov[k] + 0.2 * pooled) + 0.02 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(10)
        inv, det, mean = np.linalg.inv(c), np.linalg.slogdet(c)[1], by[k].mean(axis=0)
        log[k] = {i: math.log((len(by[k]) + 1) / (total + 2)) - 0.5 * (det + (v - mean) @ inv @ (v - mean)) for i, v in x.items()}
    for i in x:
        want = 1 / (1 + math.exp(min(500, max(-500, log[0][i] - log[1][i]))))
        assert abs(got[i] - want) < 1e-6, i


def test_learned_rules_by_brute_force(spark):
    """The decision list grown anew over the rows themselves."""
    from fenbrook.llm.common import uniform
    from fenbrook.llm.quality_rules import learn_decision_list

    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rng.random(), rng.random()
        rows.append((i, int((a > 0.7 and b < 0.4) or (b > 0.9) or rng.random() < 0.03), a, b))
    df = spark.createDataFrame(rows, "doc_id long, bad int, a double, b double")
    grow = {r["doc_id"]: r["g"] for r in df.select("doc_id", (uniform(F.lit(5), F.col("doc_id")) < 2 / 3).alias("g")).collect()}
    cut = df.agg(*(F.percentile_approx(n, [k / 32 for k in range(1, 32)], 1000).alias(n) for n in "ab")).first()
    holds = lambda rule, r: all((r[f] >= t) == up for f, up, t in rule)
    left, want = [dict(zip(("i", "bad", "a", "b"), r, strict=True)) for r in rows], []
    while len(want) < 8:
        rule = []
        while len(rule) < 3:
            here = [r for r in left if grow[r["i"]] and holds(rule, r)]
            p0, n0 = sum(r["bad"] for r in here), sum(1 - r["bad"] for r in here)
            best, found = 1e-9, None
            for f in "ab" if p0 and n0 else "":
                for t in sorted(set(cut[f])):
                    for up in (False, True):
                        some = [r for r in here if (r[f] >= t) == up]
                        p, n = sum(r["bad"] for r in some), sum(1 - r["bad"] for r in some)
                        if p >= 5 and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best:
                            best, found = gain, ((f, up, t), n == 0)
            if not found:
                break
            rule.append(found[0])
            if found[1]:
                break
        if not rule:
            break
        scored = []
        for k in range(1, len(rule) + 1):
            prune, grown = ([r for r in left if grow[r["i"]] == g and holds(rule[:k], r)] for g in (False, True))
            some = prune or grown
            p, n = sum(r["bad"] for r in some), sum(1 - r["bad"] for r in some)
            scored.append(((p - n) / max(1, p + n), -k, p / max(1, p + n), p + n))
        value, short, precision, covered = max(scored)
        rule = rule[:-short]
        if precision < 0.9 or not covered:
            break
        want.append(tuple(rule))
        left = [r for r in left if not holds(rule, r)]
    got = [tuple((c.feature, c.at_least, c.threshold) for c in rule) for rule in learn_decision_list(df, ["a", "b"])]
    assert len(want) >= 2 and got == want


def test_shards_are_a_uniform_shuffle(spark):
    """Where a row comes from tells nothing of its shard, its place there, or of where its neighbour goes."""
    n, shards = 6000, 6
    docs = spark.range(n, numPartitions=5).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    at = {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(docs, shards, rows_per_block=300).collect()}
    table = np.zeros((10, shards))
    for i, (shard, _) in at.items():
        table[i * 10 // n, shard] += 1
    assert ((table - n / 10 / shards) ** 2 / (n / 10 / shards)).sum() < 85  # chi-square of 45 degrees: 85 at 3e-4
    slot = np.array([at[i][1] for i in range(n)])
    assert abs(np.corrcoef(np.arange(n), slot)[0, 1]) < 0.05
    together = np.mean([at[i][0] == at[i + 1][0] for i in range(n - 1)])
    assert abs(together - 1 / shards) < 0.025
    near = np.mean([at[i][0] == at[i + 1][0] and abs(at[i][1] - at[i + 1][1]) <= 10 for i in range(n - 1)])
    assert near < 0.01  # by chance: 1 / 6 * 20 / 1000


def test_discriminant_separates():
    rng = np.random.default_rng(0)
    x0, x1 = rng.normal(0, 1, (500, 3)), rng.normal([2, 0, 0], [1, 3, 1], (500, 3))
    moments = {k: (len(x), x.sum(axis=0), x.T @ x) for k, x in ((0, x0), (1, x1))}
    m = quality_qda.fit(moments)
    assert (m.score(x0) < 0.5).mean() > 0.8 and (m.score(x1) > 0.5).mean() > 0.8


def test_languages(spark, empty):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    rows = [(i, make("abcdef" if i % 2 else "uvwxyzé"), "xx" if i % 2 else "yy") for i in range(200)] + [(900, None, "xx"), (901, "12 !?", "xx"), (902, "", None), (903, "ЖЖ ж", None)]
    got = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == ("xx" if i % 2 else "yy") for i in range(200))
    assert all(got[i]["lang_pred"] == "und" for i in (900, 901, 902)) and got[903]["lang_pred"] in ("xx", "yy")
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert identify_languages(empty).count() == 0


def test_languages_by_brute_force(spark):
    """With all learnt rows as landmarks the scores are those of kernel ridge regression on sets of n-grams."""
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=4)) for _ in range(8))
    rows = [(i, make(("abcdef", "defghi")[i % 2]), ("xx", "yy")[i % 2]) for i in range(40)] + [(50, "abc def " * 20_000, None), (51, "abc", None), (51, "abc", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = defaultdict(set)
    for r in identify_languages(df, n_landmarks=200).collect():
        got[r["doc_id"]].add((r["lang_pred"], round(r["score"], 3)))

    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in t)
        return {s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1) if s[k : k + n].strip()}

    train = [(grams(t), "xy".index(y[0])) for i, t, y in rows if y and zlib.crc32(str(i).encode()) % 4 != 2]
    known = set.union(*(g for g, _ in train))
    kernel = lambda a, b: len(a & b & known) / math.sqrt(max(len(a & known), 1) * max(len(b & known), 1))
    k = np.array([[kernel(a, b) for b, _ in train] for a, _ in train])
    value, vector = np.linalg.eigh(k)
    keep = value > 1e-6 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    phi = np.column_stack([k @ white, np.ones(len(train))])
    y = np.array([b for _, b in train])
    w = (len(y) / 2 / np.bincount(y))[y][:, None]
    beta = np.linalg.solve(phi.T @ (phi * w) + np.eye(phi.shape[1]), phi.T @ (np.eye(2)[y] * w))
    for i, t, _ in rows:
        f = np.append(np.array([kernel(grams(t), b) for b, _ in train]) @ white, 1) @ beta
        (lang, score), = got[i]
        assert lang == "xx yy".split()[int(f.argmax())] and abs(score - min(1, max(0, f.max()))) < 2e-3, (i, f, score)


def test_kernel_is_presence():
    symbol = langid.alphabet(langid.letters("abab") + langid.letters("bcd"))
    s = langid.spectrum(symbol, [langid.present(symbol, t) for t in ("abab", "bcd")])
    x, letter = s.presence(["ab", "abab", "..", "ABAB"])
    assert list(letter) == [True, True, False, True]
    assert np.allclose(x[1], x[3]) and 0 < x[0] @ x[1] < 1 and not x[2].any()


def test_clauses():
    g = toxicity.Grammar()
    events = lambda t: {toxicity.EVENTS[i] for i, n in enumerate(g.events(t)) if n}
    assert events("you are an idiot") == {("insult", True, False, False)}
    assert events("you are not an idiot") == {("insult", True, True, False)}
    assert events("he said you are an idiot. fine day") == {("insult", True, False, True)}
    assert events("I will destroy the sandwich") == set() and events("I will destroy you") == {("threat", True, False, False)}
    assert events("the idiots' guide, or idiotic") == set() and events(None) == set()
    score = lambda t: g.score(g.events(t))[0]
    assert score("you idiot") > score("an idiot there") > score("not an idiot there") > score("a fine day")


def brute_events(text, stems):
    """Events of each clause by looking around each word, without an automaton."""
    out = defaultdict(int)
    for clause in re.split(r"[.,;:!?\n]", (text or "").lower()):
        w = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
        kind = [toxicity._FIXED.get(x) or max((c for st, c in stems.items() if x.startswith(st)), default=toxicity.OTHER) for x in w]
        for j, c in enumerate(kind):
            if c in toxicity._KIND:
                aimed = toxicity.TARGET in kind[max(0, j - 5) : j] + kind[j + 1 : j + 6]
                if c != toxicity.THREAT or aimed:
                    out[toxicity._KIND[c], aimed, toxicity.NEGATION in kind[max(0, j - 3) : j], toxicity.REPORT in kind[:j]] += 1
    return dict(out)


def test_events_by_brute_force():
    rng = random.Random(8)
    g = toxicity.Grammar({"zorb": toxicity.SURE, "quix": toxicity.HINT, "quixo": toxicity.MARK})
    vocabulary = ["you", "idiot", "kill", "not", "said", "zorbing", "quixe", "tree", "walk", "du", "basura", "nicht", "ils", "trottel", "a", "b", "c", "idiots", "zor"]
    for _ in range(400):
        text = "".join(rng.choice(vocabulary) + rng.choice((" ", " ", " ", ", ", ". ", "\n")) for _ in range(rng.randint(0, 25)))
        assert {toxicity.EVENTS[i]: int(n) for i, n in enumerate(g.events(text)) if n} == brute_events(text, g.stems), text
    assert g.events("word " * 100_000 + "you idiot").sum() == 1


def test_toxicity_of_repeated_and_long_rows(spark, labels):
    rows = [(1, "you idiot"), (1, "you idiot"), (2, "fine " * 50_000 + "you idiot"), (None, "you idiot"), (3, "")]
    got = sorted(((r["doc_id"] or 0), r["n_events"]) for r in toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 0)]


def test_toxicity_learns_stems(spark, empty, labels):
    rng = random.Random(7)
    rows = [(i, prose(60, rng) + (f" zorb{rng.choice(WORDS)} " if i % 3 == 0 else " ") + prose(60, rng)) for i in range(300)]
    marked = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(spark.createDataFrame([*rows, (999, None)], "doc_id long, text string"), marked).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert held and all(got[i]["predicted"] == int(i % 3 == 0) for i in held if i < 300) and got[999]["predicted"] == 0
    assert toxicity_scores(empty, labels).count() == 0


def test_toxicity_on_held_out_rows(spark):
    """At least nine tenths of the toxic rows of the held-out fold, and next to no clean one; seven have no word that marks them."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out if r["toxic"] is not None}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n.get((0, 1), 0) <= 0.005 * n[0, 0]


def test_items_with_few_plain_words_are_found_with_other_values(spark):
    """An item with one or two plain words is one template; without a plain word, or under four words, it is found as it stands only."""
    items = [(1, "Compute 12 plus 7 km"), (2, "12 km 7 km"), (3, "Add 5 kg"), (4, "Convert 3 km 5 km 9 km 12 km 44 km 8 kg")]
    texts = {
        10: "please compute 31 plus 9 km and stop", 11: "please compute 31 minus 9 km", 12: "we saw 30 km 8 km there", 13: "we saw 12 km 7 km there", 14: "now add 6 kg of it", 15: "now add 5 kg of it",
        16: "now convert 1 km 2 km 3 km 4 km 6 km 7 kg today", 17: "now convert 1 km 2 km 3 km 4 km 6 mile 7 kg today", 18: None, 19: "compute 12 plus 7 km",
    }
    found = find_contamination(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["changed"]) for r in found.collect()} == {(10, 1, True), (13, 2, False), (15, 3, False), (16, 4, True), (19, 1, False)}


def test_a_thousand_items_of_equal_text_are_one(spark):
    """They are looked for once: rows with their windows do not grow with their number, and each id is in the result."""
    rng = random.Random(12)
    text = prose(25, rng)
    docs_ = spark.createDataFrame([(i, f"{prose(10, rng)} {text} {prose(10, rng)}" if i % 3 == 0 else prose(40, rng)) for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text) for i in range(1000)] + [(5000, prose(25, rng)), (7, "another text of this very id here"), (None, text)], "item_id long, text string")
    got = {r["doc_id"]: r["n_items"] for r in decontaminate(docs_, items).collect()}
    assert got == {i: 1000 if i % 3 == 0 else 0 for i in range(30)}
