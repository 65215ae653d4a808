"""Phrases, ranked search and mixing against brute force and SQL, on small fixtures with awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fenbrook.llm import lexical
from fenbrook.llm.lexical import ranked_search
from fenbrook.llm.mixing import mix_sources, source_targets
from fenbrook.llm.phrases import Summary, collocations
from fenbrook.llm.queries import ORACLE, QUERIES

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key string, rank int, score long, size int, q int, n int"
NEW = ("op11_phrase_collocations", "op12_lexical_search", "op13_source_mixing")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 0, 1, "k", 1, 2, 3, 4, 5) for i, t, g, s in rows], SCHEMA)


def awkward():
    rng = random.Random(5)
    few = ["the", "of", "Zürich", "a", "New", "york", "中文", "x\x00y", "don't", " odd"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(few) + rng.choice([" ", " ", " ", " \t ", ". ", "\n", ", "]) for _ in range(rng.randint(0, 80)))
        rows.append((i, text, ("en", None, "und", "de")[i % 4], f"s{i % 5}"))
    rows += [(900, None, "en", None), (901, "", "en", None), (902, " \n\t ", None, "s1"), (903, "..!?", "de", "s9"), (None, "new york new york", "en", None), (None, "new york new york", "en", None), (904, "THE of " * 3000, "en", "s0"), (904, "THE of " * 3000, "en", "s0")]
    rows += [(1000 + i, "same words in every copy of the text", "fr", "copies") for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).repartition(5).persist()


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = db.sql(ORACLE[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    assert got and got == sorted(repr([plain(x[i]) for i in at]) for x in want.fetchall())


@pytest.mark.parametrize("name", NEW)
def test_no_rows_give_no_rows(spark, name):
    none = frame(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    out = {"op11_phrase_collocations": lambda: collocations(none), "op12_lexical_search": lambda: ranked_search(none, items), "op13_source_mixing": lambda: mix_sources(none)}[name]()
    assert out.collect() == []


# --- phrases ---


def brute_phrases(rows, least, longest=4, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows_ = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in cand.items()):
                continue
            score, _, left, right = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            rows_.append((-score, -a, " ".join(g).encode(), " ".join(g), a, left, right))
        rows_.sort()
        out += [(lang, i + 1, p, a, le, r, n[lang], -s) for i, (s, _, _, p, a, le, r) in enumerate(rows_[:top])]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "held"), [(4 << 20, 3_000_000), (600, 400)])
def test_phrases_are_those_of_brute_force(docs, chunk, held):
    """Also with chunks of a few hundred bytes, so that summaries are merged many times and texts are cut at piece ends."""
    got = sorted(tuple(r) for r in collocations(docs, least=30, chunk_bytes=chunk, held_sums=held).collect())
    assert got == brute_phrases(awkward(), 30) and len({r[0] for r in got}) >= 2
    few = sorted(tuple(r) for r in collocations(docs, least=7, top=5, bits=16, bucket_bytes=500, chunk_bytes=chunk, held_sums=held).collect())
    assert few == brute_phrases(awkward(), 7, top=5) and len({r[0] for r in few}) == 4  # a crowded bit map changes nothing


def test_every_frequent_key_survives_any_merge_order():
    """Capacity above mass / least: no counter loses ``least``, whatever the parts and their order."""
    rng = np.random.default_rng(3)
    for least in (5, 30):
        keys = np.concatenate([rng.zipf(1.3, 20_000) % 4000, np.repeat(np.arange(50), least)]).astype(np.uint32)
        rng.shuffle(keys)
        s = Summary(len(keys) // least + 1)
        for part in np.array_split(keys, 23):
            s.merge(*np.unique(part, return_counts=True))
            assert len(s.keys) <= s.capacity
        k, c = np.unique(keys, return_counts=True)
        assert s.lost < least and set(k[c >= least]) <= set(s.may_reach(least).tolist())


# --- search ---


def brute_search(rows, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(find(t))) for i, t, *_ in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        q, found = Counter(find(text)), []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in q.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    pick = lambda n: " ".join(words[min(299, int(rng.paretovariate(0.7)))] for _ in range(n))
    rows = [(i, pick(rng.randint(1, 120)), "en", "s") for i in range(700)] + awkward()
    rows += [(2000 + i, rows[3][1], "en", "s") for i in range(40)]
    items = [(i, pick(rng.randint(1, 30))) for i in range(40)] + [(100, None), (101, ""), (102, "zzz"), (103, "The OF the"), (104, "Zürich 中文"), (105, rows[3][1])]
    return rows, items


@pytest.mark.parametrize(("focus", "bucket", "block"), [(0.95, 64, 4 << 20), (0.3, 16, 2000), (1.0, 1000, 4 << 20)])
def test_search_is_the_full_product(spark, prose, focus, bucket, block):
    rows, items = prose
    q = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, q string, score int")
    got = ranked_search(frame(spark, rows).repartition(4), q, focus=focus, bucket_rows=bucket, block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(rows, items)


def test_bounds_leave_pairs_out(prose):
    """The focus bound refuses most pairs that cannot reach the k-th score, and none that can."""
    rows, items = prose
    vocabulary = {}
    counts = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in lexical.terms(t.encode() if t else None)) for _, t in items]
    weights = np.full(len(vocabulary), 1000, np.int64)
    q = lexical.Queries(counts, weights, 0.95)
    own = [sorted(Counter(v for t in lexical.terms((t or "").encode()) if (v := vocabulary.get(t)) is not None).items()) for _, t, *_ in rows]
    ends = np.cumsum([0] + [len(x) for x in own])
    flat, impacts = (np.array([y[j] for x in own for y in x], np.int64) for j in (0, 1))
    norms = np.array([math.sqrt(sum(c * c * 1000 for _, c in x)) for x in own])
    bucket = lexical.Bucket(np.arange(len(own)), norms, ends, flat, impacts, len(vocabulary))
    exact = np.array([[sum(1000 * counts[j].get(t, 0) * c for t, c in x) for j in range(len(items))] for x in own], np.float64)
    least = np.sort(exact, axis=0)[-10]
    part = np.nonzero(q.norm > 0)[0]
    ((part, columns, value, mark),) = q.groups(part)
    row, place = bucket.survivors(q, columns, value, mark, part, least)
    seen = set(zip(row.tolist(), part[place].tolist(), strict=True))
    want = {(r, j) for j in part for r in np.nonzero(exact[:, j] >= least[j])[0]}
    assert want <= seen and len(seen) < 0.5 * len(own) * len(part)
    for j in part[:5]:
        assert (bucket.score(np.arange(len(own)), q.terms[j], q.coef[j]) == exact[:, j]).all()


# --- mixing ---


def fill(sizes, weights, share, most):
    """Targets by sharing the excess again and again."""
    target, free, rest = {}, set(sizes), share * sum(sizes.values())
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / w > most * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / w for s in free}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "B", "a", "é", "中"] + [f"s{i}" for i in range(rng.randint(0, 9))]
    sizes = {n: rng.choice([0, 1, 10, 500, 9000]) * rng.randint(1, 9) for n in names}
    order = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weights = {n: (3, 1, 2)[i % 3] for i, n in enumerate(order)}
    df = source_targets(spark.createDataFrame(list(sizes.items()), "source string, total long"), (3, 1, 2), 1.5, 2.0)
    got = {r["source"]: r["target"] for r in df.collect()}
    want = fill(sizes, weights, 1.5, 2.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_mix_meets_targets_by_whole_epochs(docs):
    rows = mix_sources(docs, rows_per_block=5).collect()
    want = Counter(repr((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))) for i, t, *_ in awkward())
    assert Counter(repr((r["doc_id"], r["size"])) for r in rows) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source_size"], r["target"]].append(r)
    assert math.isclose(sum(t for _, t in by), 1.5 * sum(r["size"] for r in rows))
    for (size, target), own in by.items():
        assert sum(r["size"] for r in own) == size
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-9
        epochs = {r["taken"] // r["size"] for r in own if r["size"]}
        assert epochs <= {int(target // size), int(target // size) + 1} if size else True
    again = mix_sources(docs.repartition(3), rows_per_block=1000).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))  # blocks and partitions change nothing


def test_heavier_documents_come_more_often(spark):
    """The first of the order is drawn in proportion to the weights."""
    from pyspark.sql import functions as F

    rows = frame(spark, [(i, "one two", "en", "a") for i in range(4000)])
    out = mix_sources(rows, weights=(1,), share=0.25, quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).where("taken > 0")
    even, n = out.where("doc_id % 2 = 0").count(), out.count()
    assert n == 1000 and 0.72 < even / n < 0.82  # x^4 + x = 1.5 gives 0.77
