"""The pipeline's stages against brute force, and the guard of the entry point."""

import subprocess
import sys
from pathlib import Path

from ..conftest import SF
from .test_contracts import brute_cut, brute_near, words

ROOT = Path(__file__).resolve().parents[2]


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = list(p.COLUMNS)
    good = p.pass_quality_rules(spark, docs, SF).persist()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert good.columns == columns and 0 < len(rows) < docs.count()
    assert all(len(words(t)) >= 50 for _, t in rows)

    single = p.drop_near_duplicates(spark, good, SF).persist()
    want = {i for i, (_, top) in brute_near(rows, 5).items() if i == top}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == columns

    rows = [r for r in rows if r[0] in want]
    cut = p.cut_repeated_passages(spark, single, SF).persist()
    expected = brute_cut(rows)
    got = {r["doc_id"]: r for r in cut.collect()}
    assert set(got) == want and cut.columns == columns
    for i, (size, removed, _, _) in expected.items():
        assert size - removed - 3 <= len(got[i]["text"].encode()) <= size - removed and (not removed or got[i]["n_chars"] == len(got[i]["text"]))

    clean = p.drop_contaminated(spark, cut, SF).persist()
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [" ".join(r["text"].split()) for r in clean.collect()]
    assert clean.columns == columns and not any(i in t for i in items for t in left)

    packed = p.pack_sequences(spark, clean, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()}
    assert sorted(map(tuple, p.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_stages_take_awkward_rows(spark):
    """Repeated rows, nulls in any column, other columns and no rows at all."""
    import corpus_pipeline as p
    from .test_contracts import prose, random

    rng = random.Random(1)
    text = prose(80, rng)
    rows = [(1, text, None, None, None, "x"), (1, text, None, None, 7, "x"), (1, text, None, None, None, "x"), (None, text, "en", "s", 1, None), (2, None, "en", "s", None, "y"), (3, "", None, "s", 0, "y"), (4, prose(5000, rng), "en", "s", 0, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for some, want in ((rows, {1, 4}), ([], set())):
        docs = spark.createDataFrame(some, schema)
        for _, step in p.STAGES[:-1]:
            docs = step(spark, docs, SF).persist()
            assert docs.columns == list(p.COLUMNS)
        assert sorted(r["doc_id"] or 0 for r in docs.collect()) == sorted(want)
        assert {r["doc_id"] or 0 for r in p.STAGES[-1][1](spark, docs, SF).collect()} == want


def test_rows_without_an_id_of_their_own_stay(spark):
    """Unrelated texts under one id, and texts without an id: each has its own verdict in every stage."""
    import corpus_pipeline as p
    from .test_contracts import prose, random

    rng = random.Random(2)
    texts = [prose(90, rng) for _ in range(6)]
    item = " ".join(spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"].split())
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (1, "too short"), (None, "short too"), (7, texts[4]), (None, texts[4]), (1, f"{texts[5]} {item}"), (None, f"{item} {texts[5]}")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in p.STAGES[:-1]:
        docs = step(spark, docs, SF).persist()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in docs.collect()) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (0, texts[3]), (7, texts[4])])
    assert p.STAGES[-1][1](spark, docs, SF).count() == 5


def test_entry_works_without_this_part(tmp_path):
    for f in ROOT.rglob("*.py"):
        rel = f.relative_to(ROOT)
        if "llm" in rel.parts or rel.name == "corpus_pipeline.py":
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(f.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'customer_360' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
