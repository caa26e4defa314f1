"""Near-duplicates of the pipeline against brute-force Jaccard."""

import random

import numpy as np
import pytest

import corpus_pipeline
from evidex.llm import similar
from tests.llm.test_simhash import key, smallest_reachable


def plain_shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_components(rows, similarity=0.8):
    sets = [plain_shingles(t) for _, t in rows]
    near = np.array([[len(a & b) >= similarity * len(a | b) - 1e-9 for b in sets] for a in sets])
    return smallest_reachable([i for i, _ in rows], near)


def copies(seed, n, changes):
    """``n`` copies of one text of 120 words, each with words replaced at places of its own."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(120), changes):
            own[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def near():
    texts = [t for seed, changes in enumerate((0, 1, 2, 3, 4, 5)) for t in copies(seed, 15, changes)]
    return list(enumerate(texts, start=1))


def test_near_duplicates_match_brute_force_jaccard(spark, mixed, near):
    docs = mixed.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string").selectExpr("doc_id + 5000000 AS doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(d, c) for (d, _), c in zip(rows, plain_components(rows), strict=True)]
    found = similar.near_duplicates(docs)
    got = [(r.doc_id, r.component_id) for r in found.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_bounds_of_sample_and_blocks_change_nothing(spark, near, monkeypatch):
    docs = spark.createDataFrame(near, "doc_id long, text string").repartition(5)
    want = sorted((d, c) for (d, _), c in zip(near, plain_components(near), strict=True))
    for bounds in ({"BLOCK": 2, "KEPT": 3}, {"SAMPLE": 1, "ORDERS": 1}):
        for name, value in bounds.items():
            monkeypatch.setattr(similar, name, value)
        assert sorted((r.doc_id, r.component_id) for r in similar.near_duplicates(docs).collect()) == want


def test_stage_drops_near_copies_of_more_than_four_bits(spark, near):
    docs = spark.createDataFrame(near, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    want = {c for c in plain_components(near)}
    assert {r.doc_id for r in kept.collect()} == want and len(want) < len(near)
    assert len({r.doc_id for r in kept.collect() if 15 < r.doc_id <= 30}) == 1  # one changed word each


def test_stage_takes_pairs_from_simhash_trees(spark, near, monkeypatch):
    docs = spark.createDataFrame(near, "doc_id long, text string")
    rows = similar.named(docs).cache()
    fps = {r.node: r.fp & (1 << 64) - 1 for r in rows.collect()}
    close = {frozenset((a, b)) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4}
    got = {frozenset((r.a, r.b)) for r in similar.near_fingerprints(rows).collect()}
    # Stars: each pair lies within the radius, and each set that has a partner is in a pair.
    assert got <= close and len(got) > 10
    assert {x for p in got for x in p} == {x for p in close for x in p}
    asked = []
    own = similar.near_fingerprints
    monkeypatch.setattr(similar, "near_fingerprints", lambda rows: asked.append(1) or own(rows))
    corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert asked


def test_full_shingles_lose_no_pair(spark, near, monkeypatch):
    docs = spark.createDataFrame(near, "doc_id long, text string").repartition(5)
    want = sorted((d, c) for (d, _), c in zip(near, plain_components(near), strict=True))
    for few in (0, 2, 1 << 20):
        monkeypatch.setattr(similar, "FEW", few)
        assert sorted((r.doc_id, r.component_id) for r in similar.near_duplicates(docs).collect()) == want


def test_pairs_of_a_family_of_unlike_copies_grow_with_its_size(spark, monkeypatch):
    met = []
    own = similar._possible
    monkeypatch.setattr(similar, "_possible", lambda pairs, *rest: met.append(pairs.count()) or own(pairs, *rest))
    for n in (40, 160):
        docs = spark.createDataFrame(list(enumerate(copies(7, n, 3))), "doc_id long, text string")
        assert similar.near_duplicates(docs).filter("kept").count() > 0.95 * n  # three changed words: similarity about 0.6
        assert met.pop() <= 8 * n  # the second round; all pairs would be n * (n - 1) / 2


def test_lone_shingles_are_written_nowhere(spark, monkeypatch):
    written = []
    own = similar.cut_lineage
    monkeypatch.setattr(similar, "cut_lineage", lambda df: written.append(own(df)) or written[-1])
    texts = [t for seed in range(30) for t in copies(seed, 1, 0)]  # nothing in common
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similar.near_duplicates(docs).filter("kept").count() == 30
    with_shingles = [df for df in written if "h" in df.columns]
    assert with_shingles and sum(df.count() for df in with_shingles) == 0
