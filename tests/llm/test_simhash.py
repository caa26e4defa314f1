import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from evidex.llm import simhash
from evidex.llm.common import block_pairs, components


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for gram in grams:
        h = xxhash.xxh64_intdigest(gram.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(grams))


def smallest_reachable(ids, linked):
    """linked: boolean matrix; ids may hold None."""
    big = 1 << 62
    label = np.array([big if i is None else i for i in ids])
    while True:
        new = np.array([min(label[row].min(), own) for row, own in zip(linked, label, strict=True)])
        if (new == label).all():
            return [None if x == big else int(x) for x in label]
        label = new


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def test_near_duplicates_match_brute_force(mixed, rows):
    found = simhash.near_duplicates(mixed)
    assert found.columns == ["doc_id", "fingerprint", "component_id", "kept"]
    fps = np.array([plain_fingerprint(t) for _, t, _ in rows], dtype=np.uint64)
    ids = [d for d, _, _ in rows]
    labels = smallest_reachable(ids, np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = [(d, f"{f:016x}", c) for d, f, c in zip(ids, fps.tolist(), labels, strict=True)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in found.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_keep_one_leaves_one_of_each_group(mixed):
    kept = simhash.keep_one(mixed)
    assert kept.columns == mixed.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and len(ids) - len(named) == 2
    assert 900004 in named and 900005 not in named


def test_empty_table(mixed):
    none = mixed.filter("false")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 400), dtype=np.uint64))
    values = np.unique(np.r_[centres, centres[rng.integers(0, 40, 400)] ^ flips])
    group = rng.integers(0, 3, len(values))
    forest = simhash.Forest(values, group)
    got = {(int(q), int(f)) for a, b in forest.search(values, group, 4) for q, f in zip(a, b, strict=True)}
    near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 4) & (group[:, None] == group[None, :])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}


@pytest.mark.parametrize("tree_rows", [7, 4096])
def test_links_do_not_depend_on_the_block_size(spark, tree_rows):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2, 200), dtype=np.uint64))
    fps = np.unique(base[rng.integers(0, 6, 200)] ^ flips).view(np.int64)
    links = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), tree_rows=tree_rows)
    root = {r.node: r.root for r in components(links).collect()}
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 4
    label = smallest_reachable(fps.tolist(), near)
    assert [root.get(x, x) for x in fps.tolist()] == label


def test_blocks_pair_every_two_rows_once(spark):
    df = spark.createDataFrame([("a", i) for i in range(25)] + [("b", i) for i in range(3)], "g string, i long")
    rows = block_pairs(df, ["g"], df.i, 6).collect()
    meets = {}
    for r in rows:
        meets.setdefault((r.g, r.lo, r.hi), []).append((r.i, r.side))
    pairs = []
    for (g, _, _), own in meets.items():
        for (a, x), (b, y) in combinations(sorted(own), 2):
            if x == y == 2 or {x, y} == {0, 1}:
                pairs.append((g, a, b))
    want = [("a", a, b) for a, b in combinations(range(25), 2)] + [("b", a, b) for a, b in combinations(range(3), 2)]
    assert sorted(pairs) == want


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(1000, 1100)]
    other = [(7, 7), (None, 3), (9, None), (-4, -9), (-9, -4), (42, 41), (41, 40), (40, 42)]
    edges = spark.createDataFrame(chain + star + other, "a long, b long")
    root = {r.node: r.root for r in components(edges).collect()}
    assert all(root[i] == 100 for i in range(100, 161))
    assert root[5] == 5 and all(root[i] == 5 for i in range(1000, 1100))
    assert root[-4] == root[-9] == -9 and root[42] == root[41] == root[40] == 40
    assert not {7, 3, 9} & set(root)
    assert components(edges.filter("false")).count() == 0
