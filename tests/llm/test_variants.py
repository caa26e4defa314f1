"""Spelling variants against all pairs, and the index against plain comparison."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    short, long = sorted((a, b), key=len)
    return long[i + 1 :] == short[i:]


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(n):
    near = {w: [] for w in n}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        for size in (len(w), len(w) + 1):
            for v in by_length.get(size, ()):
                if (size > len(w) or v > w) and one_edit(w, v):
                    near[w].append(v)
                    near[v].append(w)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def test_searches_find_all_of_one_error():
    rng = random.Random(3)
    for letters in ("ab", "aéz", "abcdefgh"):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(150)})
        index = variants.BidirectionalIndex(words)
        for side in (0, 1):
            row, word = index.search(np.arange(len(words)), side)
            want = set()
            for i, a in enumerate(words):
                cut = len(a) // 2
                for j, b in enumerate(words):
                    agree = a[:cut] == b[:cut] if side == 0 else b.endswith(a[cut:])
                    if agree and one_edit(a, b):
                        want.add((i, j))
            assert set(zip(row.tolist(), word.tolist(), strict=True)) == want


def test_given_texts(spark, mixed, rows):
    want = plain_variants(plain_words([(d, t) for d, t, _ in rows]))
    found = variants.variants(mixed)
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(r[3] for r in want) and max(r[2] for r in want) > 1


@pytest.fixture(scope="module")
def crowded():
    """Words under few halves, with counts that make chains of forms and ties."""
    rng = random.Random(9)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 11))) for _ in range(500)}
    words |= {"stammwort" + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 5))) for _ in range(80)}
    words |= {"größe" + c + "ÄÖ" for c in "abcdeé"}
    return [(w, rng.choice([5, 5, 6, 25, 30, 130, 700, 4000])) for w in sorted(words)]


@pytest.mark.parametrize("block", [5, 60, 4096])
def test_blocks_change_nothing(spark, crowded, block, monkeypatch):
    monkeypatch.setattr(variants, "vocabulary", lambda docs: docs)
    monkeypatch.setattr(variants, "POSTINGS", 700)
    want = plain_variants(dict(crowded))
    got = [tuple(r) for r in variants.variants(spark.createDataFrame(crowded, "word string, n long"), block).collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(r[2] for r in want) > 5 and any(r[5] != r[3] for r in want if r[3])


def test_defined_cases(spark):
    texts = [(1, "Häuser häuser Häuser häUser häuser HÄUSER"), (None, "abcdefg " * 6), (2, None), (2, ""), (2, "x" * 9000 + " ") , (3, "kurz " * 9)]
    texts += [(i, "x" * 9000 + " " + "x" * 8999) for i in range(10, 16)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("word", "n", "key", "root", "run", "h")})
    got = {tuple(r) for r in variants.variants(df).collect()}
    assert got == plain_variants(plain_words(texts))
    assert {r[0] for r in got} >= {"häuser", "abcdefg", "x" * 9000}
    assert variants.variants(df.filter("false")).count() == 0
