"""Substring deduplication, decontamination, license scan: against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from evidex.llm import decontaminate, licenses, substring


def plain_removal(rows, window=13):
    big = 1 << 63
    words = [(t or "").encode().split() for _, t, _ in rows]
    ids = [big if d is None else d for d, _, _ in rows]
    least = {}
    for i, own in zip(ids, words, strict=True):
        for j in range(len(own) - window + 1):
            gram = tuple(own[j : j + window])
            least[gram] = min(least.get(gram, big), i)
    out = []
    for (d, _, _), i, own in zip(rows, ids, words, strict=True):
        gone = [False] * len(own)
        for j in range(len(own) - window + 1):
            if least[tuple(own[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out.append((d, len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group_bytes", [substring.GROUP_BYTES, 40_000])
def test_repeats_match_brute_force(mixed, rows, group_bytes):
    found = substring.remove_repeats(mixed, group_bytes=group_bytes)
    got = [
        (r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest(), r.spans)
        for r in found.collect()
    ]
    assert Counter(g[:4] for g in got) == Counter(plain_removal(rows))
    assert all(sum(b - a for a, b in g[4]) == g[2] for g in got)
    assert sum(g[2] for g in got) > 1000


def test_digest_query_columns(mixed):
    none = substring.digests(mixed.filter("false"))
    assert none.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert none.count() == 0


def test_passages_across_and_within_documents(spark):
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}" for i in range(30)])

    def text(n):
        return " ".join(vocabulary[rng.integers(0, 30, n)])

    passage = [text(n) for n in (13, 14, 60, 12)]
    rows = [(i, " ".join([text(20), passage[i % 4], text(15), passage[(i // 4) % 4], text(9)]), "en") for i in range(60)]
    rows += [(100, f"{passage[2]} {passage[2]} {passage[2]}", "en"), (101, passage[0], "en"), (101, passage[1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for group_bytes in (1 << 22, 1500):
        got = substring.remove_repeats(docs, group_bytes=group_bytes).collect()
        found = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got)
        assert found == Counter(plain_removal(rows))


def test_wavelet_rank():
    rng = np.random.default_rng(2)
    for sigma in (1, 2, 5, 200):
        s = rng.integers(0, sigma, 777)
        wavelet = substring.Wavelet(s, sigma)
        symbol, at = rng.integers(0, sigma, 300), rng.integers(0, 778, 300)
        want = [(s[:p] == c).sum() for c, p in zip(symbol, at, strict=True)]
        assert wavelet.rank(symbol, at).tolist() == want


def test_matching_statistics():
    rng = np.random.default_rng(5)
    sequence = np.r_[rng.integers(1, 4, 300), 0, rng.integers(1, 4, 200), 0]
    index = substring.FMIndex(sequence, 4, 6)
    ends = np.array([e for e in range(5, 500) if 0 not in sequence[e - 5 : e + 1]])
    length, low, high = index.search(sequence, ends, 6)

    def times(part):
        return sum(np.array_equal(sequence[i : i + len(part)], part) for i in range(len(sequence)))

    for e, n, lo, hi in zip(ends, length, low, high, strict=True):
        want = max((m for m in range(1, 7) if times(sequence[e - m + 1 : e + 1]) > 1), default=0)
        assert n == want
        if n == 6:
            assert hi - lo == times(sequence[e - 5 : e + 1])


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pattern = "".join(rng.choice(list("abc"), rng.integers(1, 90)))
        text = "".join(rng.choice(list("abc"), rng.integers(0, 120)))
        want = edit_distance_within(pattern, text)
        assert decontaminate.best_match(pattern, text, 90) == want
        assert decontaminate.best_match(pattern, text, want[0] - 1) is None


def plain_hits(text, items):
    out = set()
    text = decontaminate.normal(text)
    for i, item in items:
        item = decontaminate.normal(item)
        if item and i is not None and edit_distance_within(item, text)[0] <= int(decontaminate.ERROR_RATE * len(item)):
            out.add(i)
    return sorted(out)


def test_contamination_matches_brute_force(spark, tables):
    rng = np.random.default_rng(7)
    items = [(r.item_id, r.text) for r in tables["benchmark"].limit(12).collect()]
    base = [r.text[:250] for r in tables["documents"].limit(12).collect()]
    rows = []
    for n, ((_, item), own) in enumerate(zip(items, base, strict=True)):
        for edits in (0, 3, len(item) // 17, len(item) // 8):
            changed = list(item)
            for at in rng.integers(0, len(item), edits):
                changed[at] = rng.choice(["", "zq", "#"])
            rows.append((len(rows), own + "\n " + "".join(changed).upper().replace(" ", "\n") + own[:50]))
        rows.append((1000 + n, own))
    rows += [(None, items[0][1]), (2000, None), (2001, ""), (2002, "Yes."), (2003, "yes")]
    items += [(None, base[0]), (500, None), (501, "  "), (502, "yes."), (503, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS hits", "1 AS begin")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS hits")
    for block in (decontaminate.BLOCK_CHARS, 1000):
        got = {r.doc_id: r for r in decontaminate.report(docs, bench, block=block).collect()}
        for d, text in rows:
            assert got[d].item_ids == plain_hits(text, items), d
            assert got[d].contaminated == bool(got[d].item_ids)
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, t in rows if not plain_hits(t, items)}
    assert decontaminate.report(docs, bench.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.report(docs.filter("false"), bench).count() == 0


def test_contamination_of_whole_and_awkward_texts(mixed, rows, tables):
    items = [(r.item_id, decontaminate.normal(r.text)) for r in tables["benchmark"].collect()]
    got = Counter((r.doc_id, r.contaminated) for r in decontaminate.report(mixed, tables["benchmark"]).collect())
    want = Counter((d, any(i in decontaminate.normal(t) for _, i in items)) for d, t, _ in rows)
    assert got == want


LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
}


def test_license_lines_of_the_given_documents(mixed, rows):
    got = Counter((r.doc_id, tuple(r.licenses)) for r in licenses.report(mixed).collect())
    want = Counter((d, tuple(sorted({n for s, n in LINES.items() if s in (t or "")}))) for d, t, _ in rows)
    assert got == want


def test_notices_with_changed_wording():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES[1][1]
    found = scanner.scan("intro words\n\n" + mit.replace("Software", "Program", 2).replace(". ", ".\n") + "\n\nmore")
    assert [f["license"] for f in found] == ["MIT"]
    assert found[0]["n_different"] == 2 and found[0]["added"] == ["program", "program"]
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0-or-later")
    best = min(scanner.scan(gpl), key=lambda f: f["n_different"])
    assert (best["license"], best["n_different"]) == ("GPL-3.0-or-later", 0)
    for clean in ("", "a licence to drive", "Permission was granted by the mayor.\nNo warranty at all.", "x " * 50_000):
        assert scanner.scan(clean) == []
    assert licenses.Scanner([]).scan("Released under the MIT License.") == []


def test_each_template_with_changed_words_gives_its_own_name_or_none():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = np.random.default_rng(8)
    for (name, text), (needed, _) in zip(licenses.TEMPLATES, scanner.telling, strict=True):
        spans = licenses.words(text)
        budget = int(licenses.DIFFERENT * len(spans))
        for changes in (0, 1, budget, len(spans) // 3 + 1):
            at = rng.choice(len(spans), changes, replace=False)
            own = text
            for i in sorted(at, reverse=True):
                own = own[: spans[i][1]] + "changed" + own[spans[i][2] :]
            found = {f["license"] for f in scanner.scan("some text before\n" + own)}
            assert found <= {name}, (name, found)
            if changes <= budget and not needed & {spans[i][0] for i in at}:
                assert found == {name}, (name, changes)


NEAR = [
    ("version 3 of", "version 2 of", "GPL-3.0-or-later"), ("General Public", "Lesser General Public", "GPL-3.0-or-later"),
    ("General Public", "Affero General Public", "GPL-3.0-or-later"), ("version 3 of", "version 4 of", "GPL-3.0-or-later"),
    ("Lesser ", "", "LGPL-2.1-or-later"), ("version 2.1", "version 2", "LGPL-2.1-or-later"), ("Affero ", "", "AGPL-3.0-or-later"),
]


@pytest.mark.parametrize(("old", "new", "name"), NEAR)
def test_words_that_tell_licenses_apart(old, new, name):
    text = next(t for n, t in licenses.TEMPLATES if n == name)
    changed = text.replace(old, new)
    assert changed != text
    found = licenses.Scanner(licenses.TEMPLATES).scan(changed)
    assert name not in {f["license"] for f in found} and len(found) <= 1
    # With the one template alone nothing tells against it.
    alone = licenses.Scanner([(name, text)]).scan(changed)
    assert [f["license"] for f in alone] == [name]


def test_neighbouring_notices_of_near_licenses():
    texts = [(n, t) for n, t in licenses.TEMPLATES if n.startswith(("GPL", "LGPL", "AGPL", "BSD", "CC", "MIT"))]
    for gap in (" ", "\n\n", " or also "):
        found = licenses.Scanner(licenses.TEMPLATES).scan(gap.join(t for _, t in texts))
        assert [f["license"] for f in found if f["n_different"] == 0] == [n for n, _ in texts]
        assert all(f["n_different"] == 0 for f in found)


def test_equal_templates_of_two_names_are_both_reported():
    found = licenses.Scanner([("A", licenses.TEMPLATES[1][1]), ("B", licenses.TEMPLATES[1][1])]).scan(licenses.TEMPLATES[1][1])
    assert [f["license"] for f in found] == ["A", "B"]


def test_no_documents(mixed):
    assert licenses.report(mixed.filter("false")).count() == 0
