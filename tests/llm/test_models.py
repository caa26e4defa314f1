"""Embeddings, mixing, toxicity and quality: brute force, held-out accuracy, awkward rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidex.llm import caps, mixing, quality, toxicity
from tests.llm.test_simhash import smallest_reachable


def unit(v):
    v = np.array(v, dtype=float)
    return v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain_links(rows, cosine=0.98):
    n = len(rows)
    linked = np.eye(n, dtype=bool)
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            _, w, b = rows[j]
            if a is not None and a == b and good(v) and good(w) and len(v) == len(w):
                linked[i, j] = linked[j, i] = unit(v) @ unit(w) >= cosine
    return linked


@pytest.mark.parametrize("block", [caps.BLOCK_ROWS, 5])
def test_embeddings_match_brute_force(spark, tables, block):
    given = [(r.vec_id, list(r.embedding), r.label) for r in tables["embeddings"].collect()][:160]
    nan, inf = float("nan"), float("inf")
    first = given[0][1]
    odd = [None, [], [0.0] * 64, [nan] * 64, [inf] + first[1:], [None] + first[1:], first[:32], first[:32], [2 * x for x in first], [1e-30 * x for x in first]]
    rows = given + [(8000 + i, v, given[0][2]) for i, v in enumerate(odd)]
    rows += [(9000, first, None), (9001, first, None), (None, first, given[0][2]), (None, None, None)]
    rows += [(9002 + i % 2, given[7][1], given[7][2]) for i in range(6)]
    rng = np.random.default_rng(9)
    rows += [(9100 + i, (np.array(given[3][1]) + rng.normal(0, 0.01, 64)).tolist(), given[3][2]) for i in range(30)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], a) for i, v, a in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "'mine' AS filters")
    linked = plain_links(rows)
    ids = [i for i, _, _ in rows]
    label = smallest_reachable(ids, linked)
    want = Counter((i, int(row.sum()) - 1, c, i is not None and i == c) for i, row, c in zip(ids, linked, label, strict=True))
    found = caps.near_duplicates(df, block=block)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, found.collect())) == want


def test_caps_recall(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(400, 64))
    near = centres + rng.normal(size=(400, 64)) * 0.2 / 8 * np.linalg.norm(centres, axis=1, keepdims=True) * 0.95
    x = np.r_[centres, near]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, direction = caps.ProductCode(64).decode(x, caps.MARGIN)
    own = defaultdict(set)
    for r, d in zip(row.tolist(), direction.tolist(), strict=True):
        own[r].add(d)
    pairs = [(i, 400 + i) for i in range(400) if x[i] @ x[400 + i] >= 0.98]
    assert len(pairs) > 100
    assert np.mean([bool(own[a] & own[b]) for a, b in pairs]) >= 0.99


def test_list_decoding_is_complete():
    rng = np.random.default_rng(11)
    code = caps.ProductCode(12, parts=3, words=4)
    x = rng.normal(size=(20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ code.rotation
    s = [turned[:, c] @ w for c, w in zip(code.cuts, code.code, strict=True)]
    every = (s[0][:, :, None, None] + s[1][:, None, :, None] + s[2][:, None, None, :]).reshape(20, -1)
    row, direction = code.decode(x, 0.3)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(every >= every.max(axis=1, keepdims=True) - 0.3), strict=True)}
    assert set(zip(row.tolist(), direction.tolist(), strict=True)) == want


def test_no_vectors(spark, tables):
    assert caps.near_duplicates(tables["embeddings"].filter("false")).count() == 0


def plain_rates(n, p, target, steps=mixing.STEPS):
    """Projected gradient per document, in numpy."""
    rate = np.ones(len(n))
    size = n @ p
    for _ in range(steps):
        g = np.where(size > 0, (n * rate) @ p - target, 0) / np.where(size > 0, size, 1)
        rate = np.maximum(0, rate - p @ g)
    return rate


def test_rates_match_the_fit_by_document(mixed, tables):
    got = mixing.mix(mixed, tables["labels"]).select("tokens", "posterior", "rate", "copies", "domain").collect()
    n = np.array([r.tokens for r in got], dtype=float)
    p = np.array([r.posterior for r in got])
    domains = sorted(mixing.TARGETS)
    weight = np.array([mixing.TARGETS[d] for d in domains])
    target = weight / weight.sum() * n.sum()
    assert np.allclose(p.sum(axis=1), 1)
    assert np.allclose([r.rate for r in got], plain_rates(n, p, target), atol=1e-3)
    rate = np.array([r.rate for r in got])
    assert (rate >= 0).all() and np.abs((n * rate) @ p - target).sum() < 0.02 * n.sum()
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    assert [r.domain for r in got] == [domains[i] for i in p.argmax(axis=1)]


def test_posteriors_match_a_plain_classifier(mixed, tables):
    rows = mixing.features(mixed).select("doc_id", "_mix_lang", *[f"_mix_{n}" for n in mixing.EDGES]).collect()
    quality_of = {}
    for r in tables["labels"].collect():
        quality_of[r.doc_id] = min(r.quality, quality_of.get(r.doc_id, 1))
    domains = sorted(mixing.TARGETS)
    names = [*mixing.LANGUAGES, "other"]
    seen = [(tuple(r[1:]), names[r[1]] + ("/high" if quality_of[r[0]] else "/low")) for r in rows if r[0] in quality_of]
    seen = [(f, d) for f, d in seen if d in domains]
    bins = [5, *(len(e) + 1 for e in mixing.EDGES.values())]
    every = Counter(d for _, d in seen)
    of = Counter((i, b, d) for f, d in seen for i, b in enumerate(f))

    def posterior(f):
        s = np.array([
            math.log(every[d] + 0.5) + sum(math.log((of[i, b, d] + 0.5) / (every[d] + 0.5 * bins[i])) for i, b in enumerate(f))
            for d in domains
        ])
        e = np.exp(s - s.max())
        return e / e.sum()

    got = mixing.posteriors(mixing.features(mixed), tables["labels"], domains).collect()
    assert len(got) == len({tuple(r[1:]) for r in rows})
    for r in got:
        assert np.allclose(r.posterior, posterior(tuple(r[: len(bins)])))


def test_mixing_edges(mixed, tables):
    none = mixing.mix(mixed.filter("false"), tables["labels"])
    assert none.count() == 0
    unlabelled = mixing.mix(mixed, tables["labels"].filter("false")).select("posterior", "rate").distinct().collect()
    assert len(unlabelled) == 1 and np.allclose(unlabelled[0].posterior, 1 / len(mixing.TARGETS))
    again = mixing.resample(mixed, tables["labels"])
    assert again.columns == mixed.columns
    copies = {r.doc_id: r.c for r in again.groupBy("doc_id").count().withColumnRenamed("count", "c").collect()}
    want = mixing.mix(mixed, tables["labels"]).groupBy("doc_id").sum("copies").collect()
    assert all(copies.get(r.doc_id, 0) == r[1] for r in want)
    with pytest.raises(ValueError):
        mixing.mix(mixed, tables["labels"], {"en/high": -1.0})


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(r.score, toxic[d]) for d, r in got.items() if r.held_out and d in toxic]
    right = [(s >= 0.5) == bool(y) for s, y in held]
    assert np.mean(right) >= 0.9
    order = [(a > b) + 0.5 * (a == b) for a, y in held if y for b, z in held if not z]
    assert np.mean(order) >= 0.9


def test_toxicity_ignores_other_columns_and_reads_whole_texts(mixed, rows, tables):
    labels = tables["labels"]
    one = toxicity.score(mixed, labels)
    assert one.columns == [c for c in mixed.columns if c != "score"] + ["score", "predicted"]
    scored = one.select("text", "score").collect()
    assert len(scored) == len(rows) and all(r.score is not None for r in scored)
    by_text = defaultdict(set)
    for r in scored:
        by_text[r.text or ""].add(round(r.score, 5))
    assert all(len(s) == 1 for s in by_text.values())
    kept = toxicity.clean(mixed, labels)
    assert kept.columns == mixed.columns and kept.count() == one.filter("predicted = 0").count()
    assert toxicity.report(mixed.filter("false"), labels).count() == 0
    constant = {r.score for r in toxicity.report(mixed, labels.filter("toxic = 0")).collect()}
    assert constant == {0.0}


def test_network_gradient_and_windows():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, place = rng.standard_normal((6, 2 * toxicity.WIDTH)), rng.integers(0, 6, (3, 5))
    here = np.ones((3, 5), dtype=bool)
    here[1, 3:] = False
    weight = rng.standard_normal(3)

    def loss():
        return float(weight @ net.forward(x, place, here)[0])

    g, d_x = net.gradient(x, place, here, weight, net.forward(x, place, here, keep=True)[1])
    for name, own in [*g.items(), ("x", d_x)]:
        value = x if name == "x" else net.p[name]
        at = tuple(int(rng.integers(0, n)) for n in value.shape)
        old, step = value[at], 1e-3
        value[at] = old + step
        up = loss()
        value[at] = old - step
        slope = (up - loss()) / (2 * step)
        value[at] = old
        assert abs(slope - own[at]) < 1e-2 * max(1, abs(slope)), name
    sizes = np.array([0, 1, 24, 25, 40, 41, 1000])
    text, place, here = toxicity.windows(sizes)
    first = np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes):
        own = place[text == i][here[text == i]] - first[i]
        assert set(own.tolist()) == set(range(n))
        starts = [0]
        while starts[-1] + toxicity.WINDOW < n:  # one more window until the last word is in one
            starts.append(starts[-1] + toxicity.STRIDE)
        assert (text == i).sum() == len(starts)
        assert [p[0] - first[i] for p, h in zip(place[text == i], here[text == i], strict=True) if h[0]] == (starts if n else [])
    # A passage of half a window lies whole in a window, wherever it begins.
    whole = [set(range(s, s + toxicity.WINDOW)) for s in starts]
    half = toxicity.WINDOW // 2
    assert all(any(set(range(a, a + half)) <= w for w in whole) for a in range(1000 - half + 1))


def plain_perplexities(rows, trusted_rows, order):
    """Interpolated modified Kneser-Ney from dictionaries, per language."""
    tables = defaultdict(lambda: [Counter() for _ in range(order + 1)])
    for lang, text in trusted_rows:
        for g in quality.grams(text, order).tolist():
            tables[lang][order][g] += 1
    for t in tables.values():
        for m in range(order - 1, 0, -1):
            t[m] = Counter(g & (1 << 8 * m) - 1 for g in t[m + 1])
    facts = {}
    for lang, t in tables.items():
        for m in range(1, order + 1):
            n = Counter(min(c, 5) for c in t[m].values())
            d = quality.discounts(n[1], n[2], n[3], n[4])
            total, gamma = Counter(), Counter()
            for g, c in t[m].items():
                total[g >> 8] += c
                gamma[g >> 8] += d[min(c, 3) - 1]
            facts[lang, m] = (d, total, gamma)

    def p(lang, g, m):
        if m == 0:
            return 1 / 256
        lower = p(lang, g & (1 << 8 * (m - 1)) - 1, m - 1)
        if (lang, m) not in facts or not facts[lang, m][1][g >> 8]:
            return lower
        d, total, gamma = facts[lang, m]
        c = tables[lang][m][g]
        own = max(c - d[min(c, 3) - 1], 0) if c else 0
        return (own + gamma[g >> 8] * lower) / total[g >> 8]

    known = {}
    out = []
    for lang, text in rows:
        logs = 0.0
        for g in quality.grams(text, order).tolist():
            if (lang, g) not in known:
                known[lang, g] = math.log(p(lang, g, order))
            logs += known[lang, g]
        out.append(math.exp(-logs / max(len(text), 1)))
    return out


@pytest.mark.parametrize("group_bytes", [quality.GROUP_BYTES, 150_000])
def test_perplexities_match_brute_force(mixed, rows, tables, group_bytes):
    order = 3
    good_ids = {}
    for r in tables["labels"].collect():
        good_ids[r.doc_id] = min(r.quality, good_ids.get(r.doc_id, 1))
    train = [
        (lang or "", t.encode()) for d, t, lang in rows if good_ids.get(d) == 1 and t and zlib.crc32(str(d).encode()) % 5
    ]
    want = plain_perplexities([(lang or "", (t or "").encode()) for _, t, lang in rows], train, order)
    want = Counter((d, lang or "", float(f"{p:.4g}")) for (d, _, lang), p in zip(rows, want, strict=True))
    got = quality.score(mixed, tables["labels"], order, group_bytes).collect()
    assert Counter((r.doc_id, r.lang, float(f"{r.perplexity:.4g}")) for r in got) == want


def test_probabilities_sum_to_one(spark):
    texts = [b"abracadabra", b"barbara and abba", b"a banana band"]
    counts = Counter(g for t in texts for g in quality.grams(t, 3).tolist())
    contexts = {g >> 8 for g in counts}
    rows = [("x", c << 8 | b, counts[c << 8 | b]) for c in contexts for b in range(256)]
    p = quality.log_probabilities(spark.createDataFrame(rows, "lang string, gram long, c long"), 3).collect()
    total = Counter()
    for r in p:
        total[r.gram >> 8] += math.exp(r.logp)
    assert set(total) == contexts and all(abs(s - 1) < 1e-9 for s in total.values())


def test_discounts_leave_something_for_unseen_grams():
    assert quality.discounts(21, 8, 12, 4) == pytest.approx((0.5676, 1.0, 2.2432), abs=1e-4)  # the second would be 0
    assert quality.discounts(0, 1, 1, 1) == (0.5, 1.0, 1.5)
    for n in ((326, 61, 56, 32), (9, 90, 9, 9), (5, 1, 50, 1), (7, 7, 7, 700)):
        assert all(0 < d < i for i, d in enumerate(quality.discounts(*n), 1))


def test_every_document_of_every_language_has_a_perplexity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judge(docs, labels).join(labels, "doc_id", "left").collect()
    assert all(r.perplexity is not None and r.threshold is not None and math.isfinite(r.perplexity) for r in got)
    french = [r for r in got if r.lang == "fr" and r.quality is not None]
    assert np.mean([r.kept for r in french if r.quality == 1]) > 0.9
    assert np.mean([not r.kept for r in french if r.quality == 0]) > 0.6


def test_judgement_keeps_trusted_and_rejects_junk(mixed, tables):
    labels = tables["labels"]
    got = quality.judge(mixed, labels)
    assert got.columns == ["doc_id", "lang", "n_bytes", "perplexity", "threshold", "kept"]
    found = got.join(labels.groupBy("doc_id").agg({"quality": "min"}).withColumnRenamed("min(quality)", "q"), "doc_id").collect()
    assert np.mean([r.kept for r in found if r.q == 1]) > 0.95
    assert np.mean([not r.kept for r in found if r.q == 0]) > 0.6
    empty = got.filter("n_bytes = 0").collect()
    assert empty and all(r.kept and r.perplexity == 1 for r in empty)
    unknown = got.filter("lang = 'xx'").collect()
    assert all(r.threshold is None and r.kept for r in unknown)
    assert quality.judge(mixed.filter("false"), labels).count() == 0
    assert quality.judge(mixed, labels.filter("false")).filter("not kept").count() == 0


def test_mixing_steps_are_data_of_one_expression(spark):
    table = spark.createDataFrame([(3, [0.25, 0.75], 1.0), (5, [0.5, 0.5], 0.2)], "tokens long, posterior array<double>, rate double")
    plan = mixing._stepped(table, [[0.5, -1.0]] * 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greatest") == 1
    got = [r.rate for r in mixing._stepped(table, [[0.5, -1.0], [2.0, 0.25]]).orderBy("tokens").collect()]
    assert got == [1.0 - (0.25 * 0.5 - 0.75) - (0.25 * 2.0 + 0.75 * 0.25), 0.0]
