import difflib
import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidex import empty_corpus
from evidex.functions.sequences import similar_pairs
from evidex.operators import infer as N
from evidex.operators import understand as U
from evidex.operators.claims import accept_answers, check_claims, unique_evidence
from evidex.operators.embed import HashEmbedder
from evidex.operators.export import profile_sections, write_profiles
from evidex.operators.team import REQUEST, aggregate_score, check_requests, select_team
from evidex.operators.understand import (
    understand,
    best_match,
    detect_vocabulary,
    enrich_intents,
    fuzzy_pairs,
    ground_intents,
    parse_intents,
    plain_intents,
)
from evidex.sources.sinks import (
    latest_runs,
    read_corpus,
    read_graph,
    run_record,
    versions,
    write_corpus,
    write_graph,
)
from evidex.streaming.incremental import ingest_stream

VOCABULARY = [
    ("city", "Москва"), ("city", "Санкт-Петербург"), ("city", "Казань"), ("city", "Екатеринбург"),
    ("city", "Новосибирск"), ("country", "Россия"), ("company", "VK"), ("company", "МТС"),
    ("company", "Яндекс"), ("skill", "Python"), ("skill", "SQL"),
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame(VOCABULARY, "kind string, value string")


def texts(spark, *values):
    rows = [(f"q{i}", v) for i, v in enumerate(values)]
    return plain_intents(spark.createDataFrame(rows, "query_id string, text string"))


def test_detection_and_grounding(spark, vocabulary):
    queries = texts(
        spark, "разработчик из мск", "инженер в питере", "кто есть в Казани", "Екатеринбурге нужен",
        "МАСКВА", "инженер из яндекса", "человек из вконтакте", "в Атлантиде", "Новосибирк",
    )
    asked = queries.withColumns(
        {"city": F.lit("Яндекс"), "required_skills": F.array(F.lit("Python"), F.lit("Cobol")),
         "companies": F.array(F.lit("Google"))}
    )
    rows = {r.text: r for r in ground_intents(asked, vocabulary).collect()}
    cities = {t: r.city for t, r in rows.items()}
    assert cities["разработчик из мск"] == "Москва"
    assert cities["кто есть в Казани"] == "Казань"
    assert cities["Екатеринбурге нужен"] == "Екатеринбург"
    assert cities["МАСКВА"] == "Москва"
    assert cities["Новосибирк"] == "Новосибирск"
    assert cities["в Атлантиде"] is None
    assert rows["инженер из яндекса"].companies == ["Яндекс"]
    assert rows["человек из вконтакте"].companies == ["VK"]
    assert rows["в Атлантиде"].companies == [] and rows["в Атлантиде"].required_skills == []
    assert rows["в Атлантиде"].unmatched_terms == ["Cobol", "Google", "Python"]


def test_enrichment(spark):
    queries = texts(
        spark,
        "ML engineer старше 18 лет",
        "Python в Москве или Казани из МТС старше 20 лет",
        "младше 40 лет и от 25 лет",
        "просто кто-нибудь",
    ).withColumns({"min_years_experience": F.lit(3.0), "required_technologies": F.array(F.lit("MLOps"))})
    rows = [r for r in enrich_intents(queries).orderBy("query_id").collect()]
    first = rows[0]
    assert first.min_age == 19 and first.min_years_experience is None
    assert first.required_skills == ["MLOps"] and first.required_technologies == []
    assert first.preferred_technologies == ["Machine Learning", "MLOps"]
    assert first.semantic_query.startswith("ML engineer старше 18 лет machine learning")
    second = rows[1]
    assert second.cities == ["Москва", "Казань"] and second.city == "Москва"
    assert second.required_skills == ["Python"] and second.companies == ["МТС"]
    assert second.min_age == 21
    assert (rows[2].min_age, rows[2].max_age) == (25, 39)
    assert rows[3].min_years_experience == 3.0 and rows[3].semantic_query == "просто кто-нибудь"


def forms(value):
    root = value.rstrip("аеиоуыюяь")
    cyrillic = all("а" <= c <= "я" or c in "ё -" for c in value)
    return {value} | ({root} if cyrillic and len(root) >= 3 else set())


def test_fuzzy_against_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcан") for _ in range(rng.randint(2, 12))) for _ in range(60)]
    near = [w[:i] + rng.choice("abxан") + w[i + 1 :] for w in words for i in [rng.randrange(len(w))]]
    near += [w + w[:2] for w in words] + [w[1:] for w in words if len(w) > 3]
    a = spark.createDataFrame([(w,) for w in sorted(set(near))], "phrase string")
    b = spark.createDataFrame([(w,) for w in sorted(set(words))], "key string")
    got = {(r.phrase, r.key): round(r.ratio, 9) for r in fuzzy_pairs(a, b).collect()}
    want = {}
    for x in set(near):
        for y in set(words):
            r = max(difflib.SequenceMatcher(None, f, g).ratio() for f in forms(x) for g in forms(y))
            if r >= 0.82:
                want[x, y] = round(r, 9)
    assert got == want and len(want) > 50


def test_best_match(spark, vocabulary):
    values = spark.createDataFrame([("масква",), ("казани",), ("zzz",)], "value string")
    cities = vocabulary.filter("kind = 'city'")
    got = {r.value: r.match for r in best_match(values, cities, {"масква": "москва"}).collect()}
    assert got == {"масква": "Москва", "казани": "Казань", "zzz": None}


def test_detect_ignores_short_phrases(spark, vocabulary):
    found = detect_vocabulary(texts(spark, "использует postgresql"), vocabulary).collect()
    assert {(r.kind, r.value) for r in found} == {("skill", "SQL")}


def test_detect_sends_no_texts_or_phrases_through_the_driver(spark, vocabulary, tmp_path):
    asked = texts(spark, "ищу в москве", "python from яндекс", "в питере масква")
    found = {(r.query_id, r.value) for r in detect_vocabulary(asked, vocabulary).collect()}
    asked.write.parquet(f"{tmp_path}/asked")
    vocabulary.write.parquet(f"{tmp_path}/known")
    stored = detect_vocabulary(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/known"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    # Only vocabulary and alias tables, which stand on the right, are broadcast.
    assert joins and not [line for line in joins if "BuildLeft" in line]
    assert not [line for line in joins if "_digest" in line or "norm#" in line or "left_form" in line]
    assert {(r.query_id, r.value) for r in stored.collect()} == found and found


def test_detect_compares_few_of_many_phrases_and_finds_terms_with_blanks(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeя") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    known = sorted({*words, *(f"{a} {b}" for a, b in zip(words[:20], words[20:])), "aaaa b cc", "dddd e abc"})
    said = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    said += ["caaaa b ccd", "xdddd e abcx", "", "dddd e ab", said[0]]
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(said)] + [(None, said[1])], "query_id string, text string")
    vocabulary = spark.createDataFrame([("skill", v) for v in known], "kind string, value string")
    want = set()
    for i, text in [*enumerate(said), (None, said[1])]:
        spoken = text.split()
        heard = {" ".join(spoken[k : k + n]) for n in (1, 2, 3) for k in range(len(spoken) - n + 1)}
        heard = {f for p in heard if len(p) >= 4 for f in forms(p)}
        for v in known:
            near = any(difflib.SequenceMatcher(None, f, g).ratio() >= 0.82 for f in heard for g in forms(v))
            if v in text or near:
                want.add((None if i is None else f"q{i}", v))
    calls = []

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(U, "PHRASES", 64)
    monkeypatch.setattr(U, "KEYS", 16)
    got = detect_vocabulary(asked, vocabulary, aliases={}, unicode=False)
    assert {(r.query_id, r.value) for r in got.collect()} == want and len(want) > 300
    phrases = sorted({"".join(rng.choice("abcdeя ") for _ in range(rng.randint(4, 12))) for _ in range(400)})
    right = {(p, k) for p in phrases for k in known if difflib.SequenceMatcher(None, p, k).ratio() >= 0.82}
    monkeypatch.setattr(difflib, "SequenceMatcher", Counted)
    assert {(phrases[i], known[j]) for i, j, _ in similar_pairs(phrases, known, 0.82)} == right
    assert len(calls) <= 20 + 3 * len(right)


def test_intent_provider(spark):
    def provider(prompts):
        return [
            json.dumps({"role": "dev", "location": {"city": "Berlin", "cities": ["Berlin"]}, "min_age": 20})
            if "ok" in p else "nonsense" for p in prompts
        ]

    raw = spark.createDataFrame([("a", "ok"), ("b", "no")], "query_id string, text string")
    good, bad = parse_intents(raw, provider)
    row = good.first()
    assert (row.role, row.city, row.cities, row.min_age, row.semantic_query) == (
        "dev", "Berlin", ["Berlin"], 20, "ok",
    )
    assert [r.query_id for r in bad.collect()] == ["b"]


def test_expertise(spark):
    evidence = spark.createDataFrame(
        [("p", "c1", 1, "FinTech ledger"), ("p", "c2", 2, "more fintech!"), ("p", "c3", 3, "other")],
        "person_id string, chunk_id string, position int, content string",
    )
    domains = spark.createDataFrame([("p", "FinTech"), ("p", "other")], "person_id string, domain string")
    rows = N.infer_expertise(domains, evidence).collect()
    assert len(rows) == 1
    assert rows[0].evidence_ids == ["c1", "c2"] and rows[0].status == "unverified"
    assert rows[0].confidence == pytest.approx(0.71)


def test_bitmaps_of_large_sets_lose_no_pair(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [set(rng.sample(words, rng.choice([5, 40, 150, 390]))) for _ in range(12)]
    sets = {f"p{i:02d}": set(rng.choice(base)) ^ set(rng.sample(words, rng.choice([0, 3, 60]))) for i in range(70)}
    lists = [(p, sorted(s)[k::2]) for p, s in sets.items() for k in range(2)]
    members, groups = N.term_sets(spark.createDataFrame(lists, "person_id string, terms array<string>"))
    of = {r.set_id: sets[r.person_id] for r in members.collect()}
    for longs in (1, 16):
        monkeypatch.setattr(N, "BITMAP", longs)
        for least in (0.5, 0.8):
            got = {(r.set_a, r.set_b): round(r.similarity, 9) for r in N.similar_sets(groups, least).collect()}
            want = {
                (a, b): round(len(of[a] & of[b]) / len(of[a] | of[b]), 9)
                for a in of for b in of if a < b and len(of[a] & of[b]) >= least * len(of[a] | of[b])
            }
            assert got == want and want


def test_similar_sets_move_no_row_per_term(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [set(rng.sample(words, n)) for n in (1, 2, 5, 9, 30, 33, 64, 120, 128, 250) for _ in range(2)]
    sets = [frozenset(b ^ set(rng.sample(words, n))) for b in base for n in (0, 1, 2, 4, 20, 30)] + [frozenset(words[:k]) for k in (127, 255)]
    sets = [s for s in sets if s]
    lists = [(f"p{i}", sorted(s)) for i, s in enumerate(sets)] + [(None, words[:3])]
    members, groups = N.term_sets(spark.createDataFrame(lists, "person_id string, terms array<string>"))
    of = {r.set_id: frozenset(r.terms) for r in groups.collect()}
    plans, cut = [], N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    for block, sent, least in ((1 << 14, 1 << 18, 0.5), (3, 0, 0.5), (3, 0, 0.8), (7, 0, 0.3), (7, 0, 1.0)):
        for name, value in (("BLOCK", block), ("SENT", sent)):
            monkeypatch.setattr(N, name, value, raising=False)
        got = sorted((r.set_a, r.set_b, round(r.similarity, 9)) for r in N.similar_sets(groups, least).collect())
        want = sorted(
            (a, b, round(len(of[a] & of[b]) / len(of[a] | of[b]), 9))
            for a in of for b in of if a < b and len(of[a] & of[b]) >= least * len(of[a] | of[b])
        )
        assert got == want and (want or least == 1.0)
    assert plans and not [p for p in plans if re.search(r"\bterm#", p)]
    assert N.similar_sets(groups.filter("false")).count() == 0


def test_similarity_against_brute_force(spark):
    rng = random.Random(2)
    base = [set(rng.sample("abcdefghijklmnop", rng.randint(1, 9))) for _ in range(25)]
    sets = {f"p{i:02d}": set(rng.choice(base)) ^ set(rng.sample("abcdefgh", rng.randint(0, 2))) for i in range(60)}
    rows = [(p, t) for p, s in sets.items() for t in s]
    members, groups = N.term_sets(spark.createDataFrame(rows, "person_id string, term string"))
    pairs = N.similar_sets(groups)
    people = spark.createDataFrame([(p, p.upper()) for p in sets], "person_id string, full_name string")
    evidence = spark.createDataFrame([(p, p + "c", 1) for p in sets], "person_id string, chunk_id string, position int")
    subjects = people.select("person_id")
    got = {
        (r.person_id, r.peer_id): round(r.confidence, 9)
        for r in N.infer_similarity(subjects, members, groups, pairs, people, evidence).collect()
    }
    want = {}
    for p, a in sets.items():
        for q, b in sets.items():
            if p != q and a and b and len(a & b) / len(a | b) >= 0.5:
                want[p, q] = round(min(0.45 + len(a & b) / len(a | b) * 0.4, 0.85), 9)
    assert got == want and len(want) > 20


def test_relationship(spark):
    links = spark.createDataFrame(
        [("a", "norvik"), ("b", "norvik"), ("b", "navy"), ("a", "navy"), ("c", "solo")],
        "person_id string, company string",
    )
    people = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "person_id string, full_name string")
    evidence = spark.createDataFrame([("a", "c1", 1)], "person_id string, chunk_id string, position int")
    rows = N.infer_relationship(people.select("person_id"), links, people, evidence).collect()
    assert {(r.person_id, r.peer_id) for r in rows} == {("a", "b"), ("b", "a")}
    assert all("not verified" in r.reason and "(navy, norvik)" in r.reason for r in rows)
    shared = {(r.company, r.person_id, r.n_peers) for r in N.shared_companies(links).collect()}
    assert shared == {("norvik", "a", 1), ("norvik", "b", 1), ("navy", "a", 1), ("navy", "b", 1)}


def proposals(spark, *rows):
    return spark.createDataFrame(
        [(p, "expertise", c, "", conf, "r", ["e"], s) for p, c, conf, s in rows],
        "person_id string, inference_type string, claim string, peer_id string, confidence double, "
        "reason string, evidence_ids array<string>, status string",
    )


def test_inference_upkeep(spark):
    stored = proposals(
        spark, ("p", "keep", 0.5, "unverified"), ("p", "gone", 0.5, "unverified"),
        ("p", "reviewed", 0.5, "reviewed"), ("other", "old", 0.5, "unverified"),
    )
    fresh = proposals(
        spark, ("p", "keep", 0.8, "unverified"), ("p", "reviewed", 0.9, "unverified"),
        ("p", "new", 0.7, "unverified"),
    )
    subjects = spark.createDataFrame([("p",)], "person_id string")
    got = {(r.person_id, r.claim): (r.confidence, r.status)
           for r in N.sync_inferences(stored, fresh, subjects).collect()}
    assert got == {
        ("p", "keep"): (0.8, "unverified"), ("p", "reviewed"): (0.5, "reviewed"),
        ("p", "new"): (0.7, "unverified"), ("other", "old"): (0.5, "unverified"),
    }
    twice = proposals(spark, ("p", "x", 0.6, "unverified"), ("p", "x", 0.8, "unverified"))
    up = N.upsert_inferences(stored.limit(0), twice).collect()
    assert len(up) == 1 and up[0].confidence == 0.8
    listed = N.list_inferences(stored, subjects).collect()
    assert [r.claim for r in listed] == ["gone", "keep", "reviewed"]


def test_claims(spark):
    candidates = spark.createDataFrame([("q", "p")], "query_id string, person_id string")
    evidence = spark.createDataFrame([("q", "p", "c1")], "query_id string, person_id string, chunk_id string")
    cases = [
        ("p", "fact", 1.0, ["c1"], None, None),
        ("x", "fact", 1.0, ["c1"], None, "unknown candidate"),
        ("p", "fact", 1.0, [], None, "no evidence"),
        ("p", "fact", 1.0, ["c1", "c9"], None, "unknown evidence"),
        ("p", "fact", 0.9, ["c1"], None, "fact without confidence 1"),
        ("p", "inference", 0.9, ["c1"], "", "inference without reason"),
        ("p", "inference", 0.9, ["c1"], "why", None),
    ]
    claims = spark.createDataFrame(
        [("q", i, c, "t", k, conf, ids, why) for i, (c, k, conf, ids, why, _) in enumerate(cases)],
        "query_id string, claim_no int, candidate_id string, claim string, kind string, "
        "confidence double, evidence_ids array<string>, reason string",
    )
    checked = check_claims(claims, candidates, evidence)
    assert [r.violation for r in checked.orderBy("claim_no").collect()] == [c[-1] for c in cases]
    assert accept_answers(checked).first().accepted is False
    assert accept_answers(checked.filter("claim_no in (0, 6)")).first().accepted is True


def test_unique_evidence(spark):
    rows = [("q", "p", i, f"c{i % 15:02d}", "x", "structured") for i in range(40)]
    df = spark.createDataFrame(
        rows, "query_id string, person_id string, place int, chunk_id string, content string, source string"
    )
    got = unique_evidence(df).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [f"c{i:02d}" for i in range(12)]


def test_team_fixture(spark):
    roles = spark.createDataFrame(
        [("r", 0, "r|0", "backend", 2, 20, 0.0), ("r", 1, "r|1", "platform", 2, 20, 0.0)],
        "request_id string, role_no int, query_id string, role string, count int, "
        "candidates_per_role int, diversity_weight double",
    )
    candidates = spark.createDataFrame(
        [("r|0", "Ada", 0.95, ["x"]), ("r|0", "Grace", 0.85, ["y"]),
         ("r|1", "Ada", 0.95, ["x"]), ("r|1", "Linus", 0.9, None)],
        "query_id string, person_id string, score double, terms array<string>",
    )
    chosen = select_team(roles, candidates)
    rows = chosen.orderBy("role_no", "slot").collect()
    assert [r.person_id for r in rows] == ["Ada", "Grace", "Linus", None]
    total = aggregate_score(chosen).first()
    assert total.aggregate_score == pytest.approx(0.9) and total.unfilled == 1


def test_team_diversity_against_brute_force(spark):
    rng = random.Random(4)
    people = {f"p{i}": (rng.random(), set(rng.sample("abcdefg", 3))) for i in range(12)}
    roles = spark.createDataFrame(
        [("r", i, f"r|{i}", f"role{i}", 3, 20, 0.5) for i in range(3)],
        "request_id string, role_no int, query_id string, role string, count int, "
        "candidates_per_role int, diversity_weight double",
    )
    candidates = spark.createDataFrame(
        [(f"r|{i}", p, s, sorted(t)) for i in range(3) for p, (s, t) in people.items()],
        "query_id string, person_id string, score double, terms array<string>",
    )
    got = [r.person_id for r in select_team(roles, candidates).orderBy("role_no", "slot").collect()]
    want, seen = [], set()
    for _ in range(9):
        def value(p):
            s, t = people[p]
            return max(0.0, s - 0.5 * (len(t & seen) / len(t | seen) if t | seen else 0)), s, p
        best = max((p for p in people if p not in want), key=value)
        want.append(best)
        seen |= people[best][1]
    assert got == want


def test_request_limits(spark):
    def role(name="dev", count=1):
        return (name, count, None, None, None, None, None, None, None, None, None, None)

    rows = [
        ("ok", None, None, None, [role()]), ("many", None, 101, None, [role()]),
        ("none", None, None, None, []), ("count", None, None, None, [role(count=11)]),
        ("weight", None, None, 0.9, [role()]), ("roles", None, None, None, [role()] * 21),
    ]
    good, bad = check_requests(spark.createDataFrame(rows, REQUEST))
    assert [r.request_id for r in good.collect()] == ["ok"] and bad.count() == 5


def test_profile_sections(spark, tmp_path):
    profile = spark.createDataFrame(
        [("p", None, "Berlin", None, 8.0, 36, ["Python", "SQL"], [], ["FinTech"], [], ["X"])],
        "person_id string, summary string, location string, country string, years_experience double, "
        "age int, skills array<string>, technologies array<string>, domains array<string>, "
        "companies array<string>, projects array<string>",
    )
    sections = profile_sections(profile)
    got = [(r.label, r.value) for r in sections.orderBy("section_no").collect()]
    assert got == [
        ("Profile", "No summary provided."), ("Location", "Berlin"), ("Experience", "8 years"),
        ("Age", "36 years"), ("Skills", "Python, SQL"), ("Domains", "FinTech"), ("Projects", "X"),
    ]
    write_profiles(sections, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 7


def test_versions_and_runs(spark, tmp_path):
    root = str(tmp_path / "corpus")
    assert versions(spark, root) == []
    assert read_corpus(spark, root).people.count() == 0
    corpus = empty_corpus(spark)
    report = spark.createDataFrame([(1, 1)], "total long, created long")
    row = run_record(report, "r1", "running", datetime(2026, 1, 1), {"graph": "on"})
    later = run_record(report, "r1", "succeeded", datetime(2026, 1, 2))
    runs = corpus.ingest_runs.unionByName(row).unionByName(later)
    assert write_corpus(corpus.with_tables(ingest_runs=runs), spark, root) == 1
    assert write_corpus(read_corpus(spark, root), spark, root) == 2
    assert versions(spark, root) == [1, 2]
    before = read_corpus(spark, root)
    grown = before.with_tables(ingest_runs=before.ingest_runs.limit(1))
    assert write_corpus(grown, spark, root, before) == 3
    assert sorted(p.name for p in (tmp_path / "corpus" / "v=3").iterdir()) == ["ingest_runs"]
    assert read_corpus(spark, root).ingest_runs.count() == 1
    assert read_corpus(spark, root, 2).ingest_runs.count() == 2
    assert latest_runs(read_corpus(spark, root, 2).ingest_runs).first().status == "succeeded"
    with pytest.raises(ValueError):
        run_record(report, "r", "lost", datetime(2026, 1, 1))
    nodes = spark.createDataFrame([("n", "Person", "N", "n")], "node_id string, node_type string, name string, key string")
    edges = spark.createDataFrame([("e", "n", "HAS_SKILL", "s")], "edge_id string, src string, rel string, dst string")
    write_graph(nodes, edges, spark, str(tmp_path / "graph"))
    back = read_graph(spark, str(tmp_path / "graph"))
    assert back[0].count() == 1 and back[1].first().rel == "HAS_SKILL"


def test_stream(spark, tmp_path, ada):
    landing = tmp_path / "landing"
    landing.mkdir()
    root, marks = str(tmp_path / "corpus"), str(tmp_path / "marks")
    (landing / "a.jsonl").write_text(json.dumps(ada) + "\n{broken\n", encoding="utf-8")

    def run():
        ingest_stream(spark, str(landing), root, marks, HashEmbedder(8), "live").awaitTermination()
        return read_corpus(spark, root)

    first = run()
    assert first.people.count() == 1 and first.document_chunks.count() == 5
    lost = spark.read.parquet(f"{root}/_quarantine").collect()
    assert [(r.batch, r.error_type) for r in lost] == [(0, lost[0].error_type)]
    (landing / "b.jsonl").write_text(
        json.dumps(ada) + "\n" + json.dumps(dict(ada, id="x", full_name="New")) + "\n", encoding="utf-8"
    )
    second = run()
    assert second.people.count() == 2
    reports = {r.run_id: r.report for r in second.ingest_runs.collect()}
    assert (reports["batch-0"]["created"], reports["batch-0"]["failed"]) == (1, 1)
    assert (reports["batch-1"]["created"], reports["batch-1"]["unchanged"]) == (1, 1)


def test_roles_beyond_the_limits_are_reported(spark):
    roles = spark.createDataFrame(
        [("r", 0, "r|0", "dev", 11, 20, 0.1), ("r", 1, "r|1", "ops", 1, 20, 0.1)],
        "request_id string, role_no int, query_id string, role string, count int, candidates_per_role int, diversity_weight double",
    )
    people = spark.createDataFrame(
        [("r|0", "a", 0.9, ["x"]), ("r|1", "b", 0.8, ["y"])],
        "query_id string, person_id string, score double, terms array<string>",
    )
    rows = {r.role: r for r in select_team(roles, people).collect()}
    assert rows["ops"].person_id == "b"
    assert rows["dev"].person_id is None and "limits" in rows["dev"].reason


def test_failed_intents_become_plain_ones(spark):
    texts = spark.createDataFrame([("q0", "python in berlin"), ("q1", "broken")], "query_id string, text string")

    def provider(prompts):
        return ['{"role": "dev"}' if "python" in p else "no json" for p in prompts]

    rows = {r.query_id: r for r in understand(texts, None, provider).collect()}
    assert rows["q0"].role == "dev" and rows["q1"].text == "broken" and rows["q1"].role is None


def test_graph_and_corpus_share_a_root(spark, tmp_path):
    from evidex import empty_corpus
    from evidex.sources.sinks import read_corpus, read_graph, write_corpus, write_graph

    root = str(tmp_path / "root")
    nodes = spark.createDataFrame([("n", "person")], "node_id string, node_type string")
    edges = spark.createDataFrame([("n", "m", "knows")], "src string, dst string, rel string")
    write_graph(nodes, edges, spark, root)
    assert read_corpus(spark, root).people.count() == 0
    write_corpus(empty_corpus(spark), spark, root)
    write_graph(nodes, edges, spark, root)
    assert read_corpus(spark, root).people.count() == 0
    assert read_graph(spark, root)[0].count() == 1
    write_corpus(empty_corpus(spark), spark, root)
    assert read_graph(spark, root)[1].first().rel == "knows"


def test_bitmaps_rule_pairs_out_before_they_are_moved(spark):
    rng = random.Random(5)
    rows = [(f"p{i:02d}", f"w{t}") for i in range(60) for t in rng.sample(range(300), 40)]
    _, groups = N.term_sets(spark.createDataFrame(rows, "person_id string, term string"))
    written = []
    own = N.cut_lineage
    N.cut_lineage = lambda df: written.append(own(df)) or written[-1]
    try:
        assert N.similar_sets(groups).count() == 0
    finally:
        N.cut_lineage = own
    assert written[-1].columns == ["small", "large"] and written[-1].count() == 0
    assert all("small_b0" not in w.columns and "b0" in w.columns for w in written[:-1])
