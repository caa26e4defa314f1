import json
import math
import random

import pytest
from pyspark.sql import functions as F

from evidex import empty_corpus
from evidex.operators import graph as G
from evidex.operators import rank as R
from evidex.operators import structured as S
from evidex.operators.embed import HashEmbedder
from evidex.operators.understand import plain_intents
from evidex.operators.vector import cosine_topk, cosine_topk_within, lsh_topk
from evidex.plans.ingest import ingest_structured
from evidex.plans.search import SearchConfig, answer_queries, build_teams, search
from evidex.session import cut_lineage
from evidex.sources.demo import demo_documents, demo_records
from tests.test_ingest_chunk import documents

PROVIDER = HashEmbedder(256)


def settled(corpus):
    return corpus.with_tables(**{n: cut_lineage(df) for n, df in corpus.tables().items()})


@pytest.fixture(scope="module")
def corpus(spark):
    from tests.conftest import ADA

    grace = {
        "id": "grace", "full_name": "Grace Hopper", "location": "Нью-Йорк", "country": "USA",
        "current_title": "Senior Platform Engineer", "years_experience": 3, "age": 50,
        "summary": "Compilers and FinTech.", "skills": ["COBOL"], "technologies": ["Kubernetes"],
        "domains": ["FinTech"], "experience": [{"company": "Norvik"}, {"company": "Navy"}],
    }
    linus = {
        "id": "linus", "full_name": "Linus Torvalds", "location": "Казань", "country": "Germany",
        "current_title": "Kernel Developer", "years_experience": 20, "age": 54,
        "summary": "Operating systems.", "skills": ["C", "Python"],
        "projects": [{"name": "Risk Engine", "domains": ["FinTech"], "technologies": ["C"]}],
    }
    docs = documents(spark, [ADA, grace, linus])
    return settled(ingest_structured(empty_corpus(spark), docs, PROVIDER).corpus)


@pytest.fixture(scope="module")
def graph(corpus):
    return cut_lineage(G.graph_nodes(corpus)), cut_lineage(G.graph_edges(corpus))


def table(spark, *rows):
    base = [dict(query_id=f"q{i}", text=r.pop("text", "x"), **r) for i, r in enumerate(rows)]
    fields = {
        "min_years_experience": "double", "min_age": "int", "max_age": "int", "role": "string",
        "seniority": "string", "country": "string", "city": "string", "semantic_query": "string",
    }
    names = sorted({k for r in base for k in r})
    ddl = ", ".join(f"{n} {fields.get(n, 'string' if n in ('query_id', 'text') else 'array<string>')}" for n in names)
    return plain_intents(spark.createDataFrame([tuple(r.get(n) for n in names) for r in base], ddl))


def pairs(corpus, queries, **kw):
    full = S.complete_queries(queries)
    terms = S.query_terms(full)
    prepared = full.join(S.query_needs(terms), "query_id", "left")
    hits = S.term_hits(terms, S.entities(corpus), S.memberships(corpus))
    found = S.structured_pairs(prepared, corpus.people, hits, **kw)
    names = found.join(corpus.people, "person_id").select("query_id", "full_name").collect()
    out = {}
    for r in names:
        out.setdefault(r.query_id, []).append(r.full_name.split()[0])
    return {k: sorted(v) for k, v in out.items()}


def test_term_hits_of_a_pool(spark):
    """Pairs of a pool are counted whether or not they meet all hard terms; memberships may repeat."""
    words = [f"w{i}" for i in range(150)]  # more than two words of bits
    terms = spark.createDataFrame(
        [("a", "competency", w, 1, i) for i, w in enumerate(words)] + [("a", "preference", "w7", 2, 900), ("b", "domain", "d", 1, 901)],
        "query_id string, slot string, term string, weight long, term_no long",
    )
    entities = spark.createDataFrame(
        [(k, f"{k}-{w}", w) for w in words for k in ("skill", "technology")] + [("domain", "d", "d")],
        "kind string, entity_id string, term string",
    )
    members = spark.createDataFrame(
        [(k, "p", f"{k}-{w}") for w in words[:100] for k in ("skill", "technology")] * 2
        + [("skill", "all", f"skill-{w}") for w in words] + [("domain", "p", "d"), ("skill", "out", "skill-w7")],
        "kind string, person_id string, entity_id string",
    )
    pool = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "all"), ("b", "all"), ("a", "none")], "query_id string, person_id string")
    got = sorted(map(tuple, S.term_hits(terms, entities, members, pool).collect()))
    assert got == [("a", "all", 150, 150, 0, 2), ("a", "p", 100, 100, 0, 2), ("b", "p", 1, 0, 0, 0)]
    strict = {(r.query_id, r.person_id): r for r in S.term_hits(terms, entities, members).collect()}
    assert strict["a", "all"].hard_hits == 150 and strict["b", "p"].hard_hits == 1
    assert all(r.hard_hits < 150 for pair, r in strict.items() if pair != ("a", "all"))


def test_structured_filters(spark, corpus):
    queries = table(
        spark,
        dict(country="germany", min_years_experience=5.0, required_skills=["Postgres"],
             required_technologies=["aws"], required_domains=["FinTech"]),
        dict(required_technologies=["Postgres"]),
        dict(country="Germany"),
        dict(city="казани"),
        dict(cities=["Berlin", "Казань"]),
        dict(min_age=50, max_age=52),
        dict(min_years_experience=8.0),
        dict(companies=["norvik"], required_domains=["fintech"]),
        dict(projects=["Risk Engine"]),
        dict(required_skills=["Python", "Nope"]),
        dict(),
        dict(country="Germany", min_age=50),
    )
    got = pairs(corpus, queries)
    assert got == {
        "q0": ["Ada"], "q1": ["Ada"], "q2": ["Ada", "Linus"], "q3": ["Linus"],
        "q4": ["Ada", "Linus"], "q5": ["Grace"], "q6": ["Ada", "Linus"], "q7": ["Ada", "Grace"],
        "q8": ["Linus"], "q10": ["Ada", "Grace", "Linus"], "q11": ["Linus"],
    }
    assert {k: len(v) for k, v in pairs(corpus, queries, limit=1).items() if k == "q2"} == {"q2": 1}


def test_plan_flags(spark):
    rows = S.complete_queries(
        table(
            spark,
            dict(country="DE", required_domains=["x"], semantic_query="s"),
            dict(role="dev", semantic_query=""),
        )
    ).orderBy("query_id").collect()
    assert (rows[0].has_hard_filters, rows[0].use_vector, rows[0].use_graph) == (True, True, True)
    assert (rows[1].has_hard_filters, rows[1].use_vector, rows[1].use_graph) == (False, False, False)


def test_profiles_evidence_vocabulary(corpus):
    rows = {r.full_name: r for r in S.profiles(corpus).collect()}
    ada = rows["Ada Brandt"]
    assert ada.skills == ["PostgreSQL", "Python"]
    assert ada.technologies == ["Amazon Web Services", "Graph Neural Networks", "Kubernetes"]
    assert rows["Linus Torvalds"].companies == []
    per = S.first_evidence(corpus.document_chunks).groupBy("person_id").count().collect()
    assert all(r["count"] <= 5 for r in per)
    known = {(r.kind, r.value) for r in S.corpus_vocabulary(corpus).collect()}
    assert ("city", "Berlin") in known and ("domain", "FinTech") in known
    one = S.corpus_vocabulary(corpus, {k: 1 for k in S.VOCABULARY_KINDS}).count()
    assert one == 6
    ids = corpus.people.filter("full_name like 'Ada%'").select("person_id")
    detail = S.candidate_detail(corpus, ids).collect()
    assert len(detail) == 1 and [e.position for e in detail[0].evidence] == [1, 2, 3, 4, 5]


def test_substring_pairs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(80)]
    terms = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 5))) for _ in range(30)]
    got = S.substring_pairs(
        spark.createDataFrame([(t,) for t in texts], "text string"),
        spark.createDataFrame([(t,) for t in terms], "term string"), "text", "term",
    ).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(t, w) for t in set(texts) for w in set(terms) if w in t}


def brute_topk(queries, vectors, k):
    out = []
    for q, a in queries:
        def cos(b):
            na, nb = math.hypot(*a), math.hypot(*b)
            return sum(x * y for x, y in zip(a, b)) / na / nb if na and nb else 0.0
        best = sorted(((-cos(v), i, p) for i, p, v in vectors))[:k]
        out += [(q, n + 1, i) for n, (_, i, _p) in enumerate(best)]
    return sorted(out)


def test_cosine_topk(spark):
    rng = random.Random(5)
    vectors = [
        (f"v{i:03d}", f"p{i % 9}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)
    ]
    queries = [(f"q{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(6)]
    vdf = spark.createDataFrame(vectors, "vector_id string, person_id string, embedding array<double>")
    qdf = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    want = brute_topk(queries, vectors, 7)

    def rows(df):
        return sorted((r.query_id, r.position, r.vector_id) for r in df.collect())

    assert rows(cosine_topk(qdf, vdf.repartition(5), 7)) == want
    assert rows(cosine_topk(qdf, vdf, 7, block_numbers=8)) == want
    assert all(0 <= r.score <= 1 for r in cosine_topk(qdf, vdf, 300).collect())
    allowed = [(q, f"p{i}") for n, (q, _) in enumerate(queries[:4]) for i in range(n)]
    adf = spark.createDataFrame(allowed, "query_id string, person_id string")
    within = sorted(
        row for q, a in queries
        for row in brute_topk([(q, a)], [v for v in vectors if (q, v[1]) in allowed], 7)
    )
    assert rows(cosine_topk_within(qdf, vdf, adf, 7)) == within
    near = rows(lsh_topk(qdf, vdf, 7, tables=16, bits=3))
    assert len(set(near) & set(want)) > len(want) * 0.7
    assert rows(lsh_topk(qdf, vdf, 7, tables=16, bits=3, block_numbers=8)) == near
    assert rows(cosine_topk_within(qdf, vdf, adf, 7, block_numbers=8)) == within
    none = qdf.filter("false")
    assert cosine_topk(none, vdf, 7).count() == 0


def test_graph_build_and_search(spark, corpus, graph):
    nodes, edges = graph
    rels = {(r.src_type, r.rel, r.dst_type) for r in edges.collect()}
    assert ("Company", "OPERATES_IN", "Domain") in rels and ("Project", "USES", "Technology") in rels
    with pytest.raises(ValueError):
        G.make_edges(edges, "Skill", "HAS_SKILL", "Person", "src", "dst", "src")
    queries = table(
        spark, dict(required_domains=["FinTech"]), dict(companies=["Norvik", "Navy"]),
        dict(companies=["Norvik"], required_domains=["Billing"]), dict(projects=["Nope"]),
    )
    terms = S.query_terms(S.complete_queries(queries))
    found = G.graph_search(terms, nodes, edges).join(corpus.people, "person_id").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r.full_name.split()[0])
    assert {k: sorted(v) for k, v in got.items()} == {
        "q0": ["Ada", "Grace", "Linus"], "q1": ["Grace"], "q2": ["Ada"],
    }
    report = G.sync_report(corpus.people, edges).first()
    assert (report.total, report.synced, report.failed) == (3, 3, 0)
    again = G.replace_edges(edges, edges, edges.select("src"))
    assert again.count() == edges.count()
    assert G.merge_nodes(nodes, nodes).count() == nodes.count()


def brute_paths(nodes, edges, start, hops, limit):
    name = {n.node_id: n.name for n in nodes}
    near = {}
    for e in edges:
        near.setdefault(e.src, []).append((name[e.dst], e.edge_id, e.dst))
        near.setdefault(e.dst, []).append((name[e.src], e.edge_id, e.src))
    found, level = [], [((), start)]
    for _ in range(hops):
        level = [
            (path + ((n, e),), nbr) for path, at in level for n, e, nbr in near.get(at, [])
            if e not in [s[1] for s in path]
        ]
        found += [p for p, _ in level]
    return sorted(found, key=lambda p: (len(p), p))[:limit]


@pytest.mark.parametrize("hops,limit", [(1, 3), (2, 10), (3, 25), (3, 4), (3, 100000)])
def test_paths_against_brute_force(spark, hops, limit):
    rng = random.Random(hops * 100 + limit)
    links = set()
    for i in range(40):
        links.add((f"p{rng.randint(0, 6)}", rng.choice(["WORKED_AT", "HAS_SKILL"]), f"e{min(rng.randint(0, 9), rng.randint(0, 9))}"))
    kinds = {"WORKED_AT": "Company", "HAS_SKILL": "Skill"}
    edges = None
    for rel, kind in kinds.items():
        df = spark.createDataFrame([(s, d) for s, r, d in links if r == rel], "s string, d string")
        part = G.make_edges(df, "Person", rel, kind, "s", "d", "s")
        edges = part if edges is None else edges.unionByName(part)
    ids = sorted({x for s, _, d in links for x in (s, d)})
    nodes = spark.createDataFrame([(i, "Any", f"N{i[-1]}", i) for i in ids],
                                  "node_id string, node_type string, name string, key string")
    people = [i for i in ids if i.startswith("p")]
    subjects = spark.createDataFrame([(p,) for p in people], "person_id string")
    got = {}
    for r in G.graph_paths(subjects, nodes, edges, hops, limit).orderBy("person_id", "position").collect():
        got.setdefault(r.person_id, []).append(tuple(zip(r.nodes[1:], r.edge_ids)))
        assert r.score == 1 / r.hops
    edge_rows, node_rows = edges.collect(), nodes.collect()
    for p in people:
        assert got.get(p, []) == brute_paths(node_rows, edge_rows, p, hops, limit)
    with pytest.raises(ValueError):
        G.graph_paths(subjects, nodes, edges, 4)


def test_paths_behind_a_hub_stop_at_the_limit(spark, monkeypatch):
    links = [(f"p{i:02}", f"h{i % 2}") for i in range(40)] + [(f"p{i:02}", "all") for i in range(40)] + [("lone", "end")]
    edges = G.make_edges(spark.createDataFrame(links, "s string, d string"), "Person", "HAS_SKILL", "Skill", "s", "d", "s")
    ids = sorted({x for pair in links for x in pair})
    nodes = spark.createDataFrame([(i, "Any", i, i) for i in ids], "node_id string, node_type string, name string, key string")
    subjects = spark.createDataFrame([(s,) for s in sorted({s for s, _ in links})], "person_id string")
    written = []
    own = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(own(df)) or written[-1])
    monkeypatch.setattr(G, "CROWD", 3)  # hubs in several parts
    got = {}
    for r in G.graph_paths(subjects, nodes, edges, 3, 5).orderBy("person_id", "position").collect():
        got.setdefault(r.person_id, []).append(tuple(zip(r.nodes[1:], r.edge_ids)))
    edge_rows, node_rows = edges.collect(), nodes.collect()
    for p in sorted({s for s, _ in links}):
        assert got.get(p, []) == brute_paths(node_rows, edge_rows, p, 3, 5)
    hops = [r.size for df in written if "path" in df.columns for r in df.selectExpr("size(path) AS size").collect()]
    assert max(hops) == 2  # everybody but the lone person has five paths of up to two hops


def test_relevant_paths(spark, corpus, graph):
    nodes, edges = graph
    everyone = corpus.people.select(F.lit("q").alias("query_id"), "person_id")
    terms = spark.createDataFrame([("q", "navy")], "query_id string, term string")
    rows = G.relevant_paths(everyone, terms, nodes, edges, 3).collect()
    best = {r.nodes[0].split()[0]: r.hops for r in rows if r.position == 1}
    # Ada reaches Navy through the shared employer and its colleague.
    assert best == {"Grace": 1, "Ada": 3, "Linus": 3}
    assert all(any("Navy" == n for n in r.nodes) for r in rows)
    explained = G.explain_paths(
        G.graph_paths(corpus.people.select("person_id"), nodes, edges, 1), corpus.document_chunks
    )
    assert all(" → " in r.claim for r in explained.collect())
    cited = G.path_evidence(
        G.graph_paths(corpus.people.select("person_id"), nodes, edges, 1, 1),
        corpus.document_chunks, ["person_id"],
    )
    assert cited.count() == corpus.document_chunks.count()


def test_relevant_paths_of_every_length(spark, corpus, graph):
    nodes, edges = graph
    everyone = corpus.people.select(F.lit("q").alias("query_id"), "person_id")
    terms = spark.createDataFrame([("q", "fintech"), ("q", "navy")], "query_id string, term string")
    rows = G.relevant_paths(everyone, terms, nodes, edges, 3, per_person=1000).collect()
    got = sorted((r.person_id, tuple(r.edge_ids)) for r in rows)
    steps = {}
    for r in G.adjacency(edges, nodes).collect():
        steps.setdefault(r.node, []).append((r.nbr, r.step.edge_id))
    asked = {r.node for r in G.matching_nodes(terms, nodes).collect()}

    def walk(node, used):
        for nbr, edge in steps.get(node, ()):
            if edge not in used:
                if nbr in asked:
                    yield (*used, edge)
                elif len(used) < 2:
                    yield from walk(nbr, (*used, edge))

    people = [r.person_id for r in everyone.collect()]
    assert not asked & set(people)
    assert got == sorted((p, path) for p in people for path in walk(p, ()))
    assert {len(path) for _, path in got} == {1, 2, 3}


def test_golden_score(spark):
    values = dict(semantic=0.8, skills=1.0, domains=1.0, experience=1.0, graph=0.5, location=1.0, preference=1.0)
    df = spark.createDataFrame([values])
    assert df.select(R.weighted_score().alias("s")).first().s == pytest.approx(0.89)
    with pytest.raises(ValueError):
        R.check_weights({k: 0 for k in values})


def test_pool_rules(spark):
    def two(rows):
        return spark.createDataFrame(rows, "query_id string, person_id string")

    flags = spark.createDataFrame(
        [("hard", True, True), ("stop", True, False), ("open", False, False), ("dry", False, False)],
        "query_id string, has_hard_filters boolean, use_graph boolean",
    )
    structured = two([("hard", "a"), ("hard", "b"), ("open", "a"), ("dry", "z")])
    vector = two([("hard", "x"), ("stop", "x"), ("open", "v"), ("open", "v")])
    graph = two([("hard", "b"), ("hard", "c")])
    got = sorted(tuple(r) for r in R.candidate_pool(flags, structured, vector, graph).collect())
    assert got == [("dry", "z"), ("hard", "b"), ("open", "v")]


def test_rerank_contract(spark):
    ranked = spark.createDataFrame(
        [("q", f"p{i}", i + 1) for i in range(5)], "query_id string, person_id string, position int"
    )
    proposed = spark.createDataFrame(
        [("q", "p2", 1), ("q", "ghost", 2), ("q", "p2", 3), ("q", "p0", 4), ("q", "p4", 5)],
        "query_id string, person_id string, place int",
    )
    rows = R.rerank(ranked, proposed, top_n=3).orderBy("rerank_position").collect()
    assert [r.person_id for r in rows] == ["p2", "p0", "p1", "p3", "p4"]
    assert sorted(r.position for r in rows) == [1, 2, 3, 4, 5]
    flipped = R.rerank(ranked, proposed, 3, "rerank").orderBy("position").collect()
    assert flipped[0].person_id == "p2"


def test_search_end_to_end(spark, corpus, graph):
    queries = table(
        spark,
        dict(text="fintech backend", country="Germany", required_skills=["Python"],
             required_domains=["FinTech"], role="Ledger Engineer", semantic_query="payment platforms"),
        dict(text="compilers", semantic_query="Candidate Grace Hopper compilers"),
        dict(text="nobody", city="Atlantis", semantic_query="payment"),
    )
    result = search(queries, corpus, PROVIDER, graph, SearchConfig(limit=5, minimum_score=0.0))
    rows = result.candidates.orderBy("query_id", "position").collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    # Linus has Germany and Python, but reaches FinTech through a project, which is no domain.
    assert [r.full_name.split()[0] for r in by["q0"]][0] == "Ada"
    top = by["q0"][0]
    assert (top.skills, top.domains, top.experience, top.graph, top.location) == (1, 1, 1, 1, 1)
    assert by["q1"][0].full_name == "Grace Hopper"
    assert "q2" not in by
    plan = {r.query_id: r.strategy for r in result.strategies.collect()}
    assert plan["q0"] == ["structured", "vector", "graph"]
    assert plan["q1"] == ["structured", "vector"] and plan["q2"] == ["structured"]
    sources = {r.source for r in result.evidence.filter("query_id = 'q0'").collect()}
    assert sources == {"structured", "vector", "graph"}
    claims = {r.claim for r in result.reasons.filter("query_id = 'q0'").collect()}
    assert "Evidence mentions required skill or technology: Python" in claims
    assert any("→" in c for c in claims)


def test_answers(spark, corpus):
    texts = spark.createDataFrame([("a", "Python в казани"), ("b", "compilers")], "query_id string, text string")

    def answer(prompts):
        out = []
        for p in prompts:
            first = json.loads(p)["candidates"][0]
            cited = first["evidence"][0]["evidence_id"]
            if "compilers" in p:
                cited = "invented"
            out.append(json.dumps({"answer": "ok", "claims": [{
                "candidate_id": first["candidate_id"], "claim": "c", "kind": "fact",
                "confidence": 1.0, "evidence_ids": [cited]}], "limitations": []}))
        return out

    done = answer_queries(
        texts, corpus, PROVIDER, config=SearchConfig(minimum_score=0.0), answer_provider=answer
    )
    intent = {r.query_id: r for r in done.intents.collect()}
    assert intent["a"].required_skills == ["Python"] and intent["a"].cities == ["Казань"]
    got = {r.query_id: (r.answer, r.accepted) for r in done.answers.collect()}
    assert got == {"a": ("ok", True), "b": (None, False)}
    assert done.result.candidates.filter("query_id = 'b'").count() > 0


def test_team_end_to_end(spark, corpus):
    from evidex.operators.team import REQUEST

    def role(name, count, skills):
        return (name, count, None, None, None, None, None, skills, None, None, None, None)

    requests = spark.createDataFrame(
        [("r1", "build", 5, 0.1, [role("Engineer", 2, ["Python"]), role("Admiral", 2, ["COBOL"])])],
        REQUEST,
    )
    selection, total, _ = build_teams(requests, corpus, PROVIDER)
    rows = selection.orderBy("role_no", "slot").collect()
    people = [r.person_id for r in rows if r.person_id]
    assert len(people) == len(set(people)) == 3
    assert rows[3].person_id is None and "No remaining" in rows[3].reason
    assert total.first().unfilled == 1


def test_demo_corpus(spark):
    rows = demo_records(spark, 50).collect()
    assert len({r.full_name for r in rows}) == 50 and len({r.summary for r in rows}) == 50
    assert all(len(r.experience) >= 2 and 20 <= r.age < 65 for r in rows)
    assert len({(r.current_title, r.location) for r in rows}) == 25
    many = demo_records(spark, 20_000)
    assert many.select("id").distinct().count() == many.select("full_name").distinct().count() == 20_000
    result = ingest_structured(empty_corpus(spark), demo_documents(spark, 50))
    assert result.report.first().created == 50
