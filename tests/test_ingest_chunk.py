import json
import random
import re

import pytest
from pyspark.sql import functions as F

from evidex import empty_corpus
from evidex.operators.chunk import chunk_records, pack_blocks
from evidex.operators.embed import HashEmbedder, embed_chunks, embedding_of
from evidex.operators.resolve import classify, previous_value
from evidex.plans.ingest import ingest_structured, ingest_text
from evidex.sources.files import jsonl_documents, merge_documents, text_documents


def documents(spark, records, source="test"):
    """One ordered batch; a tuple (source, record) overrides the source."""
    parts = []
    for r in records:
        src, rec = r if isinstance(r, tuple) else (source, r)
        lines = spark.createDataFrame(
            [("f.json", json.dumps(rec, ensure_ascii=False), 0)], "file string, value string, seq long"
        )
        parts.append(jsonl_documents(lines, src)[0])
    return merge_documents(parts)


def counters(result):
    return result.report.first().asDict()


def test_idempotent_and_aliases(spark, ada):
    first = ingest_structured(empty_corpus(spark), documents(spark, [ada]), HashEmbedder(16))
    assert counters(first)["created"] == 1
    second = ingest_structured(first.corpus, documents(spark, [ada]), HashEmbedder(16))
    report = counters(second)
    assert (report["unchanged"], report["skipped"], report["created"]) == (1, 1, 0)
    c = second.corpus
    assert sorted(r.normalized_name for r in c.skills.collect()) == ["postgresql", "python"]
    assert c.skill_aliases.count() == 3
    assert sorted(r.name for r in c.technologies.collect()) == [
        "Amazon Web Services", "Graph Neural Networks", "Kubernetes",
    ]
    assert sorted(r.name for r in c.domains.collect()) == ["Billing", "FinTech"]
    assert c.company_domains.count() == 1 and c.project_domains.count() == 1
    assert second.embeddings.first().unchanged == 1
    assert first.embeddings.first().created == 1


def test_update_keeps_person_and_chunk_ids(spark, ada):
    first = ingest_structured(empty_corpus(spark), documents(spark, [ada]), HashEmbedder(16))
    ids = {r.ordinal: r.chunk_id for r in first.corpus.document_chunks.collect()}
    changed = dict(ada, current_title="Staff Engineer", skills=["Python", "Kafka"], summary=None)
    second = ingest_structured(first.corpus, documents(spark, [changed]), HashEmbedder(16))
    assert counters(second)["updated"] == 1
    people = second.corpus.people.collect()
    assert len(people) == 1
    assert people[0].current_title == "Staff Engineer"
    assert people[0].summary == ada["summary"]
    assert second.corpus.person_skills.count() == 3
    assert second.embeddings.first().updated == 1
    after = {r.ordinal: r.chunk_id for r in second.corpus.document_chunks.collect()}
    assert after == ids
    assert second.corpus.raw_documents.count() == 1


def test_duplicates_identity_and_failures(spark, ada):
    other = dict(ada, id="ada-2", summary="Other text", country=" germany ")
    twin = ("elsewhere", ada)
    bad = {"id": "invalid", "skills": []}
    result = ingest_structured(empty_corpus(spark), documents(spark, [ada, other, twin, bad]))
    report = counters(result)
    assert report == {
        "total": 4, "created": 2, "updated": 0, "unchanged": 0, "duplicates": 1,
        "skipped": 1, "failed": 1,
    }
    assert result.corpus.people.count() == 1
    assert result.corpus.raw_documents.count() == 2
    assert [r.external_id for r in result.quarantine.collect()] == ["invalid"]
    third = dict(ada, id="ada-3", summary="Third")
    again = ingest_structured(result.corpus, documents(spark, [("third", third)]))
    assert again.corpus.people.count() == 1


def test_name_without_country_never_merges(spark):
    rows = [{"id": str(i), "full_name": "Same Name", "summary": str(i)} for i in range(2)]
    result = ingest_structured(empty_corpus(spark), documents(spark, rows))
    assert result.corpus.people.count() == 2


def test_versions_within_a_batch(spark, ada):
    v2 = dict(ada, summary="v2")
    batch = documents(spark, [ada, ada, v2, v2, ada])
    result = ingest_structured(empty_corpus(spark), batch)
    report = counters(result)
    assert (report["created"], report["unchanged"], report["updated"]) == (1, 2, 2)
    assert result.corpus.people.first().summary == ada["summary"]


def test_previous_value_crosses_blocks(spark):
    rows = [("k" if i % 3 else "other", (i // 7 << 33) + i % 7, f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "key string, seq long, value string")
    got = {r.seq: r.prev for r in previous_value(df, "key", "seq", "value", "prev").collect()}
    last = {}
    for key, seq, value in sorted(rows, key=lambda r: r[1]):
        assert got[seq] == last.get(key)
        last[key] = value


def test_partition_count_does_not_matter(spark, ada):
    rows = [dict(ada, id=str(i % 7), summary=f"s{i % 5}", full_name=f"N{i % 3}") for i in range(20)]
    docs = documents(spark, rows)
    empty = empty_corpus(spark)
    wide = sorted(map(tuple, classify(docs, empty.raw_documents).collect()))
    narrow = sorted(map(tuple, classify(docs.coalesce(1), empty.raw_documents).collect()))
    assert wide == narrow


def test_text_ingest(spark):
    files = spark.createDataFrame(
        [("a.txt", "Grace Hopper\nAdmiral\nCOBOL\nNavy"), ("b.txt", "BAD vector")],
        "file string, value string",
    )
    docs, _ = text_documents(files)

    def extract(prompts):
        return [
            json.dumps({"full_name": p.split("\n")[0], "summary": p, "skills": ["COBOL"]})
            for p in prompts
        ]

    class Picky(HashEmbedder):
        def embed(self, texts):
            return [
                [float("nan")] * self.dimension if "BAD" in t else v
                for t, v in zip(texts, super().embed(texts))
            ]

    first = ingest_text(empty_corpus(spark), docs, extract, Picky(8))
    assert counters(first)["created"] == 1 and counters(first)["failed"] == 1
    assert [r.full_name for r in first.corpus.people.collect()] == ["Grace Hopper"]
    person = first.corpus.people.first().person_id
    assert {r.person_id for r in first.corpus.document_chunks.collect()} == {person}
    second = ingest_text(first.corpus, docs, extract, Picky(8))
    assert counters(second)["unchanged"] == 1
    assert second.corpus.document_chunks.count() == first.corpus.document_chunks.count()


def resume_frame(spark, record):
    from evidex.operators.parse import parse_records

    good, _ = parse_records(documents(spark, [record]))
    return good.withColumns({"document_id": F.lit("d"), "person_id": F.lit("p")})


def test_sections(spark, ada):
    rows = chunk_records(resume_frame(spark, ada)).orderBy("ordinal").collect()
    assert [r.section for r in rows] == ["summary", "experience", "project", "education", "skills"]
    assert [r.ordinal for r in rows] == list(range(5))
    assert rows[1].content.startswith("EXPERIENCE: Norvik\n\nTitle: Bookkeeper of machines\n\nDates: 2020-09 — present")
    assert rows[1].metadata["company_name"] == "Norvik" and "company_id" in rows[1].metadata
    assert "Years of experience: 8.0" in rows[0].content


def test_long_section(spark, ada):
    ada["experience"][0]["description"] = " ".join(f"Sentence number {i} ends." for i in range(60))
    rows = [
        r for r in chunk_records(resume_frame(spark, ada), 300).orderBy("ordinal").collect()
        if r.section == "experience"
    ]
    assert len(rows) > 1
    assert all(len(r.content) <= 300 and r.content.startswith("EXPERIENCE: Norvik") for r in rows)
    assert [r.metadata["section_part"] for r in rows] == [str(i) for i in range(len(rows))]
    with pytest.raises(ValueError):
        chunk_records(resume_frame(spark, ada), 100)


def expected_pack(header, blocks, size):
    """Brute force: a stream of atoms, each with the separator it may be glued with."""
    limit = max(size - len(header) - 2, 1)

    def glue(atoms):
        out, buf = [], None
        for text, alone in atoms:
            if alone:
                out += ([buf] if buf else []) + [text]
                buf = None
            elif buf is None:
                buf = text
            elif len(buf) + 1 + len(text) <= limit:
                buf += " " + text
            else:
                out.append(buf)
                buf = text
        return out + ([buf] if buf else [])

    def word_atoms(word):
        parts = [word[i : i + limit] for i in range(0, len(word), limit)]
        return [(p, True) for p in parts[:-1]] + [(parts[-1], False)]

    pieces = []
    for block in blocks:
        if len(block) <= limit:
            pieces.append(block)
            continue
        atoms = []
        for s in re.split(r"(?<=[.!?])\s+", block):
            if len(s) > limit:
                atoms += [(p, True) for p in glue([a for w in s.split() for a in word_atoms(w)])]
            else:
                atoms.append((s, False))
        pieces += glue(atoms)
    out, cur = [], header
    for p in pieces:
        if len(cur) + 2 + len(p) <= size:
            cur += "\n\n" + p
        else:
            out.append(cur)
            cur = header + "\n\n" + p
    return out + [cur]


def test_packing_against_brute_force(spark):
    rng = random.Random(7)

    def word():
        return "w" * rng.choice([1, 3, 8, 8, 12, 260, 700])

    def block():
        words = [word() + rng.choice(["", "", "", ".", "!"]) for _ in range(rng.randint(1, 40))]
        return rng.choice([" ", "  "]).join(words)

    cases = [(i, "HEAD" * rng.randint(1, 5), [block() for _ in range(rng.randint(0, 5))])
             for i in range(60)]
    df = spark.createDataFrame(cases, "i int, h string, b array<string>")
    rows = df.select("i", pack_blocks(F.col("h"), F.col("b"), 220).alias("c")).collect()
    got = {r.i: r.c for r in rows}
    for i, header, blocks in cases:
        assert got[i] == expected_pack(header, blocks, 220)


def test_embedding_batches_and_validation(spark):
    class Recorder(HashEmbedder):
        def embed(self, texts):
            return [[float(len(texts))] * self.dimension for _ in texts]

    df = spark.createDataFrame([(str(i),) for i in range(3)], "content string").coalesce(1)
    sizes = [
        r.v[0] for r in df.select(embedding_of(F.col("content"), Recorder(4), 2).alias("v")).collect()
    ]
    assert sorted(sizes) == [1.0, 2.0, 2.0]
    bad = spark.createDataFrame([("x",), (" ",)], "content string")
    assert embed_chunks(bad, HashEmbedder(4)).filter("valid").count() == 1

    class Wrong(HashEmbedder):
        def embed(self, texts):
            return [[1.0]] * len(texts)

    assert embed_chunks(bad, Wrong(4)).filter("valid").count() == 0
