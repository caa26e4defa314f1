"""Stateful ingestion and bucketed tables against plain versions."""

import hashlib
import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import Row

from evidex.schemas import TABLES
from evidex.session import work_folder
from evidex.sources.buckets import BucketTable, CorpusStore
from evidex.streaming import stateful
from evidex.streaming.stateful import delivery_outcomes, delivery_report, documents_table, ingest_delivery


def test_outcomes_over_deliveries(spark, tmp_path):
    landing, root, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    landing.mkdir()

    def run(source):
        ingest_delivery(spark, str(landing), root, marks, source, buckets=4)
        rows = delivery_outcomes(spark, root).collect()
        last = max(r.delivery for r in rows)
        return Counter(r.outcome for r in rows if r.delivery == last)

    def lines(name, *records):
        (landing / name).write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in records))

    lines("a.jsonl", {"id": "1", "t": "one"}, {"id": "2", "t": "two"}, {"id": "3", "t": "three"}, "[broken")
    assert run("x") == {"created": 3}
    # Same again, one edit, a second version within the delivery, other formats.
    lines("b.jsonl", {"id": "1", "t": "one"}, {"id": "2", "t": "2nd"}, {"id": "3", "t": "3rd"}, {"id": "3", "t": "three"})
    (landing / "c.csv").write_text('id,t\n4,four\n1,one\n')
    (landing / "d.json").write_text(json.dumps({"records": [{"id": "5", "t": "five"}]}))
    (landing / "e.txt").write_text("plain words")
    (landing / "f.pdf").write_text("not read")
    assert run("x") == {"unchanged": 2, "updated": 3, "created": 3}
    # Another source: held texts are duplicates, the text given up before is free.
    lines("g.jsonl", {"id": "1", "t": "one"}, {"id": "2", "t": "two"}, {"id": "2", "t": "2nd"}, {"id": "5", "t": "five"})
    assert run("y") == {"duplicate": 3, "created": 1}
    # Nothing new is no delivery.
    before = delivery_outcomes(spark, root).count()
    ingest_delivery(spark, str(landing), root, marks, "y", buckets=4)
    assert delivery_outcomes(spark, root).count() == before
    report = delivery_report(spark, root).first()
    assert (report.failed, report.created, report.duplicates, report.total) == (2, 7, 3, before + 2)
    held = {(r.source, r.external_id): json.loads(r.raw_text).get("t") for r in documents_table(spark, root, 4).read().collect() if r.document_type != "text"}
    assert held == {("x", "1"): "one", ("x", "2"): "2nd", ("x", "3"): "three", ("x", "4"): "four", ("x", "5"): "five", ("y", "2"): "two"}


def test_state_is_read_not_the_corpus(spark, tmp_path, monkeypatch):
    landing, root, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    landing.mkdir()
    (landing / "a.jsonl").write_text("\n".join(json.dumps({"id": str(i), "t": f"text {i}"}) for i in range(40)))
    ingest_delivery(spark, str(landing), root, marks, "x", buckets=16)
    reads, changes = [], []
    plain = BucketTable.read
    monkeypatch.setattr(BucketTable, "read", lambda self, version=None, buckets=None: reads.append(buckets) or plain(self, version, buckets))
    (landing / "b.jsonl").write_text(json.dumps({"id": "7", "t": "edited"}) + "\n" + json.dumps({"id": "8", "t": "text 8"}))
    ingest_delivery(spark, str(landing), root, marks, "x", buckets=16, on_changes=lambda rows, n: changes.extend(r.external_id for r in rows.collect()))
    assert changes == ["7"]
    assert [len(b) for b in reads] == [1]  # the one bucket that the edit touches, for its merge
    assert documents_table(spark, root, 16).read().count() == 40


def test_a_delivery_leaves_no_copies_of_its_texts(spark, tmp_path):
    landing, root, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    landing.mkdir()

    def scratch():
        return {p.name for p in Path(work_folder(spark)).iterdir() if any(p.rglob("*.parquet"))}

    def log(delivery):
        return sorted(Path(root, "log", f"batch={delivery}").glob("*.parquet"))

    (landing / "a.csv").write_text("id,t\n1,one\n2,two\n3,\n")
    (landing / "b.jsonl").write_text('{"t": "x", "id": "7"}\n')
    (landing / "c.txt").write_text("plain words")
    spark.createDataFrame([(0,)], "n int").write.mode("ignore").parquet(f"{work_folder(spark)}/kept")
    before, changes = scratch(), []
    ingest_delivery(spark, str(landing), root, marks, "x", buckets=16, clear=True)
    ingest_delivery(spark, str(landing), root, marks, "x", buckets=16, clear=True)
    stored = {c for r in spark.read.parquet(*map(str, log(0))).collect() for c in [(r.document_type, r.payload)] if r.document_type == "csv"}
    assert stored == {("csv", None)}  # the raw text is the payload
    # What is classified needs tables of its own, which hold ids and checksums alone.
    assert not [p for p in scratch() - before if "raw_text" in spark.read.parquet(f"{work_folder(spark)}/{p}").columns]
    assert list(landing.glob("*.*")) == [] and documents_table(spark, root, 16).read().count() == 5
    (landing / "d.csv").write_text("id,t\n1,new\n2,two\n")
    (landing / "e.jsonl").write_text('{"t": "y", "id": "7"}\n')
    seen = lambda rows, n: changes.extend((r.external_id, r.raw_text, r.payload, r.outcome) for r in rows.collect())
    ingest_delivery(spark, str(landing), root, marks, "x", buckets=16, on_changes=seen)
    assert {c[0]: c[3] for c in changes} == {"1": "updated", "7": "updated"}
    assert {c[0]: (c[1], c[2]) for c in changes}["1"] == ('{"id":"1","t":"new"}',) * 2
    assert json.loads({c[0]: c[2] for c in changes}["7"]) == {"t": "y", "id": "7"}
    assert sorted(p.name for p in landing.glob("*.*")) == ["d.csv", "e.jsonl"]  # kept unless asked


def test_facts_of_several_deliveries_in_one_batch(spark):
    stored = spark.createDataFrame([("a", "c1", ""), ("b", "c2", "")], "document_id string, checksum string, person_id string")
    outcomes = spark.createDataFrame(
        [("a", 1, "c3", "updated"), ("a", 2, "c4", "updated"), ("b", 3, "c2", "unchanged"), ("c", 4, "c5", "created"), ("d", 5, "c2", "duplicate")],
        "document_id string, seq long, checksum string, outcome string",
    )
    after = stateful.apply_outcomes(stored, outcomes)
    assert {(r.document_id, r.checksum) for r in after.collect()} == {("a", "c4"), ("b", "c2"), ("c", "c5")}
    facts = {(r.kind, r.key, r.value) for r in stateful.new_facts(stored, after, 3).collect()}
    assert facts == {("document", "a", "c4"), ("checksum", "c4", "a"), ("checksum", "c1", None), ("document", "c", "c5"), ("checksum", "c5", "c")}


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "t"), "k string, n int, v string", ["k"], 8)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_merge_writes_only_touched_buckets(spark, table):
    base = [(f"k{i}", n, "old") for i in range(50) for n in range(2)] + [(None, 0, "old")]
    ddl = "k string, n int, v string"
    first = table.merge(spark.createDataFrame(base, ddl))
    assert first.version == 1 and len(first.written) == 8
    change = spark.createDataFrame([("k3", 9, "new"), (None, 1, "new"), ("fresh", 0, "new")], ddl)
    done = table.merge(change, spark.createDataFrame([("k4",)], "k string"))
    assert done.version == 2 and len(done.written) <= 4
    folders = sorted(p.name for p in Path(table.path, "data", "v=2").iterdir() if p.name.startswith("bucket="))
    assert folders == sorted(f"bucket={b}" for b in done.written)
    _, places = table.places()
    assert {b for b, p in places.items() if p == 2} == set(done.written)
    gone = {"k3", "k4", None}
    want = Counter([r for r in base if r[0] not in gone] + [("k3", 9, "new"), (None, 1, "new"), ("fresh", 0, "new")])
    assert rows_of(table.read()) == want and rows_of(table.read(1)) == Counter(base)
    only = table.read(buckets=[done.written[0]])
    assert 0 < only.count() < 60


def test_vacuum_and_emptied_buckets(spark, table):
    ddl = "k string, n int, v string"
    base = [(f"k{i}", i, "v") for i in range(20)]
    table.merge(spark.createDataFrame(base, ddl))
    table.merge(spark.createDataFrame([("k1", 1, "w")], ddl))
    table.merge(spark.createDataFrame([], ddl))
    assert table.places()[0] == 3
    assert table.vacuum(keep=2) == 1  # the bucket of k1 in version 1
    assert table.vacuum(keep=1) == 0
    assert rows_of(table.read()) == Counter([r for r in base if r[0] != "k1"] + [("k1", 1, "w")])
    table.merge(spark.createDataFrame([], ddl), spark.createDataFrame([(f"k{i}",) for i in range(20)], "k string"))
    assert table.read().count() == 0 and table.vacuum() > 0
    table.merge(spark.createDataFrame([("z", 1, "z")], ddl))
    assert rows_of(table.read()) == Counter([("z", 1, "z")])
    with pytest.raises(ValueError):
        BucketTable(spark, table.path, ddl, ["k"], 9).merge(spark.createDataFrame([], ddl))
    with pytest.raises(ValueError):
        table.read(1)


def test_second_writer_of_a_version_fails(spark, table, monkeypatch):
    ddl = "k string, n int, v string"
    table.merge(spark.createDataFrame([("a", 1, "v")], ddl))
    table.merge(spark.createDataFrame([("a", 2, "v")], ddl))
    monkeypatch.setattr(table, "places", lambda version=None: BucketTable.places(table, 1))
    with pytest.raises(Exception, match="(?i)already exists"):
        table.merge(spark.createDataFrame([("b", 1, "v")], ddl))


def test_corpus_store(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "c"), 4)
    sha = hashlib.sha256(b"x").hexdigest()
    chunk = spark.createDataFrame(
        [("c1", "d1", "p1", "summary", 0, "text", sha, {}, [0.5], "m"), ("c2", "d1", "p1", "summary", 1, "more", sha, {}, [0.5], "m")],
        TABLES["document_chunks"],
    )
    links = spark.createDataFrame([("p1", "s1"), ("p1", "s2")], TABLES["person_skills"])
    store.merge({"document_chunks": chunk, "person_skills": links})
    done = store.merge({"document_chunks": chunk.filter("ordinal = 0"), "person_skills": links})
    assert len(done["document_chunks"].written) == 1
    corpus = store.read()
    assert corpus.document_chunks.count() == 1 and corpus.person_skills.count() == 2 and corpus.people.count() == 0
    assert store.vacuum() > 0 and store.read().document_chunks.count() == 1


def test_keys_of_a_slot_share_one_state_value():
    class Value:
        held, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return value

    value = Value()
    facts = stateful.Facts()
    facts.init(Handle())
    none = {"document_id": None, "checksum": None, "delivery": None}

    def told(i, text, version):
        return Row(kind="document", key=f"k{i}", value=text, version=version, asked=False, **none)

    def ask(i):
        return Row(kind="document", key=f"k{i}", value=None, version=None, asked=True, document_id=f"k{i}", checksum="c", delivery=0)

    def run(*rows):
        value.calls.clear()
        out = list(facts.handleInputRows((0,), iter(rows), None))
        return [(r.key, r.value, r.version, r.asked) for r in out]

    assert run(*[told(i, f"c{i}", 0) for i in range(100)], ask(3)) == [("k3", None, -1, True)] + [(f"k{i}", f"c{i}", 0, False) for i in range(100)]
    assert value.calls == ["get", "update"]
    assert run(told(3, None, 2), told(3, "late", 1), ask(3), ask(4)) == [("k3", "c3", 0, True), ("k4", "c4", 0, True), ("k3", None, 2, False)]
    assert run(ask(3), told(4, "old", 0)) == [("k3", None, 2, True)] and value.calls == ["get"]
