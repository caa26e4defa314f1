"""The pipeline against a plain version of each stage, and the registered queries."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from evidex.llm import decontaminate, mixing, shard, toxicity
from tests.llm.test_similar import plain_components


@pytest.fixture(scope="module")
def folder(tables, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = tables["documents"].selectExpr("doc_id", "text", "lang", "source", "cast(n_chars AS long) AS n_chars")
    docs.union(odd).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        tables[name].write.parquet(f"{path}/{name}.parquet")
    return path


def test_run_matches_plain_stages(spark, tables, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding",
    ]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = tables["labels"]
    clean = [(r.doc_id, r.text, r.lang) for r in toxicity.score(docs, labels).filter("predicted = 0").collect()]

    smallest = plain_components([(d, t) for d, t, _ in clean])
    once, seen = [], set()
    for row, least in zip(clean, smallest, strict=True):
        if row[0] is None or (row[0] == least and row[0] not in seen):
            once.append(row)
            seen.add(row[0])

    items = [decontaminate.normal(r.text) for r in tables["benchmark"].collect()]
    kept = [r for r in once if not any(i and i in decontaminate.normal(r[1]) for i in items)]
    assert len(kept) < len(once) < len(clean) < docs.count()

    copies = mixing.mix(spark.createDataFrame(kept, "doc_id long, text string, lang string"), labels)
    want = Counter()
    names = [f"shard-{i:05d}" for i in range(shard.SHARDS)]
    table = dict(enumerate(shard.fill_table(names)))
    for r in copies.select("doc_id", "text", "copies").collect():
        want[(r.doc_id, r.text)] += r.copies
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [*docs.columns, "slot", "shard"]
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == +want
    assert all(r.shard == names[table[r.slot]] for r in rows)


def test_stages_keep_columns_and_bear_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'mine' AS rate", "'mine' AS hits", "1 AS fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.filter("false"), folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), folder).count() == 0


def test_every_operator_has_one_registered_query():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
