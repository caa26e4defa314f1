"""The stored vector index against brute force."""

import random

import numpy as np
import pytest

from evidex.operators import ann
from evidex.operators.ann import build_index, open_index, recall_of, train_cells
from evidex.operators.vector import cosine_topk
from tests.test_search import brute_topk

VECTORS = "vector_id string, person_id string, embedding array<double>"


@pytest.fixture(scope="module")
def clustered():
    rng = random.Random(12)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    return [
        (f"v{i:04d}", f"p{i % 7}", [c + rng.gauss(0, 0.4) for c in centres[min(int(rng.random() * 18), 11)]])
        for i in range(1500)
    ]


def rows(df):
    return sorted((r.query_id, r.position, r.vector_id) for r in df.collect())


def test_index_against_brute_force(spark, clustered, tmp_path):
    odd = [("bad1", "p", None), ("bad2", "p", [1.0, None] * 8), ("bad3", "p", [float("nan")] * 16), ("bad4", "p", [1.0, 2.0]), ("zero", "p", [0.0] * 16)]
    vectors = spark.createDataFrame(clustered + odd, VECTORS)
    path = str(tmp_path / "index")
    index = build_index(vectors, path)
    assert len(index.centroids) == round(1504**0.5) or len(index.centroids) == round(1503**0.5)
    assert index.recall >= ann.TARGET and index.probes < len(index.centroids)
    assert {r.vector_id for r in index.postings().collect()} == {v for v, _, _ in clustered} | {"zero"}
    asked = [(v, e) for v, _, e in clustered[::50]]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    exact = cosine_topk(queries, vectors.filter("vector_id like 'v%'"), 10)
    again = open_index(spark, path)
    assert (again.probes, again.dimension) == (index.probes, 16) and np.allclose(again.centroids, index.centroids)
    assert recall_of(again.search(queries, 10), exact) >= 0.9
    assert rows(again.search(queries, 10, probes=10**6)) == rows(exact)
    assert rows(again.search(queries, 10, block_numbers=64)) == rows(again.search(queries, 10))
    assert rows(exact) == brute_topk(asked, clustered, 10)
    assert again.search(queries.filter("false"), 5).count() == 0


def test_scan_is_pruned_by_the_probed_cells(spark, clustered, tmp_path):
    index = build_index(spark.createDataFrame(clustered, VECTORS), str(tmp_path / "index"))
    queries = spark.createDataFrame([("q", clustered[0][2])], "query_id string, embedding array<double>")
    found = index.search(queries, 5, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert found.count() == 5
    cells = {r.cell for r in index.postings().join(found, "vector_id").select("cell").collect()}
    assert len(cells) <= 2


def test_more_vectors_and_crowded_cells(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "FILE_ROWS", 20)
    same = [(f"s{i:03d}", "p", clustered[0][2]) for i in range(300)]
    index = build_index(spark.createDataFrame(clustered[:700], VECTORS), str(tmp_path / "index"), cells=9)
    index.add(spark.createDataFrame(same + clustered[700:], VECTORS))
    assert index.postings().count() == len(clustered) + 300
    query = spark.createDataFrame([("q", clustered[0][2])], "query_id string, embedding array<double>")
    assert [v for _, _, v in rows(index.search(query, 20, probes=1))] == [f"s{i:03d}" for i in range(20)]


def test_cells_of_few_rows():
    sample = np.eye(4)[[0, 0, 1, 2]]
    centroids = train_cells(sample, 9)
    assert centroids.shape == (4, 4) and np.allclose(np.linalg.norm(centroids, axis=1), 1)


def test_nothing_to_index(spark, tmp_path):
    with pytest.raises(ValueError):
        build_index(spark.createDataFrame([], VECTORS), str(tmp_path / "index"))
