"""A stored approximate vector index (F4): coarse quantiser and postings by cell.

``build_index`` trains the quantiser (spherical k-means) on a sample of at most
``SAMPLE_PER_CELL`` vectors a cell, indexes every vector, and measures how many cells a query must
probe: the smallest number, doubling, at which ``CALIBRATED`` sampled vectors find the target share
of their exact neighbours. Postings are a table partitioned by cell, whose files are bounded, so
that a crowded cell is many files rather than one task. A search finds the nearest cells of each
query, and its scan of the postings is pruned to the cells of its queries while it runs; a task
scores a cell only against the queries that probe it and keeps k rows per query.

What the driver holds is the quantiser: ``MAX_CELLS`` centroids at most, whatever the vectors.
Vectors of another length than the index, null ones, and those with null or non-finite entries are
not indexed; zero vectors are, with cosine 0 to all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.vectors import is_valid_vector
from evidex.operators.vector import BLOCK_NUMBERS, _all_hits, _Best, _emit, _HITS, _matrix, _query_blocks, _typed
from evidex.operators.vector import cosine_topk, top_per_query
from evidex.session import cut_lineage

MAX_CELLS, SAMPLE_PER_CELL, ROUNDS = 16_384, 64, 10
#: Vectors asked to measure recall, neighbours of each, and the share of them to be found.
CALIBRATED, NEIGHBOURS, TARGET = 200, 10, 0.95
FILE_ROWS = 200_000
_POSTING = "vector_id string, person_id string, embedding array<double>"
_META = "dimension int, probes int, recall double"


def train_cells(sample: np.ndarray, cells: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means; a cell without members starts again at the worst-placed row."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near, similarity = nearest_cells(sample, centroids, 1)
        cell = near[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = np.flatnonzero(norms[:, 0] == 0)
        centroids = np.divide(sums, norms, out=centroids.copy(), where=norms > 0)
        if len(empty):
            centroids[empty] = sample[np.argsort(similarity[:, 0], kind="stable")[: len(empty)]]
    return centroids


def nearest_cells(rows: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest cells of each row, nearest first, and their similarities."""
    cells, similar = [], []
    for i in range(0, len(rows), 4096):
        s = rows[i : i + 4096] @ centroids.T
        order = np.argsort(-s, axis=1, kind="stable")[:, :n]
        cells.append(order)
        similar.append(np.take_along_axis(s, order, axis=1))
    empty = np.zeros((0, min(n, len(centroids))))
    return (np.concatenate(cells) if cells else empty.astype(np.int64)), (np.concatenate(similar) if similar else empty)


@dataclass(frozen=True)
class StoredIndex:
    """An index below ``path``; ``probes`` cells per query reached ``recall`` when it was built."""

    spark: SparkSession
    path: str
    dimension: int
    probes: int
    recall: float
    centroids: np.ndarray

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"{_POSTING}, cell int").parquet(f"{self.path}/postings")

    def add(self, vectors: DataFrame) -> None:
        """Index further vectors with the cells at hand; ids must be new."""
        _write_postings(vectors, self.path, self.dimension, self.centroids)

    def search(
        self, queries: DataFrame, k: int = 100, probes: int | None = None, block_numbers: int = BLOCK_NUMBERS
    ) -> DataFrame:
        """Best k of the vectors in the nearest cells of each query (query_id, embedding).

        Columns as of ``vector.cosine_topk``. Queries go in blocks of bounded size, each with one
        pruned scan; with all cells probed the answer is the exact one.
        """
        probes = min(probes or self.probes, len(self.centroids))
        found = []
        for _, dimension, names, matrix in _query_blocks(queries, block_numbers):
            if dimension != self.dimension:
                continue
            cells, _ = nearest_cells(matrix, self.centroids, probes)
            asked: dict[int, list[int]] = {}
            for query, own in enumerate(cells.tolist()):
                for cell in own:
                    asked.setdefault(cell, []).append(query)
            wanted = cut_lineage(self.spark.createDataFrame([(c,) for c in asked], "cell int"))
            sent = self.spark.sparkContext.broadcast((names, matrix, asked))
            # A comparison on the cells lets Spark prune the scan by them at run time.
            met = self.postings().join(F.broadcast(wanted.filter("cell >= 0")), "cell", "left_semi")
            found.append(met.mapInArrow(_cell_searcher(sent, k), _HITS))
        return _all_hits(found, self.spark).transform(top_per_query, k)


def _usable(vectors: DataFrame, dimension: int) -> DataFrame:
    return _typed(vectors, "vector_id", "person_id").filter(is_valid_vector(F.col("embedding"), dimension))


def _assigned(vectors: DataFrame, dimension: int, centroids: np.ndarray) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, _ = nearest_cells(_matrix(batch.column("embedding")), sent.value, 1)
                yield batch.append_column("cell", pa.array(cell[:, 0].astype(np.int32)))

    return _usable(vectors, dimension).mapInArrow(assign, f"{_POSTING}, cell int")


def _write_postings(vectors: DataFrame, path: str, dimension: int, centroids: np.ndarray) -> None:
    rows = cut_lineage(_assigned(vectors, dimension, centroids))
    files = rows.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("files"))
    part = F.pmod(F.xxhash64("vector_id"), F.col("files")).cast("int")
    dealt = rows.join(files, "cell").withColumn("part", part)
    spread = max(1, min(len(centroids), dealt.sparkSession.sparkContext.defaultParallelism * 4))
    dealt.repartition(spread, "cell", "part").drop("files", "part").write.mode("append").partitionBy("cell").parquet(f"{path}/postings")


def build_index(
    vectors: DataFrame,
    path: str,
    cells: int | None = None,
    k: int = NEIGHBOURS,
    target: float = TARGET,
    seed: int = 7,
) -> StoredIndex:
    """Train, write and calibrate an index of ``vectors`` (vector_id, person_id, embedding).

    The length that most vectors have is that of the index. Without ``cells`` there are as many as
    the root of the number of vectors, ``MAX_CELLS`` at most.
    """
    spark = vectors.sparkSession
    sizes = vectors.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count()
    common = sizes.orderBy(F.desc("count"), "d").first()
    if common is None:
        raise ValueError("no vectors to index")
    dimension, count = common
    usable = _usable(vectors, dimension)
    cells = min(cells or max(1, round(count**0.5)), MAX_CELLS)
    drawn = usable.orderBy(F.xxhash64("vector_id", F.lit(seed)), "vector_id").limit(cells * SAMPLE_PER_CELL)
    sample = _matrix(drawn.select("embedding").toArrow().column("embedding").combine_chunks())
    if not len(sample):
        raise ValueError("no usable vectors to index")
    centroids = train_cells(sample, cells, seed)
    _write_postings(vectors, path, dimension, centroids)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    index = StoredIndex(spark, path, dimension, len(centroids), 1.0, centroids)
    asked = usable.orderBy(F.xxhash64("vector_id", F.lit(seed + 1)), "vector_id").limit(CALIBRATED)
    asked = cut_lineage(asked.select(F.col("vector_id").alias("query_id"), "embedding"))
    exact = cut_lineage(cosine_topk(asked, index.postings(), k))
    probes, reached = 1, recall_of(index.search(asked, k, 1), exact)
    while reached < target and probes < len(centroids):
        probes = min(2 * probes, len(centroids))
        reached = recall_of(index.search(asked, k, probes), exact)
    spark.createDataFrame([(dimension, probes, reached)], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return StoredIndex(spark, path, dimension, probes, reached, centroids)


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return StoredIndex(spark, path, meta.dimension, meta.probes, meta.recall, np.array([r.centroid for r in rows]))


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact answers' places whose score a query's found answers reach."""
    best = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    good = found.join(best, "query_id").filter(F.col("score") >= F.col("least") - 1e-9).groupBy("query_id").agg(F.count("*").alias("got"))
    row = best.join(good, "query_id", "left").agg(F.sum(F.least(F.coalesce("got", F.lit(0)), F.col("n"))), F.sum("n")).first()
    return row[0] / row[1] if row[1] else 1.0


def _cell_searcher(sent: Broadcast, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, asked = sent.value
        best = [_Best(k) for _ in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells).tolist():
                part = batch.filter(pa.array(cells == cell))
                queries = asked[cell]
                scores = matrix[queries] @ _matrix(part.column("embedding")).T
                ids = np.array(part.column("vector_id").to_pylist(), dtype=object)
                persons = np.array(part.column("person_id").to_pylist(), dtype=object)
                for query, row in zip(queries, scores, strict=True):
                    best[query].add(row, ids, persons)
        yield from _emit(names, best)

    return search
