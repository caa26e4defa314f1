"""Exact cosine top-k over chunk vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions.vectors import similarity_score

# Numbers (8 bytes each) of the query matrix that one scan ships to the tasks; more queries
# are answered in as many scans, so neither plan nor answer depends on their number.
BLOCK_NUMBERS = 4_000_000
_HITS = "query_id string, vector_id string, person_id string, cosine double"


def _matrix(column: pa.Array) -> np.ndarray:
    """List column of equal lengths as a matrix with unit rows; zero rows stay zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


class _Best:
    """Running top-k of one query: higher cosine first, then lower id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = np.empty(0)
        self.ids = np.empty(0, dtype=object)
        self.persons = np.empty(0, dtype=object)

    def add(self, scores: np.ndarray, ids: np.ndarray, persons: np.ndarray) -> None:
        if len(self.scores) >= self.k:
            keep = scores >= self.scores[-1]
            scores, ids, persons = scores[keep], ids[keep], persons[keep]
        if len(scores) > self.k:
            edge = np.partition(scores, -self.k)[-self.k]
            keep = scores >= edge
            scores, ids, persons = scores[keep], ids[keep], persons[keep]
        if not len(scores):
            return
        scores = np.concatenate([self.scores, scores])
        ids = np.concatenate([self.ids, ids])
        persons = np.concatenate([self.persons, persons])
        order = np.lexsort((ids.astype(str), -scores))[: self.k]
        self.scores, self.ids, self.persons = scores[order], ids[order], persons[order]


def top_per_query(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query. Spark limits every map task's groups before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vector_id")
    ranked = hits.withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= k).select(
        "query_id", "position", "vector_id", "person_id",
        similarity_score(F.col("cosine")).alias("score"),
    )


def _typed(df: DataFrame, *ids: str) -> DataFrame:
    return df.select(
        *[F.col(i).cast("string").alias(i) for i in ids],
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _query_blocks(
    queries: DataFrame, block_numbers: int
) -> Iterator[tuple[Column, int, list[str], np.ndarray]]:
    """Blocks of the query table: condition on query_id, dimension, ids and unit vectors.

    The block of a query is the class of its id's hash, and classes hold half the given size
    in the mean, so that each stays well within the size.
    """
    asked = _typed(queries.filter(F.size("embedding") > 0), "query_id")
    sizes = asked.groupBy(F.size("embedding").alias("dimension")).count().collect()
    for dimension, count in sorted(sizes):
        n = max(1, -(-2 * count * dimension // block_numbers)) if count * dimension > block_numbers else 1
        for number in range(n):
            chosen = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(n)) == number
            sent = asked.filter(chosen & (F.size("embedding") == dimension)).toArrow()
            if sent.num_rows:
                matrix = _matrix(sent.column("embedding").combine_chunks())
                yield chosen, dimension, sent.column("query_id").to_pylist(), matrix


def _all_hits(found: list[DataFrame], spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _HITS)


def cosine_topk(
    queries: DataFrame, vectors: DataFrame, k: int = 100, block_numbers: int = BLOCK_NUMBERS
) -> DataFrame:
    """Best k vectors per query over the whole corpus.

    ``queries``: query_id, embedding. ``vectors``: vector_id, person_id, embedding. Each block
    of queries is shipped and run over one scan; a task keeps k rows per query.
    """
    stored = _typed(vectors, "vector_id", "person_id")
    found = []
    for _, dimension, names, matrix in _query_blocks(queries, block_numbers):
        sent = queries.sparkSession.sparkContext.broadcast((names, matrix))
        usable = stored.filter(F.size("embedding") == dimension)
        found.append(usable.mapInArrow(_searcher(sent, k), _HITS))
    return _all_hits(found, queries.sparkSession).transform(top_per_query, k)


def _searcher(sent: Broadcast, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = sent.value
        best = [_Best(k) for _ in query_ids]
        for batch in batches:
            if batch.num_rows:
                _score(batch, query_matrix, best)
        yield from _emit(query_ids, best)

    return search


def _score(batch: pa.RecordBatch, query_matrix: np.ndarray, best: list[_Best]) -> None:
    scores = query_matrix @ _matrix(batch.column("embedding")).T
    ids = np.array(batch.column("vector_id").to_pylist(), dtype=object)
    persons = np.array(batch.column("person_id").to_pylist(), dtype=object)
    for row, kept in zip(scores, best):
        kept.add(row, ids, persons)


def _emit(query_ids: list[str], best: list[_Best]) -> Iterator[pa.RecordBatch]:
    for query_id, kept in zip(query_ids, best):
        if len(kept.scores):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([query_id] * len(kept.scores), pa.string()),
                    pa.array(kept.ids, pa.string()),
                    pa.array(kept.persons, pa.string()),
                    pa.array(kept.scores, pa.float64()),
                ],
                names=["query_id", "vector_id", "person_id", "cosine"],
            )


def cosine_within(
    queries: DataFrame, vectors: DataFrame, allowed: DataFrame, block_numbers: int = BLOCK_NUMBERS
) -> DataFrame:
    """Cosine of every allowed (query, vector): query_id, vector_id, person_id, cosine.

    ``allowed``: query_id, person_id. A person carries the list of the block's queries that may
    see them, so a stored vector is read once per block and a query vector is never shuffled.
    """
    stored = _typed(vectors, "vector_id", "person_id")
    pairs = allowed.select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("person_id").cast("string").alias("person_id"),
    )
    found = []
    for chosen, dimension, names, matrix in _query_blocks(queries, block_numbers):
        sent = queries.sparkSession.sparkContext.broadcast((names, matrix))
        lists = pairs.filter(chosen).groupBy("person_id").agg(F.collect_set("query_id").alias("asked"))
        usable = stored.filter(F.size("embedding") == dimension).join(lists, "person_id")
        found.append(usable.mapInArrow(_pair_scorer(sent), _HITS))
    return _all_hits(found, queries.sparkSession)


def cosine_topk_within(
    queries: DataFrame,
    vectors: DataFrame,
    allowed: DataFrame,
    k: int = 100,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """Best k vectors per query among its allowed persons (F2); none for a query without any."""
    return cosine_within(queries, vectors, allowed, block_numbers).transform(top_per_query, k)


def _pair_scorer(sent: Broadcast) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        number = {name: i for i, name in enumerate(names)}
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = batch.column("asked")
            query = [number.get(q, -1) for q in asked.flatten().to_pylist()]
            row = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy(zero_copy_only=False))
            query = np.array(query, dtype=np.int64)
            row, query = row[query >= 0], query[query >= 0]
            cosine = np.einsum("ij,ij->i", _matrix(batch.column("embedding"))[row], matrix[query])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in query], pa.string()),
                    batch.column("vector_id").take(pa.array(row)),
                    batch.column("person_id").take(pa.array(row)),
                    pa.array(cosine, pa.float64()),
                ],
                names=["query_id", "vector_id", "person_id", "cosine"],
            )

    return score


def lsh_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 100,
    tables: int = 8,
    bits: int = 12,
    seed: int = 17,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """Approximate top-k (F4): only vectors sharing a random-hyperplane bucket are scored.

    Takes the place of a stored index. Nothing is shuffled but the k rows per query and
    task, whatever the size of a bucket, and the answer is the same for any block size.
    """
    stored = _typed(vectors, "vector_id", "person_id")
    found = []
    for _, dimension, names, matrix in _query_blocks(queries, block_numbers):
        buckets = _Buckets(dimension, tables, bits, seed)
        sent = queries.sparkSession.sparkContext.broadcast((names, matrix, buckets(matrix)))
        usable = stored.filter(F.size("embedding") == dimension)
        found.append(usable.mapInArrow(_bucket_searcher(sent, buckets, k), _HITS))
    return _all_hits(found, queries.sparkSession).transform(top_per_query, k)


class _Buckets:
    """Bucket numbers of unit vectors, one per hash table."""

    def __init__(self, dimension: int, tables: int, bits: int, seed: int) -> None:
        self.shape = (tables, bits)
        self.planes = np.random.default_rng(seed).standard_normal((tables * bits, dimension))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        above = ((rows @ self.planes.T) > 0).reshape(len(rows), *self.shape)
        return above @ (1 << np.arange(self.shape[1]))


def _bucket_searcher(sent: Broadcast, buckets: _Buckets, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix, query_buckets = sent.value
        best = [_Best(k) for _ in query_ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("embedding"))
            codes = buckets(rows)
            ids = np.array(batch.column("vector_id").to_pylist(), dtype=object)
            persons = np.array(batch.column("person_id").to_pylist(), dtype=object)
            for query, own, kept in zip(query_matrix, query_buckets, best):
                met = np.flatnonzero((codes == own).any(axis=1))
                kept.add(rows[met] @ query, ids[met], persons[met])
        yield from _emit(query_ids, best)

    return search
