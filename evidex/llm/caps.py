"""Embedding near-duplicates by spherical-cap filters.

The filter directions are a structured random product code: the vector is rotated and cut into
``PARTS`` parts, each with ``WORDS`` random unit codewords, so WORDS ** PARTS directions need no
table. A vector is list-decoded to every direction whose inner product exceeds its cap, which
lies ``MARGIN`` below its best direction (so no vector is without a filter); vectors with
cosine >= 0.98 then share a direction with probability above 0.999 (measured against brute
force, see the tests). Vectors
meet on shared directions within their label, and exact double-precision cosines decide.

Equal vectors are compared once; buckets are cut into blocks of ``BLOCK_ROWS``; a pair counts only
in the first direction that both share; a task emits, per vector with a link, its number of links
and the smallest vector it reaches there, never the pairs.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components, rows with
a null label or of different lengths, link with nothing; a null vec_id links, takes the smallest
id of its component and is not kept; rows that repeat an id are answered one by one; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import block_pairs, components, group_numbers, local_roots, whole_groups
from evidex.session import cut_lineage

COSINE = 0.98
PARTS, WORDS = 4, 16
MARGIN = 0.03
BLOCK_ROWS = 2048
SEED = 11


class ProductCode:
    """Directions of one dimension; decode() lists those within ``margin`` of a vector's best."""

    def __init__(self, dim: int, parts: int = PARTS, words: int = WORDS, seed: int = SEED) -> None:
        rng = np.random.default_rng([seed, dim])
        parts = min(parts, dim)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), parts)
        self.code = []
        for cut in self.cuts:
            c = rng.standard_normal((len(cut), words))
            self.code.append(c / np.linalg.norm(c, axis=0) / np.sqrt(parts))

    def decode(self, unit: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all directions whose score is at least best - ``margin``."""
        turned = unit @ self.rotation
        score = [turned[:, cut] @ code for cut, code in zip(self.cuts, self.code, strict=True)]
        best = [s.max(axis=1) for s in score]
        rest = sum(best) - margin
        row, direction, got = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
        for i, s in enumerate(score):
            later = sum(best[i + 1 :], np.zeros(len(unit)))
            total = got[:, None] + s[row]
            keep, word = np.nonzero(total + later[row][:, None] >= rest[row][:, None] - 1e-12)
            got, direction, row = total[keep, word], direction[keep] * s.shape[1] + word, row[keep]
        return row, direction


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, margin: float = MARGIN, block: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    number = F.col("embedding").cast("array<double>")
    good = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(number, lambda v: v != 0)
    )
    rows = cut_lineage(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(good, F.xxhash64("label", F.size("embedding"), "embedding")).alias("node"),
            F.when(good, F.col("label")).alias("label"),
            F.when(good, F.col("embedding")).alias("embedding"),
        )
    )
    distinct = (
        rows.filter("node is not null")
        .groupBy("node", "label", "embedding")
        .agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    )
    distinct = cut_lineage(distinct.withColumn("dim", F.size("embedding")))
    keys = ["group", "lo", "hi"]

    def caps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                code = codes.setdefault(dim, ProductCode(dim))
                for at in range(0, part.num_rows, 1024):
                    piece = part.slice(at, 1024)
                    row, direction = code.decode(_matrix(piece.column("embedding")), margin)
                    ends = np.cumsum(np.bincount(row, minlength=piece.num_rows))
                    order = np.lexsort((direction, row))
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.r_[0, ends].astype(np.int32)), pa.array(direction[order])
                    )
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("node"), piece.column("label"), piece.column("dim"), piece.column("n"), piece.column("embedding"), lists],
                        ["node", "label", "dim", "n", "embedding", "filters"],
                    )

    types = dict(distinct.dtypes)
    decoded = distinct.select("node", "label", "dim", "n", "embedding").mapInArrow(
        caps, f"node long, label {types['label']}, dim int, n long, embedding {types['embedding']}, filters array<long>"
    )
    met = decoded.withColumn("filter", F.explode("filters")).withColumn("group", F.xxhash64("label", "dim", "filter"))
    met = met.select("node", "n", "embedding", "filters", "filter", "group", F.xxhash64("label", "dim").alias("kind"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            numbers = group_numbers(table, keys)
            starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
            for start, end in zip(starts, np.r_[starts[1:], len(numbers)], strict=True):
                if end - start > 1:
                    out = _verified(table.slice(start, end - start), cosine)
                    if out is not None:
                        yield out

    found = cut_lineage(
        block_pairs(met, ["group"], F.col("node"), block)
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(verify, "node long, root long, links long")
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = cut_lineage(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = (
        distinct.select("node", "n", "first")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
        .filter("n_links > 0")
    )
    named = cut_lineage(named)
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    answer = cut_lineage(named.join(smallest, "root").select("node", "n_links", "component"))
    return rows.select("vec_id", "node").join(answer, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )


def _verified(table: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """Links within one bucket block: per node its multiplicity-weighted links and smallest reach."""
    side = table.column("side").to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return None
    node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
    kind = table.column("kind").to_numpy()
    filters = table.column("filters").combine_chunks()
    here = table.column("filter").to_numpy()
    unit = _matrix(table.column("embedding"))
    flat, lengths = filters.flatten().to_numpy(), np.diff(filters.offsets.to_numpy())
    owner = np.repeat(np.arange(len(node)), lengths)
    earlier = flat < here[owner]
    known, column = np.unique(flat[earlier], return_inverse=True)
    before = np.zeros((len(node), max(len(known), 1)), dtype=np.float32)
    before[owner[earlier], column] = 1
    linked = unit[left] @ unit[right].T >= cosine
    linked &= node[left][:, None] != node[right][None, :]
    linked &= (kind[left][:, None] == kind[right][None, :]) & (here[left][:, None] == here[right][None, :])
    counted = linked & (before[left] @ before[right].T == 0)
    if not counted.any():
        return None
    links = np.zeros(len(node), dtype=np.int64)
    links[left] += counted @ n[right]
    if side[0] != 2:
        links[right] += counted.T @ n[left]
    a, b = np.nonzero(counted)
    order = np.argsort(node, kind="stable")
    place = np.empty(len(node), dtype=np.int64)
    place[order] = np.arange(len(node))
    root = node[order][local_roots(len(node), place[left[a]], place[right[b]])[place]]
    out = np.flatnonzero((links > 0) | (root != node))
    return pa.RecordBatch.from_arrays(
        [pa.array(node[out]), pa.array(root[out]), pa.array(links[out])], ["node", "root", "links"]
    )
