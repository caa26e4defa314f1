"""SimHash near-duplicates: fingerprints, BK-trees over shards, connected components.

A fingerprint has 64 bits. Two fingerprints within ``RADIUS`` bits agree in at least two of
``BLOCKS`` bit blocks (pigeonhole: 4 differing bits spoil at most 4 of 6), so each pair of blocks
is a table whose values are the shards. A shard's distinct fingerprints form a BK-tree; the
shard's fingerprints walk it and follow only edges within the radius. Trees of large shards are
cut into blocks of ``TREE_ROWS``, and each block of queries meets each tree of its shard.

Defined cases: null text has no words (fingerprint zero); rows with equal fingerprints are always
linked; a null doc_id takes the smallest id of its component, and null if that has none; repeated
rows are answered one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import block_pairs, components, group_numbers, local_roots, whole_groups
from evidex.session import cut_lineage

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
TREE_ROWS = 4096
#: Shingles counted and (query, tree node) pairs walked at once in a task.
COUNTED, WALKED = 1 << 16, 1 << 21


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of UTF-8 ``text``."""
    words = (text or b"").lower().split()  # for bytes: A-Z only, and splits on 20 and 09-0D only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    last = max(len(words) - shingle + 1, 1)
    begin, end = starts[:last].tolist(), (ends[-last:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, last, COUNTED):
        h = np.array(
            [digest(joined[a:b], seed) for a, b in zip(begin[at : at + COUNTED], end[at : at + COUNTED], strict=True)],
            dtype="<u8",
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)]
            fps = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _shards(radius: int, blocks: int) -> list[Column]:
    """One long per choice of ``blocks - radius`` blocks: the fingerprint's bits in them."""
    if not radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius")
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(masks[i] for i in chosen)
        out.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return out


class Forest:
    """BK-trees of several groups at once, as arrays; ``group`` numbers are 0, 1, 2 ..."""

    def __init__(self, values: np.ndarray, group: np.ndarray) -> None:
        order = np.argsort(group, kind="stable")
        self.values, group = values[order], group[order]
        self.rows = order
        n = len(values)
        self.roots = np.full(int(group.max()) + 1 if n else 0, -1)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
        self.roots[group[first]] = first
        self.sizes = np.bincount(group, minlength=len(self.roots))
        parent, edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.roots[group[rest]]
        while len(rest):
            distance = np.bitwise_count(self.values[rest] ^ self.values[at]).astype(np.int64)
            _, new, inverse = np.unique(at * 65 + distance, return_index=True, return_inverse=True)
            parent[rest[new]], edge[rest[new]] = at[new], distance[new]
            at = rest[new][inverse]
            keep = np.ones(len(rest), dtype=bool)
            keep[new] = False
            rest, at = rest[keep], at[keep]
        nodes = np.flatnonzero(parent >= 0)
        key = parent[nodes] * 65 + edge[nodes]
        order = np.argsort(key, kind="stable")
        self.children, self.keys = nodes[order], key[order]

    def search(self, values: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, rows of the trees) within ``radius``, in pieces of bounded size."""
        has = np.flatnonzero((group < len(self.roots)) & (self.roots[np.minimum(group, len(self.roots) - 1)] >= 0))
        work = np.cumsum(self.sizes[group[has]])
        for piece in np.split(has, np.searchsorted(work, np.arange(WALKED, work[-1] if len(work) else 0, WALKED))):
            query, node = piece, self.roots[group[piece]]
            while len(query):
                distance = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
                hit = distance <= radius
                if hit.any():
                    yield query[hit], self.rows[node[hit]]
                lo = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0))
                hi = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right")
                count = hi - lo
                query = np.repeat(query, count)
                offset = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
                node = self.children[np.repeat(lo, count) + offset]


def links(
    fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_rows: int = TREE_ROWS, direct: bool = False
) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: connected exactly as all pairs within radius.

    A task emits, for each fingerprint with a link, the smallest one it reaches there, not the
    pairs themselves, so a group of n near copies gives n rows per table and not n squared. With
    ``direct`` it is the smallest within the radius itself: pairs to be confirmed one by one.
    """
    keys = ["t", "shard", "lo", "hi"]
    tables = _shards(radius, blocks)
    keyed = fps.select("fp", F.posexplode(F.array(*tables)).alias("t", "shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            group = group_numbers(table, keys)
            size = np.bincount(group)
            many = size[group] > 1
            if not many.any():
                continue
            group = np.unique(group[many], return_inverse=True)[1]
            values = table.column("fp").to_numpy()[many].view(np.uint64)
            side = table.column("side").to_numpy()[many]
            trees, asked = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(trees) or not len(asked):
                continue
            forest = Forest(values[trees], group[trees])
            distinct, number = np.unique(values.view(np.int64), return_inverse=True)
            root = np.arange(len(distinct))
            for query, found in forest.search(values[asked], group[asked], radius):
                left, right = number[asked[query]], number[trees[found]]
                if direct:
                    np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
                    continue
                root = root[local_roots(len(distinct), root[left], root[right])]
            linked = np.flatnonzero(root != np.arange(len(distinct)))
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct[linked]), pa.array(distinct[root[linked]])], ["a", "b"]
                )

    blocked = block_pairs(keyed, ["t", "shard"], F.col("fp"), tree_rows)
    return (
        blocked.repartition(*keys)
        .sortWithinPartitions(*keys)
        .select(*keys, "side", "fp")
        .mapInArrow(run, "a long, b long")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept (component_id = doc_id)."""
    rows = cut_lineage(fingerprints(docs))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = components(links(classes.select("fp"), radius, blocks))
    found = cut_lineage(found)
    member = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "n", "first", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")
    )
    linked = cut_lineage(member.filter("linked or n > 1").select("fp", "first", "root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = cut_lineage(linked.join(smallest, "root").select("fp", "component"))
    return rows.join(named, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` without near-duplicates: each component keeps the row of its smallest doc_id.

    Rows that repeat a kept id count as one document: one of them stays. Rows without an id
    cannot be named as duplicates and stay.
    """
    kept = near_duplicates(docs, radius, blocks).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter("doc_id is not null")
    once = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
