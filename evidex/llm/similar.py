"""Near-duplicates by the Jaccard similarity of word shingles: every pair at or above it is linked.

A text is the set of its runs of ``SHINGLE`` words, as 64-bit hashes; equal sets are one node. Two
sets of similarity t share a shingle among the first ``n - ceil(t n) + 1`` of either in any common
order, so only these prefixes are shuffled. In the order, shingles that many texts of a bounded
sample hold come last; the sample changes the work, never the result. Of the candidates, a sketch of
256 counts per set rules out those that can't have enough in common; the others are confirmed by the
intersection of their whole sets, and only their texts are moved.

The first round takes the pairs that SimHash finds: each set has a fingerprint of its shingles,
and BK-trees over shards (``simhash``) give the smallest fingerprint within the radius. No radius
of 64 bits reaches all pairs of similarity t, so each set also meets its neighbours by size under
each shared shingle. Both are confirmed, which joins most members of a large group; the second
round compares by prefixes all candidates not yet in one component, so that no pair is lost.
Under a shingle of few sets they meet in it; the sets of full shingles get new prefixes, in which
the full shingles come last, and those still crowded are ordered by their exact rarity among them.

Defined cases: extra columns are ignored, an empty table gives an empty result, a null id never
names a component if one of its rows has an id; words are those of ``simhash.fingerprint``; a text of fewer words than a shingle is
one shingle; texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm import simhash
from evidex.llm.common import block_pairs, components
from evidex.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
#: Texts of the sample about; texts of it that hold a frequent shingle, and how many such are kept.
SAMPLE, FREQUENT, KEPT = 4000, 3, 100_000
#: Orders of equal sizes, so that a set meets several neighbours in the first round.
ORDERS = 4
#: Sets under one shingle up to which they are paired by it; sets of fuller ones are compared by their rarest shingles.
FEW = 8
#: Rows of one shingle that a task pairs at once with as many others.
BLOCK = 1024
#: Parts of the hash range in a set's sketch (a power of two), and the count that stands for any larger one.
BUCKETS, FULL = 256, 255
#: Texts that a task turns into shingles at once.
TEXTS = 512
#: Counted in favour of a pair on the border, against rounding.
SLACK = 1e-9


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word runs of UTF-8 ``text``."""
    own = (text or b"").lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    digest, known = xxhash.xxh64_intdigest, {}
    words = np.array([known.get(w) or known.setdefault(w, digest(w)) for w in own], dtype=np.uint64)
    last = max(len(words) - shingle + 1, 1)
    runs = np.zeros(last, dtype=np.uint64)
    for at in range(min(shingle, len(words))):
        runs = _mix(runs * np.uint64(0x9E3779B97F4A7C15) + words[at : at + last])
    return np.unique(runs)


def node(found: np.ndarray) -> int:
    """One signed long for a set of shingles."""
    return int(_mix(found).sum(dtype=np.uint64).astype(np.int64)) if len(found) else 0


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed long: a bit is set if over half the shingles have it."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), simhash.COUNTED):
        bits = np.unpackbits(found[at : at + simhash.COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, ``TEXTS`` at a time: a text's shingles take several times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, their counts) that several texts of the sample hold, ``KEPT`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), shingle).view(np.int64))], ["h"])

    every = max(1, docs.count() // SAMPLE)
    chosen = _texts(docs).filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    counts = chosen.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "h").limit(KEPT).toPandas()
    held = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(held)
    return held[order], top["count"].to_numpy(dtype=np.int64)[order] * every


def first_ones(found: np.ndarray, held: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """As many of a set's shingles as two similar sets need to meet; those of ``held`` (sorted, with counts) last."""
    known, counts = held
    n = len(found)
    level = np.zeros(n, dtype=np.int64)
    if len(known) and n:
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        level = np.where(known[at] == found, counts[at], 0)
    return found[np.lexsort((found, level))][: n - int(np.ceil(similarity * n - SLACK)) + 1]


def prefixes(docs: DataFrame, held: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float) -> DataFrame:
    """h, node, size, place: the first shingles of every text's set, rare ones before the frequent ones ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            parts = []
            for x in batch.column(0):
                found = shingles(x.as_py(), shingle)
                first, n = first_ones(found, held, similarity), len(found)
                parts.append((first, np.full(len(first), node(found)), np.full(len(first), n), np.arange(len(first))))
            h, nodes, sizes, places = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 4
            columns = [h.astype(np.uint64).view(np.int64), *(x.astype(np.int64) for x in (nodes, sizes, places))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "node", "size", "place"])

    return _texts(docs).select("text").mapInArrow(run, "h long, node long, size long, place long")


def shared_prefixes(first: DataFrame, similarity: float) -> DataFrame:
    """h, node, size, place, before: the rows of ``prefixes`` with a neighbour of fitting size under their shingle.

    Neighbours stand beside each other by size; ``before`` is the smaller one, if it fits. A set that
    has no such neighbour has no partner under this shingle.
    """
    once = first.repartition("h").dropDuplicates(["h", "node"])
    ordered = Window.partitionBy("h").orderBy("size", F.xxhash64("node", F.pmod("h", F.lit(ORDERS))), "node")
    beside = once.select(
        "*",
        F.lag("node").over(ordered).alias("before"),
        F.lag("size").over(ordered).alias("size_before"),
        F.lead("size").over(ordered).alias("size_after"),
    )
    # least and greatest pass over null: where there is no neighbour, a size would fit itself.
    near, after = (F.col(c).isNotNull() & _fits("size", c, similarity) for c in ("size_before", "size_after"))
    return cut_lineage(beside.filter(near | after).select("h", "node", "size", "place", F.when(near, F.col("before")).alias("before")))


def sketch(found: np.ndarray) -> bytes:
    """How many shingles fall into each of ``BUCKETS`` parts of the hash range, ``FULL`` for as many or more."""
    counts = np.bincount((found >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def named(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, node, size, sketch, fp (its fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sets = [shingles(x.as_py(), shingle) for x in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([node(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([sketch(s) for s in sets], pa.binary()),
                pa.array([fingerprint(s) for s in sets], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "size", "sketch", "fp"])

    return _texts(docs).mapInArrow(run, "doc_id long, node long, size long, sketch binary, fp long")


def near_fingerprints(rows: DataFrame, radius: int = simhash.RADIUS, blocks: int = simhash.BLOCKS) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints lie within ``radius`` bits, as stars; ``rows``: named(docs).

    Of the sets of one fingerprint the smallest node stands for all: the others are paired with it,
    and it with that of the smallest fingerprint within the radius in each shard.
    """
    nodes = cut_lineage(rows.select("node", "fp").distinct())
    first = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    found = cut_lineage(simhash.links(first.select("fp"), radius, blocks, direct=True).distinct())
    of_a, of_b = (first.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    pairs = equal.unionByName(found.join(of_a, "a").join(of_b, "b").select("x", "y"))
    return cut_lineage(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The distinct ``pairs`` (a, b) without those whose sketches leave too few common shingles.

    Common shingles fall into the same part, so each part has at most the smaller count of the two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            if not batch.num_rows:
                continue
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS).astype(np.int32)
                for c in ("sketch_a", "sketch_b")
            )
            x[x == FULL], y[y == FULL] = 1 << 24, 1 << 24  # may be any number
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            both = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            enough = most + SLACK >= similarity / (1 + similarity) * both - 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(enough))

    def of(side: str) -> DataFrame:
        return sketches.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}"))

    met = pairs.distinct().join(of("a"), "a").join(of("b"), "b")
    return cut_lineage(met.mapInArrow(run, "a long, b long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _holders(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, text that hold the sets of the given ``nodes``, one each; texts of repeated or null ids may be others."""
    holders = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    texts = _texts(docs)
    wanted = texts.join(cut_lineage(holders.filter("doc_id is not null").distinct()), "doc_id", "left_semi")
    return wanted.unionByName(texts.filter("doc_id is null"))


def _sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, hashes of the given ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sets = [shingles(x.as_py(), shingle) for x in batch.column(0)]
            nodes = pa.array([node(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([nodes, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "hashes"])

    nodes = cut_lineage(nodes.select("node"))
    hashed = _holders(docs, rows, nodes).select("text").mapInArrow(run, "node long, hashes array<long>")
    return cut_lineage(hashed.join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def _fits(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) + F.lit(SLACK) >= F.lit(similarity) * F.greatest(a, b)


def _confirmed(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are similar enough."""
    left = held.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = held.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = both + F.lit(SLACK) >= F.lit(similarity) * (F.size("x") + F.size("y") - both)
    return cut_lineage(pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b"))


def _several(rooted: DataFrame) -> DataFrame:
    """The rows of ``rooted`` (h, node, size, place, root) whose shingle lies in several components, with ``n``, its rows."""
    sizes = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    return cut_lineage(rooted.join(sizes.filter("lo < hi").select("h", "n"), "h"))


def _fuller(met: DataFrame, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``held`` and the fullest shingles of ``met``, ``KEPT`` at most."""
    full = met.filter(F.col("n") > FEW).select("h", "n").distinct().orderBy(F.desc("n"), "h").limit(KEPT).toPandas()
    every = np.concatenate([full["h"].to_numpy(dtype=np.int64).view(np.uint64), held[0]])
    known, at = np.unique(every, return_index=True)
    return known, np.concatenate([full["n"].to_numpy(dtype=np.int64), held[1]])[at]


def later_prefixes(
    docs: DataFrame, rows: DataFrame, crowded: DataFrame, held: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float
) -> DataFrame:
    """h, node, size, place, root: the shared first shingles of the sets of ``crowded`` (node, root, size) if ``held`` come last.

    They are made from the texts: whole sets, several times the texts, are neither moved nor written.
    """
    first = prefixes(_holders(docs, rows, crowded), held, shingle, similarity)
    return cut_lineage(shared_prefixes(first, similarity).drop("before").join(crowded.select("node", "root"), "node"))


def rare_prefixes(crowded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """h, node, size, place, root: the first shingles of the sets of ``crowded`` (node, root, size), the rarest
    among these sets first.

    Shingles of one set alone come first and bring no pair; a set that has too many of them has no partner.
    """
    spread = cut_lineage(crowded.join(sets, "node").select("node", "root", "size", F.explode("hashes").alias("h")))
    held = spread.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("n > 1")
    entry = F.struct("n", "h", (F.col("lo") < F.col("hi")).alias("apart"))
    least = F.ceil(F.col("size") * similarity - SLACK).cast("int")
    ordered = (
        spread.join(held, "h")
        .groupBy("node", "root", "size")
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .filter(F.size("entries") >= least)
    )
    first = F.slice("entries", 1, F.size("entries") - least + 1)
    alone = F.col("size") - F.size("entries")
    placed = ordered.select("node", "root", "size", alone.alias("alone"), F.posexplode(first).alias("at", "entry"))
    return cut_lineage(
        placed.filter("entry.apart").select("entry.h", "node", "size", (F.col("alone") + F.col("at")).alias("place"), "root")
    )


def _apart(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of ``met`` (h, node, size, place, root) that differ in root and have room for enough
    common shingles from this one on: the first that a pair has in common lets it pass if it is similar enough."""
    names = ["node", "size", "place", "root", "side"]
    blocked = cut_lineage(block_pairs(met.select("h", *names[:-1]), ["h"], F.col("node"), BLOCK))
    x = blocked.select("h", "lo", "hi", *(F.col(c).alias(f"{c}_x") for c in names))
    y = blocked.select("h", "lo", "hi", *(F.col(c).alias(f"{c}_y") for c in names))
    most = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    least = F.lit(similarity / (1 + similarity)) * (F.col("size_x") + F.col("size_y"))
    return (
        x.join(y, ["h", "lo", "hi"])
        .filter("root_x <> root_y and (side_x = 2 and node_x < node_y or side_x = 0 and side_y = 1)")
        .filter(_fits("size_x", "size_y", similarity) & (most + F.lit(1e-6) >= least))
        .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
    )


def groups(docs: DataFrame, rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node, root of every set of shingles that is similar enough to another one; ``rows``: named(docs)."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    held = frequent(docs, shingle)
    shared = shared_prefixes(prefixes(docs, held, shingle, similarity), similarity)

    # The sketch of a set without such a neighbour is missing, and its pairs with it: they can't be similar.
    sketches = cut_lineage(
        rows.join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).drop("doc_id", "fp")
    )
    beside = shared.filter("before is not null").select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b"))
    first = _possible(near_fingerprints(rows).unionByName(beside), sketches, similarity)
    edges = _confirmed(first, _sets(docs, rows, _ends(first), shingle), similarity)
    roots = cut_lineage(components(edges))

    rooted = cut_lineage(
        shared.join(roots, "node", "left").select("h", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    )
    met = _several(rooted)
    few = _apart(met.filter(F.col("n") <= FEW), similarity)
    crowded = cut_lineage(met.filter(F.col("n") > FEW).select("node", "root", "size").distinct())
    again = _several(later_prefixes(docs, rows, crowded, _fuller(met, held), shingle, similarity))
    some = _apart(again.filter(F.col("n") <= FEW), similarity)
    crowded = cut_lineage(again.filter(F.col("n") > FEW).select("node", "root", "size").distinct())
    many = _apart(rare_prefixes(crowded, _sets(docs, rows, crowded, shingle), similarity), similarity)
    apart = few.unionByName(some).unionByName(many)
    apart = _possible(apart, sketches, similarity)
    more = _confirmed(apart, _sets(docs, rows, _ends(apart), shingle), similarity)
    return components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id, kept (component_id = doc_id)."""
    rows = cut_lineage(named(docs, shingle))
    found = cut_lineage(groups(docs, rows, shingle, similarity))
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    member = classes.join(found, "node", "left").filter("root is not null or n > 1")
    linked = cut_lineage(member.select("node", "first", F.coalesce("root", "node").alias("root")))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = cut_lineage(linked.join(smallest, "root").select("node", "component_id"))
    component = F.coalesce("component_id", "doc_id")
    return rows.join(answer, "node", "left").select(
        "doc_id", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates: each component keeps the row of its smallest doc_id.

    Rows that repeat a kept id count as one document: one of them stays. Rows without an id
    cannot be named as duplicates and stay.
    """
    kept = near_duplicates(docs, shingle, similarity).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter("doc_id is not null")
    once = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
