"""Helpers shared by the operators: whole groups out of sorted batches, blocks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.session import cut_lineage

#: Copies of a node's minimum in a component step: a hub's edges spread over so many tasks.
SALTS = 32


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches of rows sorted by ``keys`` so that no group is cut between two tables.

    Memory holds one batch and the group that its end may have cut, nothing else.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        same = np.ones(table.num_rows, dtype=bool)
        for key in keys:
            column = table.column(key).to_numpy()
            same &= column == column[-1]
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start:
            yield table.slice(0, start)
        rest = table.slice(start).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """0, 1, 2 ... per group of a table sorted by ``keys``."""
    change = np.zeros(table.num_rows, dtype=np.int64)
    for key in keys:
        column = table.column(key).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.cumsum(change)


def block_pairs(df: DataFrame, keys: list[str], item: Column, block: int) -> DataFrame:
    """Split groups of more than ``block`` rows into blocks and pair the blocks up.

    Adds ``lo``, ``hi`` and ``side``: each pair of rows of a group meets in exactly one
    (keys, lo, hi); rows of block ``lo`` have side 0, of ``hi`` side 1, and 2 where lo = hi.
    A group of n rows thus becomes tasks of at most about 2 x ``block`` rows. Sizes come from
    a count that combines before its shuffle; only large groups are joined back.
    """
    large = cut_lineage(
        df.groupBy(*keys)
        .count()
        .filter(F.col("count") > block)
        .select(*keys, F.ceil(F.col("count") / block).cast("int").alias("_n"))
    )
    n = F.coalesce(F.col("_n"), F.lit(1))
    return (
        df.join(large, keys, "left")
        .withColumn("_own", F.pmod(F.xxhash64(item, F.lit(7)), n.cast("long")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("lo", F.least("_own", "_other"))
        .withColumn("hi", F.greatest("_own", "_other"))
        .withColumn(
            "side",
            F.when(F.col("lo") == F.col("hi"), 2)
            .otherwise((F.col("_own") == F.col("hi")).cast("int"))
            .cast("int"),
        )
        .drop("_n", "_own", "_other")
    )


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        root = root[root]
        if (root == before).all():
            return root


def spread(name: str, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(name)), F.lit(SALTS)).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b long): node, root (smallest node).

    Alternating large-star and small-star steps; each round is written to the shared folder.
    Minima combine before the shuffle, and a hub's edges meet its minimum in ``SALTS`` tasks.
    Loops and null ends are ignored; nodes without an edge are not returned.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))

    def towards_minimum(pairs: DataFrame) -> DataFrame:
        """(u, v, m): m is the smallest of u and its v."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.withColumn("s", spread("s", "v")).join(
            least.withColumn("s", salts), ["u", "s"]
        )

    pairs = cut_lineage(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            towards_minimum(both)
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        met = towards_minimum(large)
        small = met.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        pairs = cut_lineage(
            small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        )
        now = tuple(
            pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        )
        if now == seen or now[0] == 0:
            break
        seen = now
    roots = pairs.select("u", "v")
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
