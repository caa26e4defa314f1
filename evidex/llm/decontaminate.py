"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters has an error budget of k = floor(``ERROR_RATE`` x n) edits and is split
into k + 1 pieces; an occurrence with at most k edits holds one piece unchanged. An Aho-Corasick
automaton finds all exact piece hits in whole documents, and Myers' bit-parallel distance, run
over the text around a hit, decides. Texts are compared lower-cased with runs of white space as
one space, so line breaks don't hide a copy.

The items are a stated query set run against all documents in blocks of at most
``BLOCK_CHARS`` characters: each block is one pass with one automaton of bounded size.

Defined cases: null or blank items match nothing; items too short for a budget match exactly only;
null text has no hits; items with equal texts are all reported; items with a null id are ignored;
repeated document rows are answered one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.06
BLOCK_CHARS = 2 << 20
HITS = "array<struct<item_id:long,begin:long,stop:long,distance:int>>"

_SPACE = re.compile(r"\s+")


def normal(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").lower()).strip()


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``budget`` + 1 pieces of nearly equal length."""
    cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the closest, then first, occurrence of ``pattern`` within ``text``.

    Myers' algorithm: one column of the edit matrix is two bit vectors; a match may start anywhere.
    None if the distance exceeds ``budget``.
    """
    n = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = (budget + 1, 0)
    for end, c in enumerate(text, 1):
        eq = where.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best[0]:
            best = (score, end)
    return best if best[0] <= budget else None


class Matcher:
    """The items of one block: an automaton over their pieces, and the check of a hit."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items: list[tuple[list[int], str, int]] = []
        by_text: dict[str, list[int]] = {}
        for item, text in items:
            by_text.setdefault(normal(text), []).append(item)
        found: dict[str, list[tuple[int, int]]] = {}
        for text, ids in by_text.items():
            if text:
                budget = int(rate * len(text))
                for offset, piece in pieces(text, budget):
                    found.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((sorted(ids), text, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, begin, stop, distance) in normal text, one for each separate occurrence."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (length, owners) in self.automaton.iter(text):
            for item, offset in owners:
                starts.setdefault(item, set()).add(end + 1 - length - offset)
        out = []
        for item, places in starts.items():
            ids, pattern, budget = self.items[item]
            done = -1
            for place in sorted(places):
                if place + budget < done:  # inside the occurrence found last
                    continue
                begin = max(place - budget, 0)
                window = text[begin : place + len(pattern) + budget]
                match = best_match(pattern, window, budget)
                if match:
                    stop = begin + match[1]
                    done = stop
                    start = max(begin, stop - len(pattern))
                    out += [(i, start, stop, match[0]) for i in ids]
        return sorted(out)


def blocks(items: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``size`` characters; larger items have one of their own.

    Item lengths are summed per hash class on the cluster; a block holds whole classes.
    """
    rows = items.filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-2 * total // size)
    for number in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == number)
        yield [(r.item_id, r.text) for r in part.collect()]


def find(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``hits``: per occurrence item_id, begin, stop (in normal text), distance.

    ``stop`` is exact; ``begin`` is ``stop`` less the item's length, exact but for the edits.
    """
    out = docs.drop("hits").withColumn("hits", F.array().cast(HITS))
    for part in blocks(items, block):
        out = out.withColumn("hits", F.array_sort(F.concat("hits", _scanner(part, rate)("text"))))
    return out


def _scanner(items: list[tuple[int, str]], rate: float) -> Callable[..., Column]:
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items, rate)
        names = ("item_id", "begin", "stop", "distance")
        for texts in batches:
            found = [matcher.hits(normal(text)) for text in texts]
            yield pd.Series([[dict(zip(names, hit, strict=True)) for hit in hits] for hits in found])

    return F.pandas_udf(scan, HITS)


def report(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, contaminated, item_ids (distinct, ascending), n_hits, least_distance of every row."""
    return find(docs.select("doc_id", "text"), items, rate, block).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.size("hits") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct("hits.item_id")).alias("item_ids"),
        F.size("hits").cast("long").alias("n_hits"),
        F.array_min("hits.distance").alias("least_distance"),
    )


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item."""
    return find(docs, items, rate, block).filter(F.size("hits") == 0).select(*docs.columns)
