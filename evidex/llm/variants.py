"""Spelling variants: words of one edit, found with search schemes over bidirectional FM-indexes.

Words are counted by Spark with partial sums before the shuffle. Two words of one inserted, deleted
or replaced code point agree in the first or in the second half of either, and their lengths differ
by one at most; so each word is posted under its halves, once for each length a partner may have,
and partners meet under the half that they share. Postings are dealt by half; a half with more than
``BLOCK`` words is cut into blocks, which meet in pairs.

A task indexes the words of some whole halves as one text with a delimiter around each word: the
order of the suffixes of the text and of the reversed text, and for both how often each letter
occurs in the Burrows-Wheeler transform before each row. A pattern is a pair of suffix intervals of
one size, which a letter on either side narrows. The two searches of the scheme are: the first half
exactly, then to the right with one error; the second half exactly, then to the left with one
error. The second leaves out words that also agree in the first half, so a pair is found once. A
task returns per word its number of near words and the best of them; no pairs are emitted.

Roots follow the forms by doubling: forms at least ``FACTOR`` times as frequent as their word leave
chains of few steps.

Defined cases: a null text has no words; a null doc_id counts as the empty string in the hash; rows
that repeat an id count one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import block_pairs, group_numbers, whole_groups
from evidex.session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: One of so many runs of a document loses a code point.
TYPO = 199
#: Words of one half that a task compares at once with as many others; postings per task about.
BLOCK, POSTINGS = 4096, 40_000
END, DELIMITER = 0, 1
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, typo: int = TYPO) -> DataFrame:
    """word of every run of letters that can count, runs chosen by hash without one code point."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run"),
    ).select("doc", F.translate("run", CAPITALS, SMALL).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % typo == 0, without).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words of at least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences."""
    counts = occurrences(docs).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))


def postings(words: DataFrame) -> DataFrame:
    """word, n, key, second, asks: each word under the halves at which partners look for it.

    A word of length l asks under the halves of its own length; it can be found under those of
    l - 1, l and l + 1.
    """
    own = F.length("word")
    lengths = words.withColumn("l", F.explode(F.sequence(own - 1, own + 1))).filter(f"l >= {MIN_LENGTH}")
    half = F.floor(F.col("l") / 2).cast("int")
    posted = lengths.withColumn("second", F.explode(F.array(F.lit(False), F.lit(True))))
    part = F.when(F.col("second"), F.expr("right(word, l - cast(floor(l / 2) AS int))")).otherwise(F.substring(F.col("word"), F.lit(1), half))
    return posted.select(
        "word", "n", F.xxhash64("second", "l", part).alias("key"), "second", (F.col("l") == own).alias("asks")
    )


class BidirectionalIndex:
    """FM-indexes of a text of delimited words and of the reversed text."""

    def __init__(self, words: list[str]) -> None:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        self.alphabet = np.unique(letters)
        self.sigma = len(self.alphabet) + 2
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.cumsum(self.lengths + 1) - self.lengths  # of each word's letters
        text = np.full(int(self.lengths.sum()) + len(words) + 1, DELIMITER, dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[np.r_[self.first - 1, len(text) - 1]] = False
        text[inside] = np.searchsorted(self.alphabet, letters) + 2
        self.text = text
        self.owner = np.full(len(text) + 1, -1)
        self.owner[self.first - 1] = np.arange(len(words))
        depth = int(self.lengths.max()) + 4
        self.suffix, forward = self._index(np.r_[text, END], depth)
        _, backward = self._index(np.r_[text[::-1], END], depth)
        self.occurs = (backward, forward)  # a letter to the right, to the left
        self.before = np.r_[0, np.cumsum(np.bincount(np.r_[text, END], minlength=self.sigma))]

    def _index(self, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order of ``depth`` symbols at least; occurrences per symbol before each row."""
        order, step = text.copy(), 1
        while step < depth and order.max() < len(text) - 1:
            after = np.zeros_like(order)
            after[:-step] = order[step:] + 1
            order = np.unique(order * (len(text) + 2) + after, return_inverse=True)[1]
            step *= 2
        suffix = np.argsort(order, kind="stable")
        counts = np.zeros((len(text) + 1, self.sigma), dtype=np.int32)
        counts[np.arange(1, len(text) + 1), text[suffix - 1]] = 1
        np.cumsum(counts, axis=0, out=counts)
        return suffix, counts

    def _extend(self, side: int, own: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals after one symbol on ``side``: the side's own start, the other start's shift, the size."""
        low, high = self.occurs[side][own], self.occurs[side][own + size]
        counts = high - low
        at = np.arange(len(own))
        smaller = np.cumsum(counts, axis=1)[at, symbol] - counts[at, symbol]
        return self.before[symbol] + low[at, symbol], smaller, counts[at, symbol]

    def search(self, ask: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``ask``, word): all words of one error in the half that lies on ``side``.

        ``side`` 0 takes the first half exactly and goes right, 1 the second half and goes left.
        """
        length = self.lengths[ask]
        exact = length // 2 if side == 0 else length - length // 2

        def symbol(row: np.ndarray, i: np.ndarray) -> np.ndarray:
            """The i-th symbol on the way, the delimiter after the last."""
            last = length[row] - 1
            place = self.first[ask[row]] + np.where(side == 0, i, last - i)
            return np.where(i > last, DELIMITER, self.text[np.where(i > last, 0, place)])

        row = np.arange(len(ask))
        i = np.zeros(len(ask), dtype=np.int64)
        own = np.full(len(ask), self.before[DELIMITER])
        other = own.copy()
        size = np.full(len(ask), self.before[DELIMITER + 1] - self.before[DELIMITER])
        for step in range(int(exact.max(initial=0))):
            on = np.flatnonzero(exact > step)
            own[on], shift, size[on] = self._extend(side, own[on], size[on], symbol(on, i[on]))
            other[on] += shift
            i[on] += 1
        clean = (row, i, own, other, size)
        dirty = tuple(np.zeros(0, dtype=np.int64) for _ in clean)
        found_row, found_word = [], []
        while len(clean[0]) or len(dirty[0]):
            # A letter of the word left out: no symbol is read.
            row, i, own, other, size = clean
            inside = i < length[row]
            dirty = tuple(np.r_[d, c[inside]] for d, c in zip(dirty, (row, i + 1, own, other, size), strict=True))
            # With no error yet, every letter may come: the word's own, another one, or one too many.
            low = self.occurs[side][own]
            counts = self.occurs[side][own + size] - low
            smaller = np.cumsum(counts, axis=1) - counts
            at, letter = np.nonzero(counts[:, DELIMITER + 1 :])
            letter += DELIMITER + 1
            grown = (row[at], i[at], self.before[letter] + low[at, letter], other[at] + smaller[at, letter], counts[at, letter])
            match = letter == symbol(grown[0], grown[1])
            replaced = ~match & (grown[1] < length[grown[0]])

            def moved(chosen: np.ndarray, by: int, states: tuple[np.ndarray, ...] = grown) -> tuple[np.ndarray, ...]:
                return tuple(x[chosen] + by * (k == 1) for k, x in enumerate(states))

            errors = [moved(replaced, 1), moved(np.ones(len(at), dtype=bool), 0)]
            clean = moved(match, 1)
            # With the error made, only the word's own next symbol.
            row, i, own, other, size = dirty
            wanted = symbol(row, i)
            own, shift, size = self._extend(side, own, size, wanted)
            live = size > 0
            done = live & (wanted == DELIMITER)
            place = (other + shift if side == 0 else own)[done]
            found_row.append(row[done])
            found_word.append(self.owner[self.suffix[place]])
            live &= ~done
            walked = (row[live], i[live] + 1, own[live], (other + shift)[live], size[live])
            dirty = tuple(np.concatenate(x) for x in zip(walked, *errors, strict=True))
        pair = np.unique(np.concatenate(found_row) * len(self.lengths) + np.concatenate(found_word)) if found_row else np.zeros(0, dtype=np.int64)
        return pair // len(self.lengths), pair % len(self.lengths)


def near_words(table: pa.Table, keys: list[str]) -> pa.RecordBatch | None:
    """Per asking word of a table of whole groups: word, near, best_n, best_word."""
    group = group_numbers(table, keys)
    asked = np.bincount(group, weights=table.column("asks").to_numpy())
    table = table.filter(pa.array((np.bincount(group) > 1)[group] & (asked > 0)[group]))
    if not table.num_rows:
        return None
    group = group_numbers(table, keys)
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    part, asks, second = (table.column(c).to_numpy() for c in ("side", "asks", "second"))
    names = sorted(set(words))
    number = {w: k for k, w in enumerate(names)}
    word = np.array([number[w] for w in words])
    index = BidirectionalIndex(names)
    held = group * len(names) + word
    order = np.argsort(held)
    held = held[order]
    out_row, out_place = [], []
    for side in (0, 1):
        asking = np.flatnonzero(asks & (second == bool(side)))
        at, other = index.search(word[asking], side)
        row = asking[at]
        if side == 1:  # pairs that agree in the first half are the other search's
            new = np.array([words[r][: len(words[r]) // 2] != names[o][: len(words[r]) // 2] for r, o in zip(row.tolist(), other.tolist(), strict=True)], dtype=bool)
            row, other = row[new], other[new]
        code = group[row] * len(names) + other
        place = np.minimum(np.searchsorted(held, code), len(held) - 1)
        here = held[place] == code  # words of other blocks and halves are met elsewhere
        row, place = row[here], order[place[here]]
        meets = (part[row] == 2) | (part[row] != part[place])
        out_row.append(row[meets])
        out_place.append(place[meets])
    row, place = np.concatenate(out_row), np.concatenate(out_place)
    if not len(row):
        return None
    best = np.lexsort((word[place], -n[place], word[row]))
    row, place = row[best], place[best]
    answered, start, count = np.unique(word[row], return_index=True, return_counts=True)
    top = place[start]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([names[a] for a in answered.tolist()], pa.string()), pa.array(count),
            pa.array(n[top]), pa.array([names[w] for w in word[top].tolist()], pa.string()),
        ],
        ["word", "near", "best_n", "best_word"],
    )


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n, best_word of the words (word, n) that have near words."""
    keys = ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            out = near_words(table, keys)
            if out is not None:
                yield out

    tasks = words.count() * 6 // POSTINGS + 1
    met = block_pairs(postings(words), ["key"], F.col("word"), block).repartition(tasks, *keys).sortWithinPartitions(*keys)
    found = met.mapInArrow(run, "word string, near long, best_n long, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best_word")).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.best_word").alias("best_word")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached from each word over ``forms`` (word, form)."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("later"))
        step = cut_lineage(now.join(onward, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.filter("moved").head(1):
            return now


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs`` (doc_id, text)."""
    words = cut_lineage(vocabulary(docs))
    near = neighbours(words, block)
    formed = F.col("best_n") >= FACTOR * F.col("n")
    named = cut_lineage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best_word")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"),
        )
    )
    last = roots(named.filter("form is not null"))
    return named.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
