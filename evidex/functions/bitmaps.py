"""Pairs of sets that may be similar, by bitmaps of their terms' hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Pairs looked at in one step.
TILE = 1 << 15


def bitmap(hashes: np.ndarray, longs: int) -> bytes:
    """A bit per hash, by its last bits; ``longs`` is a power of two."""
    cells = np.zeros(64 * longs, bool)
    cells[hashes & (64 * longs - 1)] = True
    return np.packbits(cells, bitorder="little").tobytes()


class Block:
    """Sets of one size class, by ascending size: numbers, sizes, and words of bitmaps."""

    def __init__(self, numbers: Sequence[int], sizes: Sequence[int], maps: Sequence[bytes]) -> None:
        self.sizes = np.array(sizes, np.int64)
        order = np.argsort(self.sizes, kind="stable")
        self.sizes, self.numbers = self.sizes[order], np.array(numbers, np.int64)[order]
        rows = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)
        self.words = np.ascontiguousarray(rows[order].T)

    def folded(self, longs: int) -> np.ndarray:
        """The words of narrower bitmaps: bits that fall together become one."""
        return np.bitwise_or.reduce(self.words.reshape(-1, longs, self.words.shape[1]), axis=0)


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=0, dtype=np.int64)


def possible_pairs(small: Block, large: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs whose bitmaps leave a Jaccard similarity at the threshold possible.

    A bit of one set that the other has not is a term that the other has not. ``small`` has the
    narrower bitmaps, to which those of ``large`` are folded; the sets of
    one block meet each other once.
    """
    alone = large is small
    longs = len(small.words)
    theirs = large.folded(longs)
    # Terms that share a bit with another one of their own set may be common without showing.
    hidden, other_hidden = small.sizes - _bits(small.words), large.sizes - _bits(theirs)
    share = threshold / (1 + threshold)
    kind = np.uint16 if 64 * longs < 1 << 16 else np.uint32
    at = 0
    while at < len(small.sizes):
        end = min(at + 64, len(small.sizes))
        sizes = small.sizes[at:end]
        first = at if alone else np.searchsorted(large.sizes, sizes[0] * threshold - 1e-9)
        last = np.searchsorted(large.sizes, sizes[-1] / threshold + 1e-9, "right")
        step = TILE // (end - at)
        for b in range(first, last, step):
            c = min(b + step, last)
            common = np.zeros((end - at, c - b), kind)
            for ours, other in zip(small.words[:, at:end], theirs[:, b:c], strict=True):
                common += np.bitwise_count(ours[:, None] & other)
            lengths = large.sizes[b:c]
            needed = np.ceil((sizes[:, None] + lengths) * share - 1e-9)
            shared = common + np.minimum(hidden[at:end, None], other_hidden[b:c])
            fits = np.minimum(sizes[:, None], lengths) >= np.maximum(sizes[:, None], lengths) * threshold - 1e-9
            i, j = np.nonzero(fits & (shared >= needed))
            i, j = at + i, b + j
            once = j > i if alone else slice(None)
            yield i[once], j[once]
        at = end
