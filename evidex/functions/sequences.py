"""Sequence similarity of many strings with many, on arrays (Q4)."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator, Sequence

import numpy as np

#: Cells of a table of left by right signatures, and pairs whose common subsequences are taken at once.
CELLS, PAIRS = 1 << 18, 1 << 13
#: Characters of a right form, one bit each; pairs with longer ones go without the subsequence bound.
WORD = 64


def _codes(values: Sequence[str], pad: int) -> np.ndarray:
    """Code points of the values as rows filled up with ``pad``."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    rows = np.full((len(values), lengths.max(initial=1)), pad, np.int32)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = np.frombuffer("".join(values).encode("utf-32-le"), np.int32)
    return rows


def _by_length(values: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The values by ascending length, their lengths, and where each stood."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(lengths, kind="stable")
    return [values[k] for k in order.tolist()], lengths[order], order


def _signatures(values: Sequence[str], lengths: np.ndarray) -> np.ndarray:
    """A bit per letter and occurrence: bits that another string lacks are letters that it lacks.

    The values come by ascending length, so those that are read at once are about as long as each other.
    """
    parts, at = [], 0
    while at < len(values):
        end = at + max(1, min(PAIRS, CELLS // int(lengths[min(at + PAIRS, len(values)) - 1])))
        parts.append(_bits(_codes(values[at:end], -1)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _bits(rows: np.ndarray) -> np.ndarray:
    rows = np.sort(rows, axis=1)
    place = np.arange(rows.shape[1])
    starts = np.ones(rows.shape, bool)
    starts[:, 1:] = rows[:, 1:] != rows[:, :-1]
    occurrence = place - np.maximum.accumulate(np.where(starts, place, 0), axis=1)
    bits = np.left_shift(np.uint64(1), ((rows + 26 * occurrence) % 64).astype(np.uint64))
    return np.bitwise_or.reduce(np.where(rows < 0, np.uint64(0), bits), axis=1)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``a`` with that of ``b`` (Hyyrö's bits)."""
    rest = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    cells = np.zeros((len(b), WORD), bool)
    for k in range(a.shape[1]):
        np.equal(b, a[:, k : k + 1], out=cells[:, : b.shape[1]])
        match = rest & np.packbits(cells, axis=1, bitorder="little").view("<u8")[:, 0]
        rest = (rest + match) | (rest - match)
    return np.bitwise_count(~rest)


def _candidates(left: tuple, right: tuple, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of both sides whose lengths and letters leave enough in common.

    Each side: lengths, ascending, and signatures. ``least``: letters needed by sum of lengths.
    """
    (sizes, ours), (lengths, theirs) = left, right
    without = ~theirs
    for size in np.unique(sizes).tolist():
        need = least[size + lengths]
        fits = np.flatnonzero((need <= size) & (need <= lengths))
        if not len(fits):
            continue
        fits = np.arange(fits[0], fits[-1] + 1)
        need = need[fits]
        spare, other = size - need, lengths[fits] - need
        first, end = np.searchsorted(sizes, [size, size + 1])
        step = max(1, CELLS // len(fits))
        for at in range(first, end, step):
            some = ours[at : min(at + step, end)]
            i, j = np.nonzero(np.bitwise_count(some[:, None] & without[fits]) <= spare)
            good = np.bitwise_count(theirs[fits[j]] & ~some[i]) <= other[j]
            yield at + i[good], fits[j[good]]


def similar_pairs(left: Sequence[str], right: Sequence[str], threshold: float) -> Iterator[tuple[int, int, float]]:
    """Positions (i, j) and ``difflib`` ratio of all pairs of non-empty strings at the threshold.

    The matching blocks are a common subsequence, so they hold no more letters than the longest one,
    nor than both strings have in common. Only pairs that these two bounds leave are compared.
    """
    (ours, sizes, by_size), (theirs, lengths, by_length) = _by_length(left), _by_length(right)
    most = int(sizes.max(initial=0) + lengths.max(initial=0))
    least = np.array([math.ceil(threshold * n / 2 - 1e-9) for n in range(most + 1)])
    sides = (sizes, _signatures(ours, sizes)), (lengths, _signatures(theirs, lengths))
    matcher, last = difflib.SequenceMatcher(None), -1
    for i, j in _candidates(*sides, least):
        order = np.argsort(j, kind="stable")
        for at in range(0, len(order), PAIRS):
            p, q = i[order[at : at + PAIRS]], j[order[at : at + PAIRS]]
            good = lengths[q] > WORD
            short = np.flatnonzero(~good)
            x, y = p[short], q[short]
            near = _common(_codes([ours[k] for k in x.tolist()], -1), _codes([theirs[k] for k in y.tolist()], -2))
            good[short] = near >= least[sizes[x] + lengths[y]]
            for x, y in zip(p[good].tolist(), q[good].tolist(), strict=True):
                if y != last:
                    matcher.set_seq2(theirs[y])
                    last = y
                matcher.set_seq1(ours[x])
                if (ratio := matcher.ratio()) >= threshold:
                    yield int(by_size[x]), int(by_length[y]), ratio
