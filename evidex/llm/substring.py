"""Substring deduplication with a compressed FM-index per shard.

A window is ``window`` consecutive words of one document. Its minimizer, the ``GRAM``-word piece of
it with the smallest hash, names its shard, so equal windows always meet; neighbouring windows
with one minimizer form a segment. Documents are dealt once into groups of bounded size; three
steps read that exchange:

1. Each group sends the minimizers it has, and learns which of them other groups have too.
2. It sends the segments of shared minimizers to their shards, a segment that several documents of
   the group hold once, for the smallest of them; the others' windows are settled on the spot.
   A shard indexes its distinct segments: suffix order, Burrows-Wheeler transform in a wavelet
   matrix of packed bits, the document of each suffix. The segments are then streamed against the
   index, searched backwards word by word; the matching statistic of each position, counted to the
   threshold, gives the windows that occur elsewhere, and the suffix interval of a full match the
   smallest document that holds it.
3. The intervals return to the groups, which cut the words out.

Defined cases: null text has no words; a null doc_id counts as larger than any; rows that repeat
an id are one document (no window of theirs repeats elsewhere because of them) and answered one by
one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
GRAM = 4
#: Bytes of text in a group of documents, in the mean; shards are as many as groups.
GROUP_BYTES = 4 << 20
#: Windows searched at once.
SEARCHED = 1 << 19
NO_ID = (1 << 63) - 1

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.compress(out.getvalue(), 3)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.decompress(data))) as found:
        return {k: found[k] for k in found.files}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(31))


def minimizers(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window start: hash of its minimizer, and the word at which that begins."""
    n = len(words) - gram + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(gram):
        h = _mix(h * _M1 + words[i : i + n])
    width = window - gram + 1
    best, at = h[: n - width + 1].copy(), np.arange(n - width + 1)
    for i in range(1, width):
        other = h[i : i + len(best)]
        less = np.flatnonzero(other < best)
        best[less] = other[less]
        at[less] = less + i
    return best, at


class Segments:
    """The segments of some texts: document row, first word, words, minimizer, and their text."""

    def __init__(self, texts: list[str | None], window: int, gram: int) -> None:
        words: list[bytes] = []
        sizes = []
        for text in texts:
            own = (text or "").encode().split()  # for bytes: splits on 20 and 09-0D only
            words += own
            sizes.append(len(own))
        self.sizes = np.array(sizes, dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        empty = np.zeros(0, dtype=np.int64)
        self.row, self.at, self.n, self.key = empty, empty, empty, empty.astype(np.uint64)
        if len(words) < window:
            return
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.joined = b" ".join(words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        del words
        best, at = minimizers(hashes, window, gram)
        owner = np.repeat(np.arange(len(sizes)), self.sizes)
        inside = owner[: len(best)] == owner[window - 1 :]
        begin = inside.copy()
        begin[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        start = np.flatnonzero(begin)
        stop = inside.copy()
        stop[:-1] &= begin[1:] | ~inside[1:]
        end = np.flatnonzero(stop)
        self.row, self.key = owner[start], best[start]
        self.at, self.n = start - self.first[self.row], end - start + window

    def text(self, i: int) -> bytes:
        a = self.first[self.row[i]] + self.at[i]
        return self.joined[self.starts[a] : self.ends[a + self.n[i] - 1]]


def _short(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of a minimizer, and 40 of its bits: keys that agree in both go the same way."""
    return (key % np.uint64(shards)).astype(np.int64), (key >> np.uint64(24)).astype(np.int64)


class Wavelet:
    """Wavelet matrix of a sequence: one packed bit row per bit of the symbols, with counts."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(int(sigma - 1).bit_length(), 1)
        self.bits, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(64 + -len(bit) % 64, dtype=bool)], bitorder="little").view("<u8")
            self.bits.append(packed)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.counts.append(np.cumsum(ones) - ones)
            self.zeros.append(int((~bit).sum()))
            now = np.r_[now[~bit], now[bit]]
        self.origin = self._walk(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            word, offset = at >> 6, (at & 63).astype(np.uint64)
            below = (np.uint64(1) << offset) - np.uint64(1)
            ones = self.counts[i][word] + np.bitwise_count(self.bits[i][word] & below)
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, at) - self.origin[symbol]


class FMIndex:
    """Index of texts given as word numbers from 1; 0 ends each text. Contexts of ``depth``."""

    def __init__(self, sequence: np.ndarray, sigma: int, depth: int) -> None:
        order, step = sequence.copy(), 1
        while step < depth:  # order of the suffixes by their first `depth` words at least
            after = np.zeros_like(order)
            after[:-step] = order[step:]
            order = np.unique(order * (int(order.max()) + 1) + after, return_inverse=True)[1]
            step *= 2
        self.suffix = np.argsort(order, kind="stable")
        self.before = np.r_[0, np.cumsum(np.bincount(sequence, minlength=sigma))]
        self.bwt = Wavelet(sequence[self.suffix - 1], sigma)

    def search(self, sequence: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistic of each end up to ``depth``, of matches that occur twice or more.

        Returns length, and the suffix interval [lo, hi) of the match where it is ``depth``.
        """
        length = np.zeros(len(end), dtype=np.int64)
        low, high = np.zeros(len(end), dtype=np.int64), np.zeros(len(end), dtype=np.int64)
        live = np.arange(len(end))
        symbol = sequence[end]
        lo, hi = self.before[symbol], self.before[symbol + 1]
        for step in range(1, depth + 1):
            twice = hi - lo > 1
            live, lo, hi = live[twice], lo[twice], hi[twice]
            length[live] = step
            if step == depth or not len(live):
                break
            symbol = sequence[end[live] - step]
            lo, hi = self.before[symbol] + self.bwt.rank(symbol, lo), self.before[symbol] + self.bwt.rank(symbol, hi)
        low[live], high[live] = lo, hi
        return length, low, high


def smaller_elsewhere(texts: list[bytes], docs: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(text, begin, stop): words of a text in windows that a text of a smaller document has.

    Intervals of neighbouring windows are joined.
    """
    words = [t.split(b" ") for t in texts]
    sizes = np.array([len(w) for w in words])
    flat = [w for own in words for w in own]
    names = {w: i for i, w in enumerate(dict.fromkeys(flat), 1)}
    sequence = np.zeros(len(flat) + len(texts), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    first = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(sequence), dtype=bool)
    inside[first + sizes] = False
    sequence[inside] = np.fromiter((names[w] for w in flat), dtype=np.int64, count=len(flat))
    index = FMIndex(sequence, len(names) + 1, window)
    doc_of = docs[owner[index.suffix]]
    place = np.arange(len(sequence)) - first[owner]
    ends = np.flatnonzero(inside & (place >= window - 1))
    out = []
    for piece in np.split(ends, range(SEARCHED, len(ends), SEARCHED)):
        length, low, high = index.search(sequence, piece, window)
        full = np.flatnonzero(length == window)
        if not len(full):
            continue
        lo, which = np.unique(low[full], return_inverse=True)
        hi = np.zeros(len(lo), dtype=np.int64)
        hi[which] = high[full]
        bounds = np.c_[lo, hi].ravel()
        least = np.minimum.reduceat(np.r_[doc_of, NO_ID], bounds)[::2][which]
        hit = piece[full[least < docs[owner[piece[full]]]]]
        if len(hit):
            cut = np.r_[True, (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)]
            starts, stops = hit[cut], hit[np.r_[cut[1:], True]]
            own = owner[starts]
            out += zip(own.tolist(), (place[starts] - window + 1).tolist(), (place[stops] + 1).tolist(), strict=True)
    return out


def _row_keys(ids: pd.Series, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    doc = ids.fillna(NO_ID).to_numpy(dtype=np.int64, na_value=NO_ID) if len(ids) else np.zeros(0, np.int64)
    mark = np.array([xxhash.xxh3_64_intdigest((t or "").encode()) for t in texts], dtype=np.uint64).view(np.int64)
    return doc, mark


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, spans and kept_text of every row of ``docs``.

    ``spans`` are the removed intervals of word numbers; ``kept_text`` joins the rest by spaces.
    """
    if not 0 < gram <= window:
        raise ValueError("the minimizer must fit the window")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("text").cast("string").alias("text"),
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(-(-size // group_bytes)) or 1
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)).cast("int"))
    dealt = dealt.repartition(n, "b")

    def offer(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(Segments(group["text"].tolist(), window, gram).key)
        shard, short = _short(keys, n)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0]) if len(order) else []
        out = []
        for part in np.split(order, cuts[1:]) if len(order) else []:
            data = np.unique(short[part]).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            out.append((int(group["b"].iloc[0]), int(shard[part[0]]), data))
        return pd.DataFrame(out, columns=["b", "shard", "keys"])

    def numbers(data: bytes) -> np.ndarray:
        wide = np.zeros((len(data) // 5, 8), dtype=np.uint8)
        wide[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
        return wide.view("<i8").ravel()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own = [np.unique(numbers(x)) for x in group["keys"]]
        found, count = np.unique(np.concatenate(own), return_counts=True)
        shared = found[count > 1]
        kept = [x[np.isin(x, shared, assume_unique=True)].astype("<i8").tobytes() for x in own]
        out = group[["b", "shard"]].assign(keys=kept)
        return out[[bool(k) for k in kept]]

    shared = (
        dealt.groupBy("b")
        .applyInPandas(offer, "b int, shard int, keys binary")
        .groupBy("shard")
        .applyInPandas(compare, "b int, shard int, keys binary")
    )

    def send(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame([], columns=["shard", "b", "settled", "data"])
        b = int(group["b"].iloc[0])
        doc, mark = _row_keys(group["doc_id"], group["text"])
        segments = Segments(group["text"].tolist(), window, gram)
        shard, short = _short(segments.key, n)
        other = [s + n * np.frombuffer(k, dtype="<i8") for s, k in zip(known["shard"], known["keys"], strict=True)]
        here = np.isin(shard + n * short, np.concatenate(other)) if other else np.zeros(len(shard), dtype=bool)
        _, number, count = np.unique(segments.key, return_inverse=True, return_counts=True)
        wanted = np.flatnonzero(here | (count[number] > 1) if len(number) else here)
        texts = [segments.text(i) for i in wanted]
        name = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        which = np.fromiter((name[t] for t in texts), dtype=np.int64, count=len(texts))
        owner = doc[segments.row[wanted]]
        least = np.full(len(name), NO_ID)
        np.minimum.at(least, which, owner)
        later = owner > least[which]
        out = []
        if later.any():
            at = segments.at[wanted[later]]
            row = segments.row[wanted[later]]
            spans = _pack(doc=doc[row], mark=mark[row], begin=at, stop=at + segments.n[wanted[later]])
            out.append((b % n, b, True, spans))
        keep = np.flatnonzero(~later)
        keep = keep[np.argsort(shard[wanted[keep]], kind="stable")]
        cuts = np.flatnonzero(np.diff(shard[wanted[keep]])) + 1
        for part in np.split(keep, cuts) if len(keep) else []:
            chosen = wanted[part]
            data = _pack(
                key=segments.key[chosen], doc=owner[part], mark=mark[segments.row[chosen]],
                at=segments.at[chosen], text=np.frombuffer(b"\n".join([texts[i] for i in part]), dtype=np.uint8),
            )
            out.append((int(shard[chosen[0]]), b, False, data))
        return pd.DataFrame(out, columns=["shard", "b", "settled", "data"])

    def match(group: pd.DataFrame) -> pd.DataFrame:
        settled = group["settled"].to_numpy(dtype=bool)
        out = list(zip(group["b"][settled], group["data"][settled], strict=True))
        names = group["b"][~settled].to_numpy()
        parts = [_unpack(x) for x in group["data"][~settled]]
        if parts:
            key, doc, mark, at = (np.concatenate([p[k] for p in parts]) for k in ("key", "doc", "mark", "at"))
            b = np.repeat(names, [len(p["key"]) for p in parts])
            texts = [t for p in parts for t in p["text"].tobytes().split(b"\n")]
            name: dict[bytes, int] = {}
            which = np.fromiter((name.setdefault(t, len(name)) for t in texts), dtype=np.int64, count=len(texts))
            distinct = list(name)
            least = np.full(len(distinct), NO_ID)
            np.minimum.at(least, which, doc)
            first = np.zeros(len(distinct), dtype=np.uint64)
            first[which] = key
            _, class_of, many = np.unique(first, return_inverse=True, return_counts=True)
            indexed = np.flatnonzero(many[class_of] > 1)
            found: dict[int, list[tuple[int, int]]] = {}
            if len(indexed):
                for i, begin, stop in smaller_elsewhere([distinct[i] for i in indexed], least[indexed], window):
                    found.setdefault(int(indexed[i]), []).append((begin, stop))
            spans = []
            for i in np.flatnonzero((doc > least[which]) | np.isin(which, list(found))).tolist():
                t = int(which[i])
                cuts = [(0, distinct[t].count(b" ") + 1)] if doc[i] > least[t] else found[t]
                spans += [(int(b[i]), int(doc[i]), int(mark[i]), int(at[i]) + x, int(at[i]) + y) for x, y in cuts]
            if spans:
                table = np.array(spans, dtype=np.int64)
                for one in np.unique(table[:, 0]):
                    own = table[table[:, 0] == one]
                    out.append((int(one), _pack(doc=own[:, 1], mark=own[:, 2], begin=own[:, 3], stop=own[:, 4])))
        return pd.DataFrame(out, columns=["b", "spans"])

    spans = (
        dealt.groupBy("b")
        .cogroup(shared.groupBy("b"))
        .applyInPandas(send, "shard int, b int, settled boolean, data binary")
        .groupBy("shard")
        .applyInPandas(match, "b int, spans binary")
    )

    def cut(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        doc, mark = _row_keys(group["doc_id"], group["text"])
        places: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for data in found["spans"]:
            p = _unpack(data)
            for d, m, x, y in zip(*(p[k].tolist() for k in ("doc", "mark", "begin", "stop")), strict=True):
                places.setdefault((d, m), []).append((x, y))
        out = []
        for d, m, none, text in zip(doc.tolist(), mark.tolist(), group["unnamed"], group["text"], strict=True):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for x, y in places.get((d, m), ()):
                gone[x] += 1
                gone[y] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            out.append((None if none else d, len(words), int(gone.sum()), edge.reshape(-1, 2).tolist(), kept.decode()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])
        return frame.astype({"doc_id": "Int64"})

    return (
        dealt.groupBy("b")
        .cogroup(spans.groupBy("b"))
        .applyInPandas(cut, "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept_text string")
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
