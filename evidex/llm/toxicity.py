"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its hashed word vector beside the maximum over the hashed vectors of its
character pieces of three to five bytes, so unseen forms of a word are recognised by their letters.
Windows of ``WINDOW`` words overlap by half, so that a passage of half a window lies whole in one of
them; all are scored, and the text's score is that of its most toxic window. The network is trained
in numpy on a bounded sample: the whole texts of at most ``SAMPLE`` labelled rows of each class.

Defined cases: null and empty texts are one window without words and get a score too; a row's
label is 1 if any label row of its id says so, null labels count as none; of several texts of one id
the first in order is learned; rows without a doc_id
are scored, never learned from and not held out; without labelled rows of both classes every score
is the share of toxic ones; repeated rows are answered one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
SAMPLE = 2000
WINDOW, STRIDE = 24, 12
HIDDEN, WIDTH, ATTENTION = 12, 8, 8
WORD_ROWS, PIECE_ROWS = 1 << 13, 1 << 15
STEPS, BATCH, RATE = 300, 48, 0.01
SEED = 5
#: Distinct words whose pieces are found together in training.
WORDS_AT_ONCE = 1 << 14
#: Characters of text that a task looks at together, and windows that it scores together.
CHUNK, TOGETHER = 2 << 20, 4096

_WORD = re.compile(r"\w+")


def _hash(x: np.ndarray, rows: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.int64) % rows


def inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its row of word vectors; rows of piece vectors of all words, and where each begins.

    Pieces are runs of 3, 4 or 5 bytes of the word between two marks.
    """
    data = np.frombuffer(("\1" + "\1".join(words) + "\1" * 5).encode(), dtype=np.uint8).astype(np.uint64)
    mark = data == 1
    n = len(data) - 5
    word = np.cumsum(mark)[:n] - 1  # a mark belongs to the word after it
    ids, owner = [], []
    run = np.zeros(n, dtype=np.uint64)
    inner = np.zeros(n, dtype=bool)  # a mark between the first and the last byte
    for size in range(1, 6):
        run = run << np.uint64(8) | data[size - 1 : size - 1 + n]
        if size > 2:
            inner = inner | mark[size - 2 : size - 2 + n]
            good = np.flatnonzero(~inner & (word < len(words)))
            ids.append(_hash(run[good] + np.uint64(size), PIECE_ROWS))
            owner.append(word[good])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(words)))
    whole = np.fromiter((zlib.crc32(w.encode()) % WORD_ROWS for w in words), dtype=np.int64, count=len(words))
    return whole, ids[order], begin


def windows(sizes: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and word positions (with a mask) of all windows of texts of ``sizes`` words.

    Every text has a window; the last one ends at or behind its last word.
    """
    count = np.maximum(1, -(-(sizes - (window - stride)) // stride))
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    place = number[:, None] * stride + np.arange(window)
    here = place < sizes[text][:, None]
    first = np.cumsum(sizes) - sizes
    return text, np.where(here, first[text][:, None] + place, 0), here


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters by name, the forward pass, and its gradient."""

    def __init__(self, rng: np.random.Generator) -> None:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        h, d = HIDDEN, 2 * WIDTH
        self.p = {
            "word": draw(WORD_ROWS, WIDTH, scale=0.05),
            "piece": draw(PIECE_ROWS, WIDTH, scale=0.05),
            "att": draw(2 * h, ATTENTION, scale=(2 * h) ** -0.5),
            "att_b": np.zeros(ATTENTION, np.float32),
            "att_v": draw(ATTENTION, scale=ATTENTION**-0.5),
            "out": draw(2 * h, scale=(2 * h) ** -0.5),
            "out_b": np.zeros(1, np.float32),
        }
        for way in "fb":
            self.p[f"x{way}"] = draw(d, 3 * h, scale=d**-0.5)
            self.p[f"u{way}"] = draw(h, 3 * h, scale=h**-0.5)
            self.p[f"b{way}"] = np.zeros(3 * h, np.float32)
        self.shift = 0.0  # added to every logit: the sample's classes are balanced, the labels' aren't

    def embed(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        whole, pieces, begin = inputs(words)
        vectors = self.p["piece"][pieces]
        return np.concatenate([self.p["word"][whole], np.maximum.reduceat(vectors, begin)], axis=1), (whole, pieces, begin, vectors)

    def _direction(self, way: str, gates: np.ndarray, here: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States by step; ``gates`` are the words' input gates, step by step in reading order."""
        h, u = HIDDEN, self.p[f"u{way}"]
        state = np.zeros((gates.shape[1], h), dtype=np.float32)
        states, kept = np.empty((len(gates), gates.shape[1], h), dtype=np.float32), []
        for t in range(len(gates)):
            inner = state @ u
            zr = _sigmoid(gates[t, :, : 2 * h] + inner[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h :] + r * inner[:, 2 * h :])
            m = here[t][:, None]
            if keep:
                kept.append((state, z, r, new, inner[:, 2 * h :], m))
            state = np.where(m, new + z * (state - new), state)
            states[t] = state
        return states, kept

    def forward(self, x: np.ndarray, place: np.ndarray, here: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logit per window; ``place`` are rows of ``x``, one per word of the window."""
        p = self.p
        steps, mask = place.T, here.T
        ahead, kf = self._direction("f", (x @ p["xf"] + p["bf"])[steps], mask, keep)
        back, kb = self._direction("b", (x @ p["xb"] + p["bb"])[steps[::-1]], mask[::-1], keep)
        states = np.concatenate([ahead, back[::-1]], axis=2)
        hidden = np.tanh(states @ p["att"] + p["att_b"])
        score = np.where(mask, hidden @ p["att_v"], np.float32(-30))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        return pooled @ p["out"] + p["out_b"][0], (states, hidden, weight, pooled, kf, kb)

    def gradient(self, x: np.ndarray, place: np.ndarray, here: np.ndarray, wrong: np.ndarray, kept: tuple) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of ``x`` from those of the logits."""
        p, h = self.p, HIDDEN
        states, hidden, weight, pooled, kf, kb = kept
        g = {"out": pooled.T @ wrong, "out_b": wrong.sum(keepdims=True)}
        d_pooled = wrong[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att_v"] = np.einsum("tn,tna->a", d_score, hidden)
        d_hidden = d_score[:, :, None] * p["att_v"] * (1 - hidden**2)
        g["att"] = np.einsum("tnh,tna->ha", states, d_hidden)
        g["att_b"] = d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ p["att"].T
        d_x = np.zeros_like(x)
        sides = (("f", kf, d_states[:, :, :h], place.T), ("b", kb, d_states[::-1, :, h:], place.T[::-1]))
        for way, steps, d_out, at in sides:
            u = p[f"u{way}"]
            g_u, d_state = np.zeros_like(u), np.zeros_like(d_out[0])
            d_gates = np.zeros((len(steps), len(place), 3 * h), dtype=np.float32)
            for t in range(len(steps) - 1, -1, -1):
                state, z, r, new, inner, m = steps[t]
                d = d_state + d_out[t]
                d_new = np.where(m, d * (1 - z), 0) * (1 - new**2)
                d_z = np.where(m, d * (state - new), 0) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                g_u += state.T @ d_inner
                d_state = np.where(m, d * z, d) + d_inner @ u.T
            flat = d_gates.reshape(-1, 3 * h)
            rows = at.reshape(-1)
            g[f"u{way}"], g[f"b{way}"] = g_u, flat.sum(axis=0)
            by_word = np.zeros((len(x), 3 * h), dtype=np.float32)
            np.add.at(by_word, rows, flat)
            g[f"x{way}"] = x.T @ by_word
            d_x += by_word @ p[f"x{way}"].T
        return g, d_x

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability per text."""
        words = [_WORD.findall((t or "").lower()) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        codes, distinct = pd.factorize(np.array([w for own in words for w in own] + [" "], dtype=object))
        del words
        x, _ = self.embed(list(distinct))
        text, place, here = windows(sizes)
        best = np.full(len(texts), -np.inf)
        for at in range(0, len(text), TOGETHER):
            piece = slice(at, at + TOGETHER)
            logit, _ = self.forward(x, codes[place[piece]], here[piece])
            np.maximum.at(best, text[piece], logit.astype(np.float64))
        return _sigmoid(best + self.shift)


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, d in g.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * d
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * d * d
            p[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def _log_odds(has: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of the shares of toxic and other texts; ``has`` counts texts by class and row."""
    share = (has + 2) / (sizes[:, None] + 2)
    return np.log(share[1] / share[0]) - np.log((sizes[0] + 2) / (sizes[1] + 2))


def _rows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``inputs`` of many words, in small numbers; ``begin`` has the end as well."""
    parts = [inputs(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
    parts = [(w.astype(np.uint16), p.astype(np.uint16), np.diff(np.r_[b, len(p)])) for w, p, b in parts]
    whole, pieces, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return whole, pieces, np.r_[0, np.cumsum(counts)]


def train(texts: list[str], labels: np.ndarray, prior: float, steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit a network to whole-text labels: of each text the window it finds most toxic is learned.

    Word and piece vectors start with the log odds of their rows among the texts, the rest at
    random; batches hold as many toxic texts as others. ``prior`` is the share of toxic labels.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng)
    numbers: dict[str, int] = {" ": 0}
    own_codes = []
    for text in texts:
        words = _WORD.findall(text.lower())
        own_codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
    distinct = list(numbers)
    del numbers
    whole, pieces, begin = _rows_of(distinct)
    has_word, has_piece = np.zeros((2, WORD_ROWS)), np.zeros((2, PIECE_ROWS))
    for own, label in zip(own_codes, labels, strict=True):
        used = np.unique(own)
        has_word[label, whole[used]] += 1
        if len(used):
            has_piece[label, np.concatenate([pieces[begin[i] : begin[i + 1]] for i in used])] += 1
    del whole, pieces, begin
    by_class = np.bincount(labels, minlength=2)
    net.p["word"][:, 0] = _log_odds(has_word, by_class)
    net.p["piece"][:, 0] = _log_odds(has_piece, by_class)
    sizes = np.array([len(c) for c in own_codes], dtype=np.int64)
    codes = np.concatenate([*own_codes, np.zeros(1, dtype=np.int32)])
    del own_codes
    first = np.cumsum(sizes) - sizes
    classes = [np.flatnonzero(labels == y) for y in (0, 1)]
    adam = _Adam(RATE)
    for _ in range(steps):
        batch = np.concatenate([rng.choice(own, BATCH // 2) for own in classes])
        text, place, here = windows(sizes[batch])
        start = np.cumsum(sizes[batch]) - sizes[batch]
        place = np.where(here, place - start[text][:, None] + first[batch][text][:, None], len(codes) - 1)
        rows, local = np.unique(codes[place], return_inverse=True)
        local = local.reshape(place.shape)
        x, (own, parts, cut, vectors) = net.embed([distinct[i] for i in rows])
        steps_of = range(0, len(local), TOGETHER)
        logit = np.concatenate([net.forward(x, local[i : i + TOGETHER], here[i : i + TOGETHER])[0] for i in steps_of])
        best = np.full(len(batch), -np.inf)
        np.maximum.at(best, text, logit)
        chosen = np.flatnonzero(logit == best[text])
        chosen = chosen[np.unique(text[chosen], return_index=True)[1]]
        logit, kept = net.forward(x, local[chosen], here[chosen], keep=True)
        wrong = ((_sigmoid(logit) - labels[batch]) / len(batch)).astype(np.float32)
        g, d_x = net.gradient(x, local[chosen], here[chosen], wrong, kept)
        g["word"] = np.zeros_like(net.p["word"])
        np.add.at(g["word"], own, d_x[:, :WIDTH])
        g["piece"] = np.zeros_like(net.p["piece"])
        piece_owner = np.repeat(np.arange(len(rows)), np.diff(np.r_[cut, len(parts)]))
        top = vectors == x[piece_owner, WIDTH:]
        at, column = np.nonzero(top)
        np.add.at(g["piece"], (parts[at], column), d_x[piece_owner[at], WIDTH + column])
        adam.step(net.p, g)
    net.shift = float(np.log(prior / (1 - prior)))
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """A network from rows that are not held out, or the share of toxic rows if one class is missing.

    The sample of each class are the rows with the smallest hashes of their ids; it goes to the
    driver, ``sample`` whole texts a class.
    """
    known = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    known = known.join(ids, "doc_id")
    count = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        return count.get(1, 0) / (sum(count.values()) + 1)
    parts = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    prior = count[1] / (count[0] + count[1])
    return train([r.text or "" for r in rows], np.array([r.toxic for r in rows]), prior)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    net = fit(docs, labels)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if isinstance(net, float):
                yield pd.Series(np.full(len(texts), net))
                continue
            values, own = texts.tolist(), []
            ends = np.cumsum([len(t or "") for t in values])
            cuts = np.searchsorted(ends, np.arange(CHUNK, ends[-1] if len(ends) else 0, CHUNK))
            for part in np.split(np.arange(len(values)), np.unique(cuts)):
                if len(part):
                    own.append(net.scores([values[i] for i in part]))
            yield pd.Series(np.concatenate(own) if own else np.zeros(0))

    scored = docs.drop("score", "predicted").withColumn("score", F.pandas_udf(run, "double")(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic."""
    return score(docs, labels).filter("predicted = 0").select(*docs.columns)
