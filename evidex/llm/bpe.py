"""BPE encoding and decoding with a given vocabulary.

A word is a string over 512 symbols: the 256 bytes, and the 256 bytes that end a word. An
Aho-Corasick automaton of the reversed tokens, run once over the reversed word, names the longest
token at each position. The backtracking encoder takes that token if it is compatible with the
token before it, otherwise the next shorter token that is its prefix, and if none is left it takes
the last token back; an end once given up is not tried again, so a word costs time in proportion to
its length. Two neighbours are compatible if no merge across their border comes before the merges
that built them: the pair-compatibility table holds these answers, filled as pairs are met. Tokens
that merging can't reach (a merge inside their own text would come first) are not in the automaton.
The result is that of merging by rank. Decoding gathers the tokens' texts out of one byte string by
a table of offsets.

Texts become words as the file says: Unicode NFC, white space runs as one blank, lower case by
code point, split by the file's pattern; special tokens are matched before all that. Without a
decoder in the file, decoded tokens are joined by one blank.

The driver reads the file, whose path is an argument, and broadcasts its tables: their size is that
of the vocabulary. A task keeps at most 2 x ``WORDS`` words besides those of one text, and ``PAIRS`` answers.

Defined cases: a null text is empty and has no tokens; rows that repeat an id are answered one by
one, null ids as well; extra columns are ignored; ids outside of the vocabulary decode to nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a task remembers before it starts anew, with the last ones beside them, and the length up to
#: which a word is remembered (a text may add its own words to them); pair answers likewise.
WORDS, PAIRS, WORD_LENGTH = 1 << 18, 1 << 20, 64
#: Tokens decoded at once.
DECODED = 1 << 18
NO_LIMIT = 1 << 30
FIRST_MERGE = 512

# The file's text steps, which this module performs.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# Letters and digits newer than the Unicode tables of the vocabulary's split pattern.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
# Combining marks newer than the vocabulary's normal form, to which they are plain letters.
MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C),
    (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C),
    (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99),
    (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
# Fixed values: (first, last, lower case of the first) of capitals that Python's tables lack.
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its Latin-1 letter, or from U+0100 on if that can't be seen."""
    out, spare = {}, 0x100
    for byte in range(256):
        letter = chr(byte)
        if byte <= 0x20 or 0x7F <= byte <= 0xA0 or byte == 0xAD:
            letter, spare = chr(spare), spare + 1
        out[letter] = byte
    return out


def read_tables(path: str) -> dict:
    """The vocabulary file as plain tables; raises where the file asks for steps not built here."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, splits = held["model"], held["pre_tokenizer"]["pretokenizers"]
    steps = [n["type"] for n in held["normalizer"]["normalizers"]]
    if steps != NORMALIZERS or model["type"] != "BPE" or [s["type"] for s in splits] != ["Split", "ByteLevel"] or held["decoder"]:
        raise ValueError(f"{path} asks for other text steps than {NORMALIZERS}, one split and byte-level BPE")
    suffix, vocabulary, letters = model["end_of_word_suffix"], model["vocab"], _byte_letters()

    def symbols(token: str) -> str:
        ends = token.endswith(suffix)
        raw = [letters[c] for c in (token.removesuffix(suffix) if ends else token)]
        return "".join(map(chr, [*raw[:-1], raw[-1] + 256 * ends]))

    texts = [""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        texts[number] = token
    words = [symbols(t) for t in texts]
    left, right = list(range(len(texts))), list(range(len(texts)))
    pairs: dict[tuple[int, int], int] = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = (vocabulary[m] for m in (merge.split(" ") if isinstance(merge, str) else merge))
        whole = vocabulary[texts[a] + texts[b]]
        if whole != FIRST_MERGE + rank or max(a, b) >= whole:
            raise ValueError(f"merge {rank} of {path} isn't in the order of the ids")
        left[whole], right[whole], pairs[a, b] = a, b, whole
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    named = texts + [""] * (max([len(texts) - 1, *special.values()]) + 1 - len(texts))
    for content, number in special.items():
        named[number] = content
    joined = [t.encode() + b" " for t in named]
    known = {w: i for i, w in enumerate(words)}
    reached = [True] * len(words)
    tables = {
        "left": left, "right": right, "pairs": pairs, "lengths": [len(w) for w in words],
        "pattern": splits[0]["pattern"]["Regex"], "special": special,
        "blob": b"".join(joined), "offsets": np.r_[0, np.cumsum([len(t) for t in joined])],
    }
    for i in range(FIRST_MERGE, len(words)):
        reached[i] = reached[left[i]] and reached[right[i]] and not crossed(tables, left[i], right[i], i)
    shorter, automaton = [-1] * len(words), ahocorasick.Automaton()
    for i, word in enumerate(words):
        if not reached[i]:
            continue
        automaton.add_word(word[::-1], i)
        for size in range(len(word) - 1, 0, -1):
            prefix = known.get(word[:size], -1)
            if prefix >= 0 and reached[prefix]:
                shorter[i] = prefix
                break
    automaton.make_automaton()
    return tables | {"shorter": shorter, "automaton": automaton}


def crossed(tables: dict, first: int, second: int, limit: int = NO_LIMIT) -> bool:
    """Whether merging would join parts across the border of two tokens before ``limit``.

    From the end backwards: the parts at the border at one time are a and b, which the merges
    ``until_a`` and ``until_b`` take away; a merge of the two comes about if it is due earlier. Of
    equal merges the left one comes first.
    """
    left, right, pairs = tables["left"], tables["right"], tables["pairs"]
    a, b, until_a, until_b = first, second, limit, limit
    while True:
        joined = pairs.get((a, b), NO_LIMIT)
        if joined < until_a and joined <= until_b and joined != limit:
            return True
        if a < FIRST_MERGE and b < FIRST_MERGE:
            return False
        if a > b:
            a, until_a = right[a], a
        else:
            b, until_b = left[b], b


def _one_of(ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


class Codec:
    """Encoder and decoder over the tables of one vocabulary."""

    def __init__(self, tables: dict) -> None:
        self.tables = tables
        self.shorter, self.lengths, self.automaton = tables["shorter"], tables["lengths"], tables["automaton"]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pattern = regex.compile(tables["pattern"])
        self.special = tables["special"]
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.newer = regex.compile(_one_of(NEWER))
        self.apart = regex.compile(f"({_one_of(MARKS)})")
        self.capitals = {c: low + c - a for a, b, low in CAPITALS for c in range(a, b + 1)}
        self.capital = regex.compile("[" + "".join(map(chr, self.capitals)) + "]")
        self.blob = np.frombuffer(tables["blob"], dtype=np.uint8)
        self.offsets = tables["offsets"]

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        text = "".join(unicodedata.normalize("NFC", part) for part in self.apart.split(text))
        text = text.replace("Σ", "σ")  # no final form of the letter
        if self.capital.search(text):
            text = text.translate(self.capitals)
        text = text.lower()
        if not self.newer.search(text):
            return self.pattern.findall(text)
        plain = self.newer.sub("", text)  # neither letter nor digit, as they are to the pattern
        return [text[slice(*found.span())] for found in self.pattern.finditer(plain)]

    def merge(self, word: str) -> list[int]:
        """Tokens of one word."""
        raw = word.encode()
        size = len(raw)
        turned = chr(raw[-1] + 256) + raw[-2::-1].decode("latin-1") if size > 1 else chr(raw[0] + 256)
        longest = [-1] * size
        for end, token in self.automaton.iter(turned):  # of the tokens at one end the longest comes first
            if longest[size - 1 - end] < 0:
                longest[size - 1 - end] = token
        out: list[int] = []
        open_end = bytearray(b"\x01") * (size + 1)
        at, token = 0, longest[0]
        while True:
            end = at + self.lengths[token]
            if open_end[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                if end == size:
                    return out
                at, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_end[at] = 0
                token = out.pop()
                at -= self.lengths[token]

    def fits(self, first: int, second: int) -> bool:
        known = self.compatible.get((first, second))
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[first, second] = not crossed(self.tables, first, second)
        return known

    def word(self, word: str) -> bytes:
        """Tokens of one word, not in ``words``, as little-endian unsigned 32-bit integers."""
        out = self.older.get(word) or np.array(self.merge(word), dtype="<u4").tobytes()
        if len(word) <= WORD_LENGTH:
            self.words[word] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        if len(self.words) >= WORDS:
            self.words, self.older = {}, self.words
        text, known, parts, start = text or "", self.words, [], 0
        for mark in [*self.marks.finditer(text), None]:
            piece = text[start : mark.start()] if mark else text[start:]
            parts += [known.get(w) or self.word(w) for w in self.split(piece)]
            if mark:
                parts.append(np.array([self.special[mark.group()]], dtype="<u4").tobytes())
                start = mark.end()
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: each token's place comes from the table of offsets."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        parts = []
        for i in range(0, len(ids), DECODED):
            start = self.offsets[ids[i : i + DECODED]]
            size = self.offsets[ids[i : i + DECODED] + 1] - start
            place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            parts.append(self.blob[place].tobytes())
        return b"".join(parts)[:-1].decode()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text)."""
    tables = docs.sparkSession.sparkContext.broadcast(read_tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for batch in batches:
            ids = [codec.encode(t.as_py()).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, f"doc_id {_id_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids count as none."""
    tables = encoded.sparkSession.sparkContext.broadcast(read_tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for batch in batches:
            texts = [codec.decode(np.array([i for i in x.as_py() or [] if i is not None])) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_id_type(encoded)}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every row encoded, and its ids decoded again."""
    tables = docs.sparkSession.sparkContext.broadcast(read_tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(
        run, f"doc_id {_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
