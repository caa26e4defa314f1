"""BPE against the public library, over all code points and awkward texts, and as a round trip."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidex.llm import bpe
from tests.llm.test_simhash import key

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_tables(PATH))


def same(library, codec, texts):
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids, repr(text)
        assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point(library, codec):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(library, codec, ("a" + "".join(points[i : i + 256]) + "1" for i in range(0, 0x34000, 256)))
    same(library, codec, ("a" + c + "!" for c in points[:0x3000]))


def test_marks_in_any_order(library, codec):
    rng = random.Random(5)
    marks = [c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))] + [0x65, 0x430]
    same(library, codec, ("".join(chr(rng.choice(marks)) for _ in range(12)) for _ in range(3000)))
    decomposed = (unicodedata.normalize("NFD", chr(c)) for c in range(0xA0, 0x30000) if not 0xD800 <= c < 0xE000)
    same(library, codec, decomposed)


def test_random_words(library, codec):
    rng = random.Random(6)
    for letters in ("aab", "abeint ", "is'tlve d0", "<|endoftxs>"):
        same(library, codec, ("".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(1500)))


def test_special_tokens_and_blanks(library, codec):
    same(library, codec, ["", " \t\n", "a<|endoftext|>B<|startoftext|>", "<|endoftext|><|endoftext|", "ΑΣ ΟΔΟΣ İI'LL", "ab" * 20000])


def test_few_remembered_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    monkeypatch.setattr(bpe, "DECODED", 4)
    small = bpe.Codec(bpe.read_tables(PATH))
    same(library, small, ["the quick brown fox", "jumps over the lazy dog the fox", "unbelievably long wordings"] * 3)


def test_digests_match_the_library(spark, mixed, rows, library):
    want = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = bpe.digests(mixed, PATH)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_encode_and_decode_frames(spark, mixed, rows, library):
    encoded = bpe.encode(mixed, PATH)
    assert encoded.columns == ["doc_id", "ids"]
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    got = sorted((str(r.doc_id), r.ids) for r in encoded.collect())
    assert got == sorted((str(d), i) for (d, _, _), i in zip(rows, ids, strict=True))
    texts = sorted((str(r.doc_id), r.text) for r in bpe.decode(encoded, PATH).collect())
    assert texts == sorted((str(d), library.decode(i, skip_special_tokens=False)) for (d, _, _), i in zip(rows, ids, strict=True))
    odd = spark.createDataFrame([(1, None), (2, [None, 320, -1, 99999999]), (3, [])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: "", 2: "a</w>", 3: ""}
    assert bpe.digests(mixed.filter("false"), PATH).count() == 0


def test_other_vocabulary_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.read_tables(public_tokenizers.path("byte_bpe_50k.json"))
