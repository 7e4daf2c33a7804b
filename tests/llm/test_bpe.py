import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tagloom.llm import bpe  # noqa: E402
from tagloom.llm.bpe import Vocabulary, bpe_decode, bpe_encode, bpe_round_trip  # noqa: E402

PATH = P.path("word_bpe_49k.json")
TEXTS = [
    "", "  ", "ΣΑΣ ΟΔΟΣ", "İstanbul", "é å", "日本語テキスト 漢字", "a" * 3000, "ab" * 2000 + "!" * 500,
    "<|startoftext|>hi<|endoftext|>", "x<|endoftext|>y", "<|ENDOFTEXT|>", "it's I'LL don’t", "a b\x85c　d\x1ce\x1ff",
    "emoji 👩‍👩‍👧 😀", "1234567 12,345.67", "≠ ≯x", "ﬁ ﬂ Å Å", "tab\tnew\nline\x0bv\x0cf\r", "​z﻿", "ǅ ᾳ ᾼ", "֌ r֌d", "nul\x00byte",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_texts_equal_the_library(library):
    known = Vocabulary(open(PATH, encoding="utf-8").read())
    for text in TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        packed = known.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want, text
        assert known.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_fragments_are_encoded_on_their_own(library):
    """Concatenated fragments are the word; no fragment holds a pair that no token joins."""
    known = Vocabulary(open(PATH, encoding="utf-8").read())
    words = ["internationalisation", "xqzjxqv", "été", "naïveté", "a" * 63, "a" * 64, "a" * 65, "ab" * 40 + "c", "x", "9", "​"]
    together = known.words_encoded([w.encode() for w in words])
    for word, packed in zip(words, together):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids, word
    data = np.frombuffer("xqzjxqv".encode(), np.uint8).astype(int)
    assert not known.inside[data[:-1] << 8 | data[1:]].all()
    assert known.words_encoded([]) == []
    # Merges that build on later ones are merged one by one.
    known.ordered = False
    assert known.words_encoded([w.encode() for w in words]) == together


def test_random_words_and_stretches_equal_the_library(library, monkeypatch):
    known = Vocabulary(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    alphabet = "aabbeeioutnrs'stdLé9.,!-ß日🙂 \n"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 400))) for _ in range(300)] + TEXTS
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(p, "<u4").tolist() for p in known.encode_all(texts)] == want
    # The same with stretches of a few characters and memories of a few pieces.
    monkeypatch.setattr(bpe, "_TOGETHER", 50)
    monkeypatch.setattr(bpe, "_REMEMBERED", 20)
    assert [np.frombuffer(p, "<u4").tolist() for p in known.encode_all(texts)] == want
    assert len(known.young) + len(known.old) < 200


def test_odd_rows(odd, rows, library, none):
    got = sorted(((r.doc_id or -1, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe_decode(bpe_encode(odd, PATH), PATH).collect()))
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0] or -1, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert sorted(map(tuple, bpe_round_trip(odd, PATH).fillna(-1, ["doc_id"]).collect())) == sorted(want)
    assert bpe_decode(bpe_encode(none, PATH), PATH).collect() == [] == bpe_round_trip(none, PATH).collect()


def test_documents(documents, library):
    for r in bpe_encode(documents, PATH).join(documents.select("doc_id", "text"), "doc_id").limit(200).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids
