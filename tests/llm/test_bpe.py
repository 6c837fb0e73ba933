import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandloom.llm import bpe

TEXTS = [
    None, "", "  \n", "Hello world's I'M don'T", "a<|startoftext|>b <|endoftext|>", "<|StartOfText|><|endoftext|><|endoftext|>x<|", "ΑΣ ΟΔΟΣ Σ",
    "İstanbul ǅ", "ﬁ é é", "😀😁 12½ ²x_y", "a\0b", "​ zero\x1c\x1dy", "'s 'S 'll'LL''d", "a\x85b\xa0c　d", "ᾳ ΐ \U00010400xᲉꟋ",
    "aaaaaaa" * 300, "ababab" * 999, "!?!?!!??" * 200, "\0<|endoftext|>", "한국어 日本語 العربية हिन्दी",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_equals_the_library(library):
    r = random.Random(3)
    alphabet = "aabcdeeiotnrsh  ''’ÀéßñÉ12!?.,-<|>\ń😀中σΣ"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 300))) for _ in range(400)]
    own = bpe.codec()
    for text, (ids, shown) in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want, text
        assert shown == library.decode(want, skip_special_tokens=False)
        assert own.decode(want) == shown


def test_small_memory_changes_nothing(monkeypatch):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(50)) for _ in range(40)]
    want = bpe.codec().encode_batch(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    assert bpe.Codec(public_tokenizers.path(bpe.VOCABULARY)).encode_batch(texts) == want


def test_frames(spark, library):
    rows = [(i, t, None, None, None, "clash") for i, t in enumerate(TEXTS)] + [(1, "twice", "en", "s", 5, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    encoded = bpe.encode(docs)
    got = encoded.collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows if i != 1}
    for x in got:
        if x.doc_id in text:
            want = library.encode(text[x.doc_id] or "", add_special_tokens=False).ids
            assert x.ids == want and x.n_tokens == len(want)
            assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    for x in bpe.decode(encoded).collect():
        if x.doc_id in text:
            assert x.text == library.decode(library.encode(text[x.doc_id] or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0)).count() == 0
    assert sorted(bpe.digests(docs).collect()) == sorted(encoded.drop("ids").collect())


def test_very_long_words_equal_the_library_at_bounded_work(library):
    r = random.Random(9)
    some = lambda n, letters: "".join(r.choices(letters, k=n))
    syllables = "".join(r.choice(("the", "ing", "tion", "er", "re", "un", "a", "schen")) for _ in range(3000))
    words = [some(6000, "etaoinshrdlu"), syllables, "a" * 5001, "ab" * 2000 + "a", "!?" * 1500 + "!!!", "ñé" * 900, "x" * (bpe.LONG + 1), some(40_000, "abcdefghijklmnopqrstuvwxyz")]
    own = bpe.codec()
    for word in words:
        ids, touched = own.merge_long(word.encode())
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
        assert touched <= 6 * len(word.encode())  # places touched in all rounds, whatever the word
    text = f"short {words[0]} and {words[2]} end"
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids and words[0] not in own.ids_of
