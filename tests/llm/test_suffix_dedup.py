import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import suffix_dedup as sd
from strandloom.llm.common import utf8_view

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def corpus(length, seed=2):
    r = random.Random(seed)
    some = lambda n, s="abcd é\n": "".join(r.choice(s) for _ in range(n))
    long_ = [some(length * 3) for _ in range(4)]
    texts = [None, "", "short", "x" * (length * 2), "x" * length, "ab" * length, some(length - 1), some(length)]
    for _ in range(40):
        a = r.choice(long_)
        i = r.randint(0, length)
        texts.append(some(r.randint(0, length)) + a[i : i + length + r.randint(-30, length)] + some(r.randint(0, length)))
    texts += [long_[0], long_[0], some(length * 9), long_[1] + long_[1], long_[2][:length], long_[3][1:]]
    return texts


@pytest.mark.parametrize("crowd", [sd.CROWD, 3])
def test_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(sd, "CROWD", crowd)
    length = 64
    texts = corpus(length)
    docs = spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in enumerate(texts)] , SCHEMA).repartition(3)
    got = {x.doc_id: x for x in sd.clean(docs, length).collect()}
    for i, want in enumerate(brute(texts, length)):
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) == want, i


def test_repeated_rows_and_empty(spark):
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(300))
    docs = spark.createDataFrame([(1, text, "en", "s", 1, "")] * 2 + [(2, text[:150], "en", "s", 1, ""), (None, text[160:], "en", "s", 1, "")], SCHEMA)
    assert sorted((x.n_bytes, x.n_removed) for x in sd.clean(docs, 200).collect()) == [(140, 0), (150, 0), (300, 300), (300, 300)]
    assert sd.clean(docs.limit(0)).count() == 0


def test_phrases_cover_every_start_once():
    for text in corpus(64, 5):
        data, bounds = utf8_view(pa.array([text, "tail " * 30, text]))
        row, lo, hi, place, _, phrase = sd.phrases(data, bounds, 64)
        for k in range(3):
            mine = row == k
            starts = [p for a, b in zip(lo[mine], hi[mine]) for p in range(a, b + 1)]
            assert starts == list(range(bounds[k], max(bounds[k], bounds[k + 1] - 63)))
        assert (phrase[row == 0] == phrase[row == 2]).all()
        assert ((place >= lo) & (place <= lo + 64)).all()


def test_ranks_are_suffix_order():
    raw = b"banana$bandana$an"
    ends = np.array([7] * 7 + [15] * 8 + [17] * 2)
    rank = sd.depth_ranks(np.frombuffer(raw, np.uint8), ends, 3)
    held = [i for i in range(len(raw)) if rank[i] >= 0]
    assert held == [i for i in range(len(raw)) if i + 3 <= ends[i]]
    assert sorted(held, key=lambda i: (rank[i], i)) == sorted(held, key=lambda i: (raw[i : i + 3], i))
