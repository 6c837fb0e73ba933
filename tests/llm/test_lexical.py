import math
import random
import re

import numpy as np
import pytest

from strandloom.llm import lexical

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, score long, query long"
ITEMS = "item_id long, text string, rank int, words string"
WORDS = "and of Tree née Straße 2024 x9 river lantern moss ÉCOLE quill ember 木 drift".split()


def brute(docs, items, k):
    found = [re.findall(lexical.PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), d[1] or "")) for d in docs]
    n_docs, n_words = sum(map(bool, found)), sum(map(len, found))
    df = {t: sum(t in f for f in found) for f in found for t in f}
    out = []
    for item in items:
        asked, rows = re.findall(lexical.PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), item[1] or "")), []
        for d, f in zip(docs, found, strict=True):
            total = 0
            for t in asked:
                if t in df:
                    m = 75 + 25 * len(f) * n_docs // n_words
                    total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * f.count(t) // (1000 * f.count(t) + 12 * m))
            rows.append((-total, d[0] is None, d[0] or 0))
        out += [(item[0], i + 1, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(r for r in rows if r[0] < 0)[:k])]
    return sorted(out, key=str)


def tables(r, n, longest):
    docs = [(i, " ".join(r.choices(WORDS, weights=range(15, 0, -1), k=r.randint(1, longest))), "en", "s", 1, "clash", 3, 4) for i in range(n)]
    docs += [(900, None, None, None, None, None, None, None), (901, "", "en", "s", 0, "", 1, 1), (902, " ,;: ", "en", "s", 0, "", 1, 1), (None, docs[3][1], "en", "s", 1, "c", 1, 1)]
    docs += [docs[3]] * 3 + [(950 + i, docs[5][1], "en", "s", 1, "c", 1, 1) for i in range(7)]
    items = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 9))), 1, "clash") for i in range(12)]
    return docs, [*items, (50, None, 1, ""), (51, "absent words", 1, ""), (None, "river moss", 1, ""), items[0], items[0]]


@pytest.mark.parametrize("rows,postings,open_docs", [(50_000, 1_000_000, 256), (7, 1_000_000, 2), (50_000, 40, 1)])
def test_equals_whole_scores(spark, monkeypatch, rows, postings, open_docs):
    for name, value in (("ROWS", rows), ("POSTINGS", postings), ("OPEN", open_docs)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = tables(random.Random(rows), 90, 30)
    for k, size in ((20, 4_000_000), (3, 60)):
        out = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k, size)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(x) for x in out.collect()), key=str) == brute(docs, items, k)


def test_small_tables(spark):
    docs, items = tables(random.Random(1), 5, 4)
    empty_docs, empty_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.search(empty_docs, spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical.search(spark.createDataFrame(docs, DOCS), empty_items).count() == 0
    assert lexical.search(spark.createDataFrame(docs[5:8], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_a_long_text_is_split_without_cutting_terms():
    from strandloom.llm.terms import folding, pieces

    raw = b"Ab c," * 1000 + b"x" * 5000 + b" end"
    got = list(pieces(raw, folding(), 64))
    assert len(got) > 50 and [w for p in got for w in p] == re.findall(rb"[a-z]+", raw.lower())


def test_stops_before_all_groups_are_processed(monkeypatch):
    """A rare term's groups prove the best documents; a frequent term's postings are left but for completion."""
    r = np.random.default_rng(0)
    n, touched = 4000, []
    weight = np.array([9000, 40])
    owner = sorted([*range(n), *range(0, n, 50)])
    block = lexical.Block(list(range(n)), [20] * n, owner, [0 if i and owner[i] == owner[i - 1] else 1 for i in range(len(owner))], r.integers(1, 4, len(owner)).tolist(), weight, n, 20 * n)
    whole = lexical.Block.complete
    monkeypatch.setattr(lexical.Block, "complete", lambda self, docs, wanted: touched.append(len(docs)) or whole(self, docs, wanted))
    wanted = np.array([1, 1])
    docs, scores = block.best(np.array([0, 1]), np.array([1, 1]), wanted, 20, 0)
    assert touched and touched[0] <= lexical.OPEN
    every = whole(block, np.arange(n), wanted)
    assert sorted(scores)[-20:] == sorted(every)[-20:] and (every[docs] == scores).all()
    assert len(block.best(np.array([0, 1]), np.array([1, 1]), wanted, 20, int(every.max()) * 3)[0]) == 0
