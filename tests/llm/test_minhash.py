import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import components, minhash, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string"


def brute(rows, k):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    rows, base = [], [word() for _ in range(120)]
    for _ in range(60):  # one large family at every distance
        rows.append([w if r.random() > r.choice((0, 0.005, 0.01, 0.02, 0.03, 0.05)) else word() for w in base])
    for i in range(30):  # chains of small steps
        rows.append([w if r.random() > 0.015 else word() for w in rows[-1]])
    for _ in range(40):  # one common passage in unlike texts
        rows.append(base[:60] + [word() for _ in range(r.randint(20, 90))])
    rows += [[word() for _ in range(r.randint(1, 40))] for _ in range(20)]
    rows += [rows[3], rows[70], rows[-1], [w.upper() for w in rows[5]]]
    texts = [r.choice((" ", "\n", "\t ")).join(x) for x in rows] + [None, "", " \t", "a", "A", "a b", "a b c d", "a a a a a a a", "É x", "é x", "a b", "x " * 5000]
    return [(i * 7 + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [4])
def test_groups_equal_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(minhash, "SMALL", 4)
    rows = corpus(k)
    docs = spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in rows], SCHEMA).repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, k).collect()}
    assert got == brute(rows, k)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "en", "s", 1, "x")] * 3 + [(6, "a b c d e f", "en", "s", 1, "x"), (7, None, None, None, None, None)], SCHEMA)
    assert sorted((x.doc_id, x.component_id) for x in minhash.near_duplicates(docs, 5).collect()) == [(5, 5)] * 3 + [(6, 5), (7, 7)]
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [5, 7]
    assert minhash.near_duplicates(docs.limit(0), 4).count() == 0


def test_one_id_with_unlike_texts_and_null_ids(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice("abcdefghij") * r.randint(1, 6) for _ in range(80))
    one, two, three = text(), text(), text()
    near = " ".join(three.split()[:-1])
    rows = [(1, one), (1, two), (1, two), (2, three), (3, near), (None, near), (None, one), (4, None), (4, " "), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in rows], SCHEMA)
    kept = minhash.keep_one(docs).collect()
    assert sorted(str((x.doc_id, x.text)) for x in kept) == sorted(str(x) for x in [(1, one), (1, two), (2, three), (4, None), (4, " "), (None, "")])
    got = sorted(str((x.doc_id, x.component_id)) for x in minhash.near_duplicates(docs, 4).collect())
    assert got == sorted(str(x) for x in [(1, 1), (1, 1), (1, 1), (2, 2), (3, 2), (None, 2), (None, 1), (4, 4), (4, 4), (None, None)])


@pytest.mark.parametrize("n", [150, 300])
def test_passage_tables_emit_few_pairs(spark, monkeypatch, n):
    """Documents of 15 of 20 shared passages: nearly all share bands, few are linked."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8)))
    passages = [" ".join(word() for _ in range(25)) for _ in range(20)]
    rows = [(i, " ".join(passages[j] for j in sorted(r.sample(range(20), 15)))) for i in range(n)]
    shipped, verify = [], minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, texts, k: (shipped.append(pairs.count()), verify(pairs, texts, k))[1])
    docs = spark.createDataFrame([(i, t, None, None, None, None) for i, t in rows], SCHEMA)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, 4).collect()}
    assert got == brute(rows, 4)
    # one pair a band and longer piece at most; of the pairs of small buckets and of hot ones only those that bitmaps allow
    stars, small, pieces, hot = shipped
    assert stars <= 32 * n and pieces <= 16 * n and small + hot <= n, shipped


def test_bitmaps_never_refuse_a_link(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts, links = [], 0
    for _ in range(60):
        base = [word() for _ in range(r.choice((5, 12, 60, 130, 400)))]
        texts += [" ".join(base), " ".join(w if r.random() > r.choice((0.0, 0.02, 0.06)) else word() for w in base), " ".join(base[: int(len(base) * r.uniform(0.75, 1))])]
    table = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    drawn = {(x.rep, x.width): x.bits for x in minhash.bitmaps(table, 4).collect()}
    sets = [e for _, elements, bounds in shingles.shingle_sets(pa.array(texts), 4) for e in np.split(elements, bounds[1:-1])]
    for i in range(0, len(texts), 3):
        for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2)):
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                links += 1
                shared = [w for rep, w in drawn if rep == a and (b, w) in drawn]
                assert shared
                for w in shared:
                    differing = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(drawn[a, w], drawn[b, w]))
                    assert 180 * differing <= 20 * (len(x) + len(y))
    assert links > 40


def test_signature_matches_follow_similarity():
    r = np.random.default_rng(1)
    for j in (0.3, 0.8):
        hits = []
        for _ in range(60):
            base = r.integers(0, 2**63, 400, dtype=np.uint64)
            n = int(400 * 2 * j / (1 + j) / 2)
            a, b = np.unique(base[:200]), np.unique(np.concatenate((base[:n], base[200 : 400 - n])))
            s = shingles.super_minhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 128)
            hits.append((s[0] == s[1]).mean())
        true = n / (400 - n)
        assert abs(np.mean(hits) - true) < 0.02 and np.std(hits) < 1.3 * (true * (1 - true) / 128) ** 0.5


def test_signature_does_not_depend_on_neighbours():
    column = pa.array(["a b c d e f g", "h i", None, "a b c d e f g " * 30])
    whole = [s for _, e, b in shingles.shingle_sets(column, 4) for s in shingles.super_minhash(e, b, 64)]
    each = [s for i in range(4) for _, e, b in shingles.shingle_sets(column.slice(i, 1), 4) for s in shingles.super_minhash(e, b, 64)]
    assert (np.array(whole) == np.array(each)).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {x.node: x.component for x in components.connect(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components.connect(spark.createDataFrame([], "a long, b long")).count() == 0
