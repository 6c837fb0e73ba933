import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from strandloom.llm import secret_forms
from strandloom.llm import secret_scan as ss

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"


def brute(text):
    text, out = text or "", []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def table(n=300, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9)))
    code = lambda n, s: "".join(r.choice(s) for _ in range(n))
    texts = []
    for _ in range(n):
        words = [word() for _ in range(r.randint(5, 60))]
        for _ in range(r.randint(0, 2)):
            extra = r.choice((f"password={code(18, '0123456789abcdef')}", f'token = "{code(40, "0123456789abcdef")}"', "AKIA" + code(16, "ABCDEFGHJ23456789"), "x@mail5.example.com", "10.20.30.40", "(555)-1234-99", "AKIAABC", "PassWd : " + code(14, "abXY9+/")))
            words.insert(r.randint(0, len(words)), extra)
        texts.append(" ".join(words))
    return texts + [None, "", " ", "é token = \"" + "a1" * 30 + "\" ſecret=abcdefabcdefabcd", "f" * 200_000, "api_key:'" + "Z" * 12, "secret=" + "k" * 11]


def test_base_and_added_spans(spark):
    texts = table()
    docs = spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in enumerate(texts)] + [(7000, texts[0], "", "", 1, "")] * 2, SCHEMA)
    field = ss.train(docs)
    rows = ss.scan(docs, field).collect()
    assert len(rows) == len(texts) + 2
    for x in rows:
        text = texts[x.doc_id] if x.doc_id < 7000 else texts[0]
        base = brute(text)
        told = ",".join(f"{ss.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert x.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
        spans = [s.split(":") for s in x.spans.split(",") if s]
        assert {tuple(told.split(":")) for told in told.split(",") if told} <= {tuple(s) for s in spans}
        assert all(0 <= int(a) < int(b) <= len(text or "") for _, a, b in spans)
    # a secret of a shape that no pattern knows, and plain words around it
    probe = spark.createDataFrame([(1, "here the words stand Zk3_vQ9xT7mB2nL8wR5cY1 and AKIAZ9 end", None, None, None, None)], SCHEMA)
    assert ss.scan(probe, field).first().spans == "crf:21:43"
    assert ss.train(docs.limit(0)) is None and ss.scan(docs.limit(0), None).count() == 0


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(0)
    field = ss.Field()
    field.step = r.normal(size=(3, 3))
    bounds = np.array([0, 1, 4, 9, 11])
    scores = r.normal(size=(11, 3))
    got = field.viterbi(scores, bounds)
    for a, b in zip(bounds, bounds[1:]):
        def value(path):
            chain = [0, *path, 0]
            return sum(field.step[x, y] for x, y in zip(chain, chain[1:])) + sum(scores[a + i, y] for i, y in enumerate(path))
        assert list(got[a:b]) == list(max(itertools.product(range(3), repeat=b - a), key=value))


def test_training_separates():
    r = np.random.default_rng(1)
    n = 400
    labels = np.zeros(2 * n, np.int64)
    labels[::2] = r.integers(0, 2, n)
    labels[1::2] = np.where(labels[::2] == 1, r.integers(0, 2, n) * 2, 0)
    codes = np.zeros((2 * n, len(ss.SIZES)), np.int64)
    codes[:, 0] = labels * 5 + r.integers(0, 3, 2 * n)
    bounds = np.arange(0, 2 * n + 1, 2)
    field = ss.Field().fit(codes, labels, bounds)
    assert (field.viterbi(field.scores(codes), bounds) == labels).mean() > 0.99


def test_every_token_is_scored(spark):
    r = random.Random(5)
    letters = lambda n, s: "".join(r.choice(s) for _ in range(n))
    low, high = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = []
    for i in range(600):
        words = [letters(r.randint(2, 9), low) for _ in range(r.randint(10, 50))]
        for _ in range(2):
            value = letters(r.randint(14, 20), r.choice((low, high, low + "0123456789", low + high + "+/")))
            words.insert(r.randint(0, len(words)), f"{r.choice(('password', 'Secret', 'TOKEN', 'api_key'))}{r.choice((' : ', ' = ', ': '))}{value}")
        words.insert(r.randint(0, len(words)), r.choice(("note : and", "at 10.20.30.40 there", "x@mail5.example.com", "the key of it")))
        texts.append(" ".join(words))
    schema = "doc_id long, text string"
    field = ss.train(spark.createDataFrame(list(enumerate(texts)), schema))
    secrets = ("correcthorsebattery", "QWERTYUIOPASDFGH", "zq8$kd02#mv61@xp")
    probes = [f"here the words stand pwd : {secrets[0]} and go on", f"here the words stand KEY: {secrets[1]} and go on", f"here the words stand Pwd = {secrets[2]} and go on", "here only the plain words stand and go on"]
    rows = ss.scan(spark.createDataFrame(list(enumerate(probes)), schema), field).orderBy("doc_id").collect()
    for x, text, secret in zip(rows, probes, secrets, strict=False):
        assert x.n_assign == x.n_access == x.n_hex == 0
        assert x.spans == f"crf:{text.index(secret)}:{text.index(secret) + len(secret)}"
    assert rows[3].spans == ""


def test_split_chain_keeps_the_best_labels():
    r = np.random.default_rng(4)
    split = 0
    for seed in range(40):
        field = ss.Field()
        field.step = r.normal(size=(3, 3))
        field.step[0, 2] = -1e9
        row = np.sort(r.integers(0, 12, 200))
        scores = r.normal(size=(200, 3)) * 3 + [4, 0, 0]
        whole = field.viterbi(scores, np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1, [200])))
        who, runs = field.open_tokens(scores, row)
        labels = np.zeros(200, np.int64)
        labels[who] = field.viterbi(scores[who], runs)
        assert (labels == whole).all()
        split += 200 - len(who)
    assert split > 1000


def test_pieces_hold_every_token():
    data = ("plain words " * 40 + "password = abcdefghijklmnop end").encode()
    tokens = ss.Tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    pieces = list(ss._pieces(tokens, np.zeros(len(tokens.words), np.int64)))
    assert [i for a, b in pieces for i in range(a, b)] == list(range(len(tokens.words)))
    assert len(tokens.features()) == len(tokens.words)


def planted(kind, r):
    """A name before it, and a secret of an issuer's format that neither the patterns nor the drawn forms hold."""
    some = lambda n, letters="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choices(letters, k=n))
    return {
        "forge": ("", "ghp_" + some(36)), "payments": ("", "sk_live_" + some(24)), "chat": ("", f"xoxb-{some(11, '0123456789')}-{some(12, '0123456789')}-{some(24)}"),
        "web": ("Bearer ", f"eyJ{some(17)}.eyJ{some(60)}.{some(43)}"), "maps": ("", "AIza" + some(35)), "cloud": ("aws_secret_access_key = ", some(39) + "/"),
        "letters": ("pwd : ", some(16, "abcdefghijklmnopqrstuvwxyz")), "capitals": ("KEY: ", some(16, "QWERTYUIOPASDFGHJKL")), "signs": ("Pwd = ", some(13) + "$"),
    }[kind]


KINDS = ("forge", "payments", "chat", "web", "maps", "cloud", "letters", "capitals", "signs")


def prose(r):
    syllable = lambda: r.choice("bcdfghlmnprst") + r.choice("aeiou") + r.choice(("", "", "n", "r", "st"))
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    return " ".join(r.choice((word(), word(), word(), word().capitalize() + ".", word() + ",")) for _ in range(r.randint(40, 120)))


def test_unseen_kinds_are_found_and_clean_texts_left_alone(spark):
    r = random.Random(11)
    plain = lambda: prose(r)
    learn = [plain() for _ in range(300)] + [f"{plain()} token = \"{r.randbytes(20).hex()}\" {plain()}" for _ in range(40)]
    field = ss.train(spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string"))
    texts, truth = [plain() for _ in range(400)], {}
    for i in range(270):
        kind = KINDS[i % len(KINDS)]
        name, value = planted(kind, r)
        before = plain()
        truth[400 + i] = (kind, len(before) + 1 + len(name), value)
        texts.append(f"{before} {name}{value} {plain()}")
    got = {x.doc_id: [s.split(":") for s in x.spans.split(",") if s] for x in ss.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()}
    hits = dict.fromkeys(KINDS, 0)
    for i, (kind, at, value) in truth.items():
        hits[kind] += any(int(a) == at and int(b) == at + len(value) for _, a, b in got[i])
    assert sum(hits.values()) >= 0.9 * 270 and min(hits.values()) >= 0.6 * 30, hits
    assert sum(bool(got[i]) for i in range(400)) <= 8


#: Measured on 100 values each: recall 1.0, 1.0, 0.61, 0.41 and precision 1.0, 1.0, 1.0, 0.65; the floors lie below.
@pytest.mark.parametrize("family, recall, precision", [("prefixed", 0.9, 0.9), ("dotted", 0.9, 0.9), ("groups", 0.5, 0.9), ("syllables_digits", 0.3, 0.5)])
def test_families_that_are_held_out_of_training(spark, family, recall, precision):
    """Recall and precision on drawn values of a family that the field has not met, in texts that it has not seen. Pass words of
    syllables and digits look like plain words with a number; a field that never met them finds under half."""
    r = random.Random(family)
    learn = [prose(r) for _ in range(260)] + [f"{prose(r)} token = \"{r.randbytes(20).hex()}\" {prose(r)}" for _ in range(40)]
    field = ss.train(spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string"), without=frozenset({family}))
    families = dict(secret_forms.BARE) | dict(secret_forms.CUED)
    cue = "pwd: " if family in dict(secret_forms.CUED) else ""
    texts, truth = [], {}
    for i in range(200):
        before, value = prose(r), families[family](r)
        texts.append(f"{before} {cue}{value} {prose(r)}" if i % 2 else f"{before} {r.choice(secret_forms.PLAIN)(r)} {prose(r)}")
        if i % 2:
            truth[i] = (len(before) + 1 + len(cue), len(before) + 1 + len(cue) + len(value))
    got = {x.doc_id: [tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s.startswith("crf")] for x in ss.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()}
    hits = sum(truth[i] in got[i] for i in truth)
    spans = sum(map(len, got.values()))
    print(family, "recall", hits / len(truth), "precision", hits / max(spans, 1))
    assert hits >= recall * len(truth) and hits >= precision * spans


def test_the_sample_is_bounded_for_any_ids(spark):
    seen = spark.sparkContext.accumulator(0)
    whole = ss._lessons

    def counted(texts, draws, without=frozenset()):
        seen.add(len(texts))
        return whole(texts, draws, without)

    rows = [(None, f"row {i} password = abcdefghijkl{i}x") for i in range(900)] + [(7, f"other {i} of one id") for i in range(300)] + [(None, "one text")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ss._lessons = counted
    try:
        assert ss.train(docs, 50) is not None
    finally:
        ss._lessons = whole
    assert 0 < seen.value <= 50


def test_added_spans_of_long_and_non_ascii_texts(spark):
    r = random.Random(3)
    secrets = [planted("forge", r)[1] for _ in range(300)]
    text = "".join(f"é ñandú plain words here {s} token = \"{'0a' * 20}\" " for s in secrets) * 3
    docs = spark.createDataFrame([(100 + i, prose(r)) for i in range(300)] + [(99, text)], "doc_id long, text string")
    row = ss.scan(docs, ss.train(docs)).filter("doc_id = 99").first()
    spans = [s.split(":") for s in row.spans.split(",")]
    found = [text[int(a) : int(b)] for k, a, b in spans if k == "crf"]
    assert len(found) >= 0.9 * 900 and set(found) <= set(secrets) and [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
    assert row.n_assign == 900 and row.n_hex == 900


def test_apart_keeps_only_new_spans():
    base = [(5, 0, 30), (8, 2, 20), (40, 2, 60)]
    assert ss._apart(base, [(0, 5), (4, 6), (22, 25), (30, 40), (59, 61), (60, 70)]) == [(0, 3, 5), (30, 3, 40), (60, 3, 70)]
