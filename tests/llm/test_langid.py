import random
import zlib

import numpy as np

from strandloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORDS = {"en": "the of and tion ing that with this".split(), "de": "der die und schung einer zu für ist".split(), "fr": "le la que eaux des où être les".split(), "es": "el los ción para ñero una por más".split()}


def table(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 60))), lang, "s", 1, "clash"))
    return rows


def test_held_out_accuracy_and_contract(spark):
    rows = table()
    docs = spark.createDataFrame(rows + [(900, None, "en", "", 1, ""), (901, "123 !?", "en", "", 1, ""), (902, "", None, "", 1, ""), (903, "的", None, "", 1, "")], SCHEMA)
    out = {x.doc_id: x for x in langid.predict(docs, langid.train(docs)).collect()}
    assert len(out) == 404
    for i, x in out.items():
        assert x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x.score <= 1
    held = [(r, out[r[0]]) for r in rows if out[r[0]].held_out]
    assert len(held) > 50 and sum(x.lang_pred == r[2] for r, x in held) / len(held) > 0.97
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred in WORDS


def test_training_ignores_held_out_labels(spark):
    rows = table()
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else k, s, n, c) for i, t, k, s, n, c in rows]
    a, b = (langid.train(spark.createDataFrame(x, SCHEMA)) for x in (rows, wrong))
    assert a[0] == b[0] and np.allclose(a[2], b[2])


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    none = spark.createDataFrame([(1, "the text", None, None, None, None)] * 3, SCHEMA)
    assert {x.lang_pred for x in langid.predict(none, langid.train(none)).collect()} == {"und"}
    one = spark.createDataFrame([(i, "the text", "en", None, None, None) for i in range(9)], SCHEMA)
    assert {x.lang_pred for x in langid.predict(one, langid.train(one)).collect()} == {"en"}


def test_codes_are_apart():
    for k in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(k)
        assert len(np.unique(code, axis=0)) == k
