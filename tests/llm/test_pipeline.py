import hashlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from strandloom.llm import mixing, pii, quality_rules
from tests.llm.test_minhash import brute as groups
from tests.llm.test_quality_rules import brute as metrics

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark):
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghi") for _ in range(r.randint(2, 7)))
    rows = []
    for i in range(40):
        words = [w for _ in range(70) for w in (word(), "the")][: r.randint(40, 140)]
        if i % 5 == 0:
            words.insert(7, f"me{i}@mail.example.com")
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 1))
    rows += [(100 + i, rows[i][1] + " tail", "en", "s9", 1) for i in range(0, 40, 7)] + [(200, "### $$$ " * 60, "en", "s1", 1), (201, None, None, None, None), (202, "too short", "en", "s1", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_against_brute_force(spark, tmp_path):
    rows, docs = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    good = cp.filter_quality(spark, docs, "").collect()
    kept = {x.doc_id for x in good}
    assert {200, 201, 202}.isdisjoint(kept) and {i for i, t, *_ in rows if metrics(t)["base_failed"]}.isdisjoint(kept) and len(kept) > 30
    found = groups([(x.doc_id, x.text) for x in good], 5)
    alone = cp.drop_near_duplicates(spark, docs.filter(docs.doc_id.isin(list(kept))), "")
    assert alone.columns == COLUMNS
    left = {x.doc_id: x.text for x in alone.collect()}
    assert sorted(left) == sorted(i for i, (_, root) in found.items() if i == root) and len(left) < len(kept)
    safe = cp.replace_personal_data(spark, alone, "")
    new = {x.doc_id: x.text for x in safe.collect()}
    assert new.keys() == left.keys() and not any(re.search(r"me\d+@mail\.example\.com", t) for t in new.values())
    assert all((new[i] == t) == ("@" not in t) for i, t in left.items())
    plan = {x.doc_id: x.copies for x in mixing.plan(safe).collect()}
    mixed = Counter(x.doc_id for x in cp.mix_sources(spark, safe, "").collect())
    assert mixed == Counter({i: c for i, c in plan.items() if c})
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = cp.run(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in out) == mixed
    for x in out:
        ids = library.encode(new[x.doc_id], add_special_tokens=False).ids
        assert x.ids == ids and x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "minhash_near_dedup", "pii_surrogates", "mix_sources", "bpe_encode"]
    assert quality_rules.RULES and pii.TYPES


def test_empty_table_repeats_and_null_ids(spark, tmp_path):
    rows, docs = table(spark)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0
    good = [r for r in rows if r[0] < 100][:12]
    odd = good + [good[0]] * 3 + [(None, good[1][1] + " and more words", None, None, None)] + [(good[2][0], good[5][1].upper() + " unlike", "en", "s1", 1)]
    spark.createDataFrame(odd, docs.schema).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    kept = cp.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "odd" / "documents.parquet")), "")
    assert Counter(x.doc_id for x in kept.collect())[good[0][0]] == 1
    assert cp.run(spark, str(tmp_path / "odd")).count() > 0
