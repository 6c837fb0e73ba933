import re
from collections import Counter

import pytest
from pyspark.sql import types as T

from strandloom.llm import quality_rules as q

TEXTS = [
    None, "", "   \n\t ", "one", "a b c a b c", "x x x x x x", "the cat sat\nthe cat sat\n\nthe dog",
    "café ñandú 😀 the #tag $5 <b>", "w" * 5000, " ".join(f"word{i % 40} the" for i in range(3000)),
    "the " * 60, "\n".join(["of the line"] * 30), "no   break   spaces", "the quick " * 1,
]


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [s for s in text.split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in q.SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "base_failed": len(words) < 50 or 100 * len(hit) > 50 * len(words),
    }


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def test_metrics_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in enumerate(TEXTS)], SCHEMA)
    rows = q.judge(q.measure(docs)).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        want = brute(row["text"])
        for name in q.OUTPUT:
            assert row["__q_metrics"][name] == want[name], (row["text"], name)
        assert row["__q_base_failed"] == want["base_failed"]
        assert not (row["__q_base_failed"] and row["__q_kept"])
        assert row["n_words"] == "clash"


def test_empty_table_and_repeated_rows(spark):
    assert q.keep_good(spark.createDataFrame([], SCHEMA)).columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert q.keep_good(spark.createDataFrame([], SCHEMA)).count() == 0
    good = "The clean text of a person is in the house and it was good. " + " ".join(f"the w{i}" for i in range(80))
    assert q.keep_good(spark.createDataFrame([(1, good, "en", "s", 1, "")] * 2, SCHEMA)).count() == 2


@pytest.mark.parametrize("rule", q.RULES, ids=lambda r: r.name)
def test_each_rule_has_both_sides(spark, rule):
    base = dict(n_words=100, word_chars=500, n_symbols=0, n_lines=10, n_dup_lines=0, n_alpha_words=100, n_stop_words=20, n_listed_words=100, n_ellipsis_lines=0)
    bad = dict(base)
    unit = base[rule.per] if rule.per else 1
    bad[rule.metric] = (rule.low * unit // rule.scale) - 1 if rule.high is None else (rule.high * unit // rule.scale) + 1
    schema = T.StructType([T.StructField(k, T.LongType()) for k in base])
    got = spark.createDataFrame([tuple(base.values()), tuple(bad.values())], schema).select(q.compile_rules((rule,)).alias("ok"))
    assert [r.ok for r in got.collect()] == [True, False]


def test_languages_without_a_list_get_no_verdict_from_it(spark):
    text = " ".join(f"sana{i} talo{i}." for i in range(60))
    rows = [(i, text, lang, None, None, None) for i, lang in enumerate(("fi", "ru", None, "", "EN", "de"))]
    kept = {x.lang for x in q.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {"fi", "ru", None, ""}
    assert q.keep_good(spark.createDataFrame(rows, SCHEMA).drop("lang")).count() == 6


def test_the_filter_stays_above_the_metrics(spark):
    """Pushed below the projections, it would write every metric out again for each of its uses."""
    docs = spark.createDataFrame([(1, "a b c", "en", None, None, None)], SCHEMA)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(q.keep_good(docs)).count("xxhash64(") == plan(q.judge(q.measure(docs))).count("xxhash64(") == 1
