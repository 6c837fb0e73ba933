import random
import re

import pytest

from strandloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, place int, value long, part string"
WORDS = "and of tree née straße river lantern moss école quill ember 木 drift ünder oak".split()


def brute(rows, least, top):
    docs = [(r[2] or "", r[3] or "", re.findall(divergence.PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t in {t for d in own for t in d[2]} if sum(t in d[2] for d in own) >= least)
        sources = sorted({d[1] for d in own})

        def shares(texts, kept=kept):
            count = {t: sum(x.count(t) for x in texts) for t in kept}
            return {t: (count[t], 1 + 10**9 * (count[t] + 1) // (sum(count.values()) + len(kept))) for t in kept}

        whole, of = shares([d[2] for d in own]), {s: shares([d[2] for d in own if d[1] == s]) for s in sources}
        f = lambda p, q: (p - q) ** 2 // q
        for a in sources:
            pairs = [(b, sum(f(of[a][t][1], of[b][t][1]) for t in kept)) for b in sources if b != a]
            more = [(t, f(of[a][t][1], whole[t][1])) for t in kept if of[a][t][0] and of[a][t][1] > whole[t][1]]
            for part, listed, limit in (("pair", pairs, None), ("term", more, top)):
                ranked = sorted(listed, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, a, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def rows_of(r, n):
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(1, 12))).title() + ".", r.choice(["en", "de", "xx"]), r.choice(["s1", "s2", "s3", "s4", None]), 1, "clash", 1, 2, "p") for i in range(n)]
    rows += [(700, None, "en", "lonely", 1, "", 1, 1, ""), (701, "", "zz", "a", 1, "", 1, 1, ""), (702, "one two", "zz", "b", 1, "", 1, 1, ""), (703, None, None, None, None, None, None, None, None), (None, "moss moss", None, "s1", 1, "", 1, 1, "")]
    return rows + [rows[0]] * 4


@pytest.mark.parametrize("held", [400_000, 3])
def test_equals_dense_sums(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = rows_of(random.Random(held), 80)
    out = divergence.audit(spark.createDataFrame(rows, SCHEMA), 3, 4)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(x) for x in out.collect()) == brute(rows, 3, 4)


def test_no_kept_terms_and_no_rows(spark):
    rows = [(1, "a b", "en", "x", 1, "", 1, 1, ""), (2, "c d", "en", "y", 1, "", 1, 1, "")]
    assert sorted(tuple(x) for x in divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows, 3, 200)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_of_very_large_counts(spark):
    from pyspark.sql import functions as F

    count, n = 40_000_000_000_000, 90_000_000_000_000
    got = spark.range(1).select(divergence.share(F.lit(count), F.lit(n), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (count + 1) // (n + 7)
