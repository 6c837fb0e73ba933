import hashlib
import random

import pytest

from strandloom.llm import substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, anchor long, starts string"


def brute(rows, window):
    place = lambda r: 2**63 - 1 if r[0] is None else r[0]
    words = [(r[1] or "").replace("\n", " ").replace("\t", " ").split(" ") for r in rows]
    words = [[w for w in ws if w] for ws in words]
    least = {}
    for r, ws in zip(rows, words, strict=True):
        for i in range(len(ws) - window + 1):
            g = tuple(ws[i : i + window])
            least[g] = min(least.get(g, place(r)), place(r))
    out = []
    for r, ws in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(ws) - window + 1) if least[tuple(ws[i : i + window])] < place(r) for k in range(window)}
        out.append((r[0], len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


def rows_of(r, n, few):
    vocabulary = [f"w{i}" for i in range(few)]
    shared = [r.choices(vocabulary, k=r.randint(12, 200)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [w for _ in range(r.randint(1, 4)) for w in (r.choice(shared) if r.random() < 0.5 else r.choices(vocabulary, k=r.randint(1, 40)))]
        rows.append((i * 7 % n, r.choice([" ", "\n", "\t "]).join(parts), "en", "s", 1, 5, 6, "clash"))
    near = rows[2][1].split()
    rows += [(500 + i, " ".join(w if k % 37 != i % 37 else "new" for k, w in enumerate(near)), "en", "s", 1, 1, 1, "") for i in range(5)]
    rows += [(600 + i, rows[1][1], "en", "s", 1, 1, 1, "") for i in range(4)] + [rows[0]] * 2
    rows += [(None, rows[3][1] + " tail", "en", "s", 1, 1, 1, ""), (None, rows[3][1] + " tail", None, None, None, None, None, None)]
    rows += [(700, None, "en", "s", 1, 1, 1, ""), (701, "", "en", "s", 1, 1, 1, ""), (702, "a " * 400, "en", "s", 1, 1, 1, ""), (703, "a " * 300, "en", "s", 1, 1, 1, ""), (704, "a " * 9, "en", "s", 1, 1, 1, "")]
    return rows


@pytest.mark.parametrize("window,few", [(10, 3000), (10, 3), (5, 40), (50, 3000)])
def test_equals_windows_as_words(spark, window, few):
    rows = rows_of(random.Random(few + window), 30, few)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = substring_dedup.clean(docs, window).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in out), key=str) == brute(rows, window)
    for x in out:
        assert x.n_spans == len(x.spans) and sum(b - a for a, b in x.spans) == x.n_removed
        assert all(b < a for (_, b), (a, _) in zip(x.spans, x.spans[1:], strict=False))


def test_query_and_empty_table(spark, tmp_path):
    assert substring_dedup.clean(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = rows_of(random.Random(5), 12, 4000)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = substring_dedup.op12_substring_dedup(spark, str(tmp_path)).collect()
    want = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute(rows, 50)]
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in out), key=str) == sorted(want, key=str)
