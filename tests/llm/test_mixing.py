import random
import re
from collections import Counter, defaultdict

from strandloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "clash") for i, t, s in rows], SCHEMA)


def water(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    capped, rest = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        share = {s: (rest - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_targets_and_mass(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60))), r.choice(["a"] * 6 + ["b", "é", None, "tiny"] if i % 40 else ["tiny"])) for i in range(900)]
    rows = [x for x in rows if x[2] != "tiny" or x[0] % 40 == 0] + [(5000, None, "b"), (5001, "", "nulls"), (5002, "  \t", "b"), (5003, "x " * 30000, "b")]
    out = mixing.plan(make(spark, rows), fan_in=6).collect()
    assert sorted(x.doc_id for x in out) == sorted(x[0] for x in rows)
    sizes, taken, largest, text = Counter(), Counter(), Counter(), {i: (t or "", s) for i, t, s in rows}
    for x in out:
        assert x["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[x.doc_id][0]))
        assert x.taken <= 3 * x["size"] and x.taken == x.copies * x["size"] and x.source == text[x.doc_id][1]
        sizes[x.source] += x["size"]
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x["size"])
    want = water(sizes)
    for x in out:
        assert x.source_size == sizes[x.source]
        assert abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = mixing.plan(make(spark, rows[::-1]).repartition(3), fan_in=6).collect()
    assert sorted((x.doc_id, x.taken) for x in again) == sorted((x.doc_id, x.taken) for x in out)


def test_probability_is_kept(spark):
    rows = [(i, "w " * (1 + i % 4), "a" if i < 30 else "b") for i in range(60) for _ in range(1)]
    hits, n = defaultdict(float), 5
    for seed in range(n):
        for x in mixing.plan(make(spark, rows), seed=seed, fan_in=5).collect():
            hits[x.source] += x.copies / n / 30
            ratio = x.target / x.source_size
    want = water(Counter({"a": sum(1 + i % 4 for i in range(30)), "b": sum(1 + i % 4 for i in range(30, 60))}))
    for s in "ab":
        size = sum(1 + i % 4 for i in (range(30) if s == "a" else range(30, 60)))
        assert abs(hits[s] - want[s] / size) < 0.2, (s, hits[s], ratio)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c", "s")] * 7 + [(None, "x y", None)] * 3
    assert mixing.plan(make(spark, rows)).count() == 10
    mixed = mixing.apply(make(spark, rows))
    assert mixed.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    plan = mixing.plan(make(spark, rows)).groupBy("doc_id").sum("copies").collect()
    got = Counter(x.doc_id for x in mixed.collect())
    assert {k: v for k, v in ((x[0], x[1]) for x in plan) if v} == dict(got)
    assert mixing.plan(make(spark, [])).count() == 0
    assert mixing.apply(make(spark, [])).count() == 0
    assert mixing.plan(make(spark, [(1, None, "a"), (2, "", None)])).agg({"taken": "sum"}).first()[0] == 0
