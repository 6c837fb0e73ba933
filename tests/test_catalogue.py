import math
import os
import random
import statistics

import duckdb
import pandas as pd
import pytest

from strandloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)) or not hasattr(v, "__float__"):
        return str(v)
    return round(float(v), 6)


def table(pdf):
    return sorted((tuple(plain(v) for v in row) for row in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


def test_queries_without_sql_run(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_every_line_is_a_frame(spark):
    lines = catalogue.table(spark, DATA, "lineitem").select("l_orderkey", "l_linenumber").collect()
    frames = [(x.l_orderkey, x.l_linenumber, x.l_orderkey % 5000) for x in lines]
    want = []
    for b in range(26):
        touch = [(b, k, n, off <= b * 200 and off + 450 >= b * 200 + 200) for k, n, off in frames if off < b * 200 + 200 and off + 450 > b * 200]
        few = sum(x[3] for x in touch) < 3
        want += [(*x, few) for x in touch if few or x[3]]
    got = [tuple(x) for x in catalogue.QUERIES["band_cover_lines"](spark, DATA).collect()]
    assert sorted(got) == sorted(want)
    assert {x[1:3] for x in got} == {x[:2] for x in frames}


def test_every_line_counts_and_every_customer_is_kept(spark, duck):
    score = catalogue.QUERIES["report_score_orders"](spark, DATA).toPandas()
    assert len(score) == duck.sql("SELECT count(DISTINCT (l_suppkey, l_orderkey)) FROM lineitem").fetchall()[0][0]
    assert score.score.nunique() > 2
    kept = catalogue.QUERIES["history_upsert_all"](spark, DATA).toPandas()
    assert sorted(kept.c_custkey) == [k for k, in duck.sql("SELECT c_custkey FROM customer ORDER BY 1").fetchall()]
    assert kept.late.any() and not kept.late.all()


def test_medians_of_few_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandloom.operators import seq

    r = random.Random(3)
    sets = {"one": [5.0], "two": [1.0, 4.0], "ties": [7.0] * 501 + [8.0] * 499, "even": [float(i) for i in range(1000)], "odd": [r.gauss(0, 1e6) for _ in range(9999)], "far": [r.random() ** 40 * 1e12 for _ in range(8000)], "none": [None, None], "some": [None, 3.0, None, 9.0, 4.0]}
    rows = [(k, v) for k, vs in sets.items() for v in vs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    want = {k: statistics.median([v for v in vs if v is not None]) if any(v is not None for v in vs) else None for k, vs in sets.items()}
    for accuracy in (5000, 100):
        monkeypatch.setattr(seq, "ACCURACY", accuracy)
        assert {x.k: x["median"] for x in seq.exact_median(df, ["k"], "v").collect()} == want
    z = {(x.k, x.v): x.z for x in seq.mad_z(df, ["k"], "v").collect()}
    odd = [abs(v - want["odd"]) for v in sets["odd"]]
    assert abs(z["odd", sets["odd"][7]] - odd[7] / (1.4826 * (statistics.median(odd) + 1e-6))) < 1e-9 and len(z) == len(set(rows))
    plan = seq.mad_z(df, ["k"], "v")._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1]  # rows of a key are never brought together
    assert seq.mad_z(df.filter(F.lit(False)), ["k"], "v").count() == 0


@pytest.mark.parametrize("most", [50_000, 1, 64])
def test_packing_over_blocks(spark, monkeypatch, most):
    from strandloom.operators import seq

    monkeypatch.setattr(seq, "PACKED", most)
    r = random.Random(most)
    for capacity, gap, tall in ((100, 3, 130), (17, 0, 6), (40, 7, 40)):
        rows = [(k, i, r.randint(1, tall)) for k, n in (("a", 400), ("b", 1), ("c", 63), ("d", 200)) for i in range(n)]
        want = {}
        for k in "abcd":
            sheet = used = 0
            for _, i, h in (x for x in rows if x[0] == k):
                fits = used == 0 or used + gap + h <= capacity
                sheet, y = (sheet, used + gap if used else 0) if fits else (sheet + 1, 0)
                used = y + h
                want[k, i] = (h, sheet, y)
        mixed = r.sample(rows, len(rows))
        out = seq.pack(spark.createDataFrame(mixed, "k string, i int, h long").repartition(5), ["k"], ["i"], "h", capacity, gap)
        assert {(x.k, x.i): (x.h, x.sheet, x.y) for x in out.collect()} == want
    assert seq.pack(spark.createDataFrame([], "k string, i int, h int"), ["k"], ["i"], "h", 10, 1).count() == 0
