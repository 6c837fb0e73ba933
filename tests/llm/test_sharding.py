import itertools
import zlib
from collections import Counter

import numpy as np

from strandloom.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"


def test_hilbert_walk_is_a_curve():
    for dims, bits in ((2, 3), (3, 3)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = sharding.hilbert_index(list(points.T), bits)
        assert sorted(index) == list(range(len(points)))
        walk = points[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_rows_law(spark):
    rows = [(i, None if i == 7 else f"text é {i % 9} " * (i % 13), [None, "en", "de"][i % 3], f"s{i % 5}", 1, "clash") for i in range(203)]
    rows += [(500, "same", "en", "s1", 1, "")] * 30
    out = sharding.assign(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert Counter(x.doc_id for x in out) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    for x in out:
        assert x["size"] == len(text[x.doc_id].encode()) + 16 and x.text_crc32 == zlib.crc32(text[x.doc_id].encode())
    counts = Counter(x.shard for x in out)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(x.slot for x in out if x.shard == s) == list(range(counts[s]))
    order = [x.curve for x in sorted(out, key=lambda x: (x.shard, x.slot))]
    assert order == sorted(order)


def test_small_and_empty(spark):
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0
    out = sharding.assign(spark.createDataFrame([(1, "a", None, None, None, None)] * 3, SCHEMA)).collect()
    assert [x.slot for x in out] == [0, 0, 0] and len({x.shard for x in out}) == 3


def test_written_shards(spark, tmp_path):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


def test_written_rows_are_whole(spark, tmp_path):
    rows = [(None, "a", "en", "s", 1), (None, "b", "de", "s", 1), (7, "same", "en", "s", 1), (7, "same", "en", "s", 1), (7, "other", None, "s", 2), (8, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in back) == Counter(rows)
    assert len({(x.shard, x.slot) for x in back}) == len(rows)
