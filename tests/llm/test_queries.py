import random

import pytest

from strandloom.llm import queries

#: First columns and their types, as the contracts name them.
COLUMNS = {
    "op1_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_hilbert_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_pii_surrogates": "doc_id bigint, text string",
    "op7_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op12_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
}

#: Queries whose rows are not documents.
OTHERS = {
    "op11_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op13_divergence_audit": "lang string, source string, part string, item string, value bigint, rank int",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(2)
    words = {"en": "the house and a tree of green", "de": "das Haus und ein Baum der Welt", "fr": "la maison et un arbre de ville"}
    rows = [(i, " ".join(r.choices(words[lang].split(), k=40)), lang, f"src{i % 3}", 1) for i, lang in enumerate(["en", "de", "fr"] * 12)]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, rows[0][1], "en", "src1", 1)]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, rows[0][1]), (2, "maison ville"), (3, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered_query_keeps_its_contract(spark, folder, name):
    out = queries.QUERIES[name](spark, folder)
    kinds = dict(out.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind, (c, kinds[c])
    rows = out.collect()
    assert sorted(x.doc_id for x in rows) == [*range(36), 100, 101, 102]


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_registered_query_of_other_rows_keeps_its_contract(spark, folder, name):
    out = queries.QUERIES[name](spark, folder)
    assert ", ".join(f"{c} {kind}" for c, kind in out.dtypes) == OTHERS[name]
    assert out.count() > 0


def test_every_registered_operator_is_named_here():
    assert set(queries.QUERIES) == set(COLUMNS) | set(OTHERS)
