import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_near_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op2_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_token_counts": "doc_id bigint, n_tokens bigint",
    "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_quality": "doc_id bigint, score double, kept boolean",
    "op7_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_kd_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op12_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "pipeline": "doc_id bigint, n_tokens bigint",
}
TABLE = {"op1_near_embeddings": "embeddings", "op5_url_filter": "pages"}

#: Results with rows of their own, not one for each row of a table.
MADE = {"op12_prefix_trie", "op13_spelling"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", COLUMNS)
def test_whole_table_and_columns(spark, name):
    got = entry.queries()[name](spark, SF)
    kinds = dict(got.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split(" ")
        assert kinds[c] == kind
    if name in MADE:
        assert got.count() > 0
        return
    rows = spark.read.parquet(f"{SF}/{TABLE.get(name, 'documents')}.parquet").count()
    n = got.count()
    assert 0 < n < rows if name == "pipeline" else n == rows


def test_every_query_is_registered():
    assert set(COLUMNS) <= set(entry.queries()) and {"op1_near_embeddings", "op3_decontamination"} <= set(entry.oracle_sql())
