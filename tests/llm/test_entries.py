"""Queries of the subpackage against their SQL, and the contract's columns."""

import duckdb
import pytest

from harrow.llm import entries

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_near_duplicates": "doc_id class_id kept", "op2_shards": "doc_id size text_crc32 law shard slot grown_shard", "op3_quality": "doc_id held_out score predicted",
    "op4_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars valid first_refused", "op5_url_filter": "page_id host path rule verdict",
    "op6_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op7_token_files": "doc_id start n_tokens ids_crc32",
    "op8_near_duplicate_vectors": "vec_id n_links component_id kept", "op9_token_counts": "doc_id n_bytes n_tokens over_limit", "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


def test_registered():
    assert sorted(entries.QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = entries.QUERIES[name](spark, D)
    assert df.columns == COLUMNS[name].split()
    rows = df.collect()
    table = {"op4": None, "op5": "pages", "op8": "embeddings"}.get(name.split("_")[0], "documents")
    if table:
        assert len(rows) == spark.read.parquet(f"{D}/{table}.parquet").count()
    if name in entries.SQL:
        c = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        want = c.sql(entries.SQL[name])
        at = [want.columns.index(x) for x in df.columns]
        assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
