"""The registered queries: names, contracts' columns, one row a document, and SQL where there is some."""

import duckdb
import pytest

import corpus_pipeline
from tracequarry.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op2": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op3": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op4": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6": {"doc_id": "bigint", "section": "int", "n_tokens": "bigint"},
    "op7": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9": {"doc_id": "bigint", "licence": "string", "dice": "double"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    for c, kind in COLUMNS[name.split("_")[0]].items():
        assert kinds[c] == kind
    rows, docs = df.collect(), spark.read.parquet(f"{SF}/documents.parquet")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert sorted({r.doc_id for r in rows}) == sorted(set(ids))
    if not name.startswith("op6"):
        assert len(rows) == len(ids)
    if name in queries.SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        rel = con.sql(queries.SQL[name])
        assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_every_operator_and_stage_is_there():
    assert {name.split("_")[0] for name in queries.QUERIES} == set(COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_spans_sum_to_tokens(spark):
    spans = queries.QUERIES["op6_token_spans"](spark, SF).groupBy("doc_id").sum("n_tokens")
    whole = queries.QUERIES["op4_byte_bpe"](spark, SF).select("doc_id", "n_tokens")
    assert spans.exceptAll(whole).count() == 0
