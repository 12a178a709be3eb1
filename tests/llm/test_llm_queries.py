"""Every query of the subpackage runs on the smallest data; those with SQL give the same rows as DuckDB."""

import base64
from pathlib import Path

import pytest

from folioscope.llm import queries
from test_queries import plain


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got
    if name in queries.SQL:
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for f in Path(tiny).glob("*.parquet"):
            c.sql(f"create view {f.stem} as select * from '{f}'")
        r = c.sql(queries.SQL[name])
        assert sorted(r.columns) == columns
        assert got == sorted(repr([plain(v) for v in row]) for row in r.select(", ".join(f'"{x}"' for x in columns)).fetchall())


def test_columns(spark, tiny):
    kinds = {
        "p1_found": ["code_id_a bigint", "code_id_b bigint"], "p2_found": ["code_id bigint"], "p3_found": ["item_table string", "item_key string", "chunk_no int"],
        "p4_found": ["key_a string", "key_b string"], "p6_found": ["keep_id bigint", "status_id bigint"], "p7_ids": ["doc_id bigint", "ids array<int>"], "p9_found": ["doc_id bigint"],
    }
    for name, want in kinds.items():
        assert [f"{c} {t}" for c, t in queries.QUERIES[name](spark, tiny).dtypes] == want


def test_ids_round_trip(spark, tiny):
    pytest.importorskip("public_tokenizers")
    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        bytes_of = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.p7_ids(spark, tiny).collect():
        assert b"".join(bytes_of[i] for i in r.ids).decode() == texts[r.doc_id]
