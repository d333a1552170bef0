"""The registered queries on a small table: their columns, types, and what each contract fixes."""

import hashlib
import zlib

import pytest

from tests.llm import cases
from tidewright.llm import queries

TYPES = {
    1: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    2: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    3: {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    4: {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    5: {"doc_id": "bigint", "domain": "string", "language": "string", "source": "string", "tokens": "bigint", "epoch": "int", "position": "bigint"},
    6: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    7: {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    8: {"doc_id": "bigint", "item_id": "bigint"},
    9: {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    10: {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    11: {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    12: {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    13: {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = cases.edge_documents(spark, n=12).dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(1, 30)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, cases.texts(1, 12)[9])], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame([(1, "http://a", "<p>"), (2, None, None), (3, "http://b", "<p>")], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    vectors = [(i, [float(i % 5), float(i % 3), 0.25 * i], 0) for i in range(20)] + [(20, None, 1), (21, [1.0, float("nan"), 0.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("n", sorted(TYPES))
def test_contract(spark, tables, n):
    name, query = next((k, f) for k, f in queries.queries().items() if k.startswith(f"op{n}_"))
    df = query(spark, tables)
    types = dict(df.dtypes)
    assert {k: types.get(k) for k in TYPES[n]} == TYPES[n]
    rows = df.collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    if n in (1, 2, 3, 4, 6, 9, 10, 11, 13):
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, docs))
    if n in (1, 2):
        parts, rest = (3, 1) if n == 1 else (4, 2)
        for r in rows:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == rest)
            assert 0 <= r.score <= 1
            if n == 1:
                assert r.predicted == int(r.score >= 0.7)
    if n == 3:
        assert all(r.size == len((docs[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) for r in rows)
        assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and all(0 <= r.shard < 40 for r in rows)
    if n == 6:
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    if n == 7:
        assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows) == [(1, "response", None), (2, "response", None), (3, "revisit", 1)]
    if n == 8:
        assert len(rows) >= 1
    if n in (11, 13):
        whole = {r.doc_id: hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest() for r in rows}
        assert all((r.decoded_sha256 if n == 11 else r.restored_sha256) == whole[r.doc_id] for r in rows)
    if n == 12:
        assert sorted((r.vec_id, r.component) for r in rows) == [(i, k) for i in range(20) for k in (1, 2, 3)]
        assert {r.n for r in rows} == {20} and all(r.identity_error < 1e-9 for r in rows)
    if n == 10:
        rows.sort(key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted(docs, key=lambda i: (i is not None, i))
