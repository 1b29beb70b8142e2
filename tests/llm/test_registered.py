"""Every registered query runs over the small tables with the columns it has to give; SQL agrees where there is any."""

import math
import zlib

import duckdb
import pytest

from wayreach.llm.registry import ORACLES, QUERIES

COLUMNS = {
    "op1_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op7_quality": ["doc_id", "held_out", "score", "predicted"],
    "op8_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
}


def plain(table, columns):
    value = lambda v: None if v is None or v != v else round(float(v), 9) + 0.0 if isinstance(v, float) else v
    return sorted([tuple(value(v) for v in row) for row in table[columns].astype(object).itertuples(index=False)], key=repr)


def test_all_are_covered():
    assert set(COLUMNS) == set(QUERIES) and len(QUERIES) == 10


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert set(COLUMNS[name]) <= set(got.columns)
    key = COLUMNS[name][0]
    table = duckdb.sql(f"SELECT * FROM '{sf}/{'embeddings' if name.startswith('op6') else 'documents'}.parquet'").df()
    assert sorted(got[key]) == sorted(table[key])
    if "held_out" in got:
        mod, rest = {"op2_toxicity": (5, 0), "op7_quality": (3, 1)}[name]
        assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % mod == rest for i in got.doc_id]
        assert all(0 <= s <= 1 and not math.isnan(s) and p == (s >= 0.5) for s, p in zip(got.score, got.predicted))
    if name in ORACLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        expected = duckdb.sql(ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(expected.columns) and plain(got, columns) == plain(expected, columns)
