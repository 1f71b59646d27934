"""The operators' queries against their SQL, and the columns that their contracts name."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import differences  # noqa: E402

from recengine.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op5_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_token_files": "doc_id start n_tokens ids_crc32",
    "op7_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert not differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each_document(spark, name):
    out = queries.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
