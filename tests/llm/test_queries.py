"""The registered queries of the text operators."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from sitefold.llm import queries
from sitefold.plans.fixtures import TABLES

SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = [*queries.registered(), "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.registered()) == list(range(1, 14))
    assert set(names) <= set(entry.queries()) and set(queries.statements()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.statements()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    assert check.compare(spark, con, name, SMALL) is None


COLUMNS = {
    "op2_bpe_merge_replay": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op10_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13_embedding_links": ["vec_id", "n_links", "component_id", "kept"],
}
KEYS = {"op11_vector_codes": "vec_id", "op13_embedding_links": "vec_id"}


@pytest.mark.parametrize("name", list(queries.registered()))
def test_columns_and_one_row_per_input_row(spark, name):
    found = queries.registered()[name](spark, SMALL)
    assert found.columns[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    if name == "op12_collocations":  # a report, compared with SQL above
        return
    key = KEYS.get(name, "doc_id")
    table = "embeddings" if key == "vec_id" else "documents"
    ids = [r[key] for r in found.select(key).collect()]
    want = [r[key] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()]
    assert sorted(ids) == sorted(want)


@pytest.mark.parametrize("name", ["op3_secret_scan", "op4_exact_dedup", "op9_license_scan"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.registered()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Python", "Pandas", "Arrow", "CartesianProduct"))
