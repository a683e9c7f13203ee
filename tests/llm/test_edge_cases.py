"""Every operator and stage on nulls, empty and long texts, repeats, clashing columns, empty tables."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from llm.conftest import EDGE_IDS
from sitefold.llm import (
    bpe, decontaminate, exact_dedup, licenses, ngram_join, quality, secrets, substring_dedup, token_counts, token_output,
)


def benchmark(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "null id item of some eight or nine words"),
            (3, None), (4, "short item"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def labels(spark):
    rows = [(1, 0, 0), (2, 1, 0), (2, 0, 1), (7, 1, None), (None, 1, 1), (8, None, 0), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "ngram_join": lambda s, d: ngram_join.ngram_join(d),
    "bpe": lambda s, d: bpe.round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "secrets": lambda s, d: secrets.scan(d),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d, exact_dedup.new_index(s)),
    "token_output": lambda s, d: token_output.write_and_read(d, P.path("word_bpe_49k.json")),
    "token_counts": lambda s, d: token_counts.token_counts(d, token_counts.pieces_of(P.path("piece_bpe_32k.model"))),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, benchmark(s)),
    "substring_dedup": lambda s, d: substring_dedup.substring_dedup(d),
    "licenses": lambda s, d: licenses.scan(d),
    "quality": lambda s, d: quality.quality(d, labels(s)),
}


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: -1 if i is None else i)


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, edge_docs, name):
    assert ids(OPERATORS[name](spark, edge_docs)) == EDGE_IDS


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, make_docs, name):
    assert OPERATORS[name](spark, make_docs([])).collect() == []


def test_empty_benchmark_and_labels(spark, edge_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(edge_docs, none).filter("contaminated").count() == 0
    found = quality.quality(edge_docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert {r["score"] for r in found} == {0.5} and {r["predicted"] for r in found} == {1}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, make_docs, edge_docs, tmp_path, empty):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make_docs([]) if empty else edge_docs
    want = {
        "exact_dedup": [3, 4, 5, 6, 8, 9, 10, 11, 12, 13],
        "ngram_jaccard_join": [None, None, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13],
        "benchmark_decontamination": EDGE_IDS,
        "byte_level_bpe": EDGE_IDS,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_level_bpe":
            assert out.schema == docs.schema
        found = ids(out)
        if empty:
            assert found == []
        elif name in want:
            key = lambda i: -1 if i is None else i
            assert found == sorted(want[name], key=key), name
