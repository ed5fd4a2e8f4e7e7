import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import connect, rows_of, sql_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from textloom.llm import secrets  # noqa: E402
from textloom.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, data):
    columns, rows = rows_of(QUERIES[name](spark, data))
    assert rows == sql_rows(connect(data), ORACLES[name], columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(name, spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    found = QUERIES[name](spark, data)
    assert found.count() >= n
    assert found.select("doc_id").distinct().count() == n


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == corpus_pipeline.COLUMNS
        n = docs.count()
        assert 0.7 * before <= n <= before
        if name == "language_id":
            assert n >= 0.98 * before
        if name == "exact_dedup":
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts)
    assert not any(secrets.find(r.text or "") for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_empty(spark, empty):
    docs = empty.select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
