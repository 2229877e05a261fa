"""The registered queries beside their SQL, and the pipeline."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, connect
from faultline.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    good, note = compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name])
    assert good, note


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
        if k == 0:
            kept = {r.doc_id for r in docs.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.95 * len(good)
        if k == 1:
            assert docs.select("text").distinct().count() == docs.count()
    assert counts[1] < counts[0] and counts[2] <= counts[1]
    assert counts[-1] == counts[-2] == corpus_pipeline.run(spark, SF_DIR).count()


@pytest.mark.parametrize("k", range(5))
def test_stages_take_hard_and_empty_tables(spark, hard, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (hard, empty):
        out = stage(spark, docs, SF_DIR)
        assert out.count() >= 0
        if k < 4:
            assert out.columns == docs.columns
