"""The registered queries: their names, and those with SQL against it."""

import re

import pytest
from compare import canonical, spark_rows, sql_rows

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from salesmart.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, len(QUERIES) + 1))
    assert QUERIES.keys() | {"pipeline"} <= queries().keys()
    assert ORACLES.keys() <= oracle_sql().keys()
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    got = canonical(*spark_rows(QUERIES[name](spark, SF_DIR)))
    want = canonical(*sql_rows(SF_DIR, ORACLES[name]))
    assert got == want
    assert got[1]


@pytest.mark.parametrize("name, apply", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, odd_docs, no_docs, name, apply):
    found = apply(spark, odd_docs, SF_DIR)
    assert found.count() <= odd_docs.count()
    assert apply(spark, no_docs, SF_DIR).collect() == []
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == odd_docs.columns


def test_pipeline_keeps_what_each_stage_decides(spark):
    """Every stage by its own brute force over what the one before kept."""
    from test_neardup import components
    from test_pii import strict_spans

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    current = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, apply in corpus_pipeline.STAGES:
        current = corpus_pipeline.stage(apply(spark, current, SF_DIR), "test")
        kept[name] = current.toPandas()
        if name != "byte-level BPE":
            assert current.columns == list(docs.columns)
    good, unique, clean, redacted, encoded = kept.values()
    judged = good.doc_id.isin(labels[labels.quality == 1].doc_id) | ~good.doc_id.isin(labels.doc_id)
    assert judged.mean() > 0.97
    roots = components(dict(zip(good.doc_id, good.text, strict=True)), 5, 80)
    assert set(unique.doc_id) == {key for key, root in roots.items() if key == root}
    assert set(clean.doc_id) <= set(unique.doc_id)
    assert list(redacted.doc_id.sort_values()) == list(clean.doc_id.sort_values())
    before = dict(zip(clean.doc_id, clean.text, strict=True))
    for row in redacted.itertuples():
        assert not any(strict_spans(row.text).values())
        assert row.n_chars == len(row.text)
        if not any(strict_spans(before[row.doc_id]).values()):
            assert row.text == before[row.doc_id]
    assert sorted(encoded.doc_id) == sorted(clean.doc_id)
    whole = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert sorted(whole.ids_sha256) == sorted(encoded.ids_sha256)
