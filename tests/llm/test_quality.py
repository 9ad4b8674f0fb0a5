"""The factorisation machine: its arithmetic, held-out accuracy, and rows of all kinds."""

import zlib

import numpy as np
import pytest

from salesmart.llm import quality

SF = "/root/testdata/sf0.01"


def remainder(key):
    return zlib.crc32(b"" if key is None else str(key).encode()) % 4


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(spark, labels):
    return quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)


def test_pairs_equal_their_sum_of_squares():
    draw = np.random.default_rng(4)
    size = quality.BUCKETS + quality.STATISTICS
    model = quality.Model(0.3, draw.normal(size=size), draw.normal(size=(size, quality.FACTORS)))
    numbers, values = quality.features("one two two THREE, four | four")
    plain = model.bias + model.weights[numbers] @ values
    for i in range(len(numbers)):
        for j in range(i):
            plain += model.factors[numbers[i]] @ model.factors[numbers[j]] * values[i] * values[j]
    assert quality.raw_score(model, numbers, values)[0] == pytest.approx(plain, rel=1e-5)


def test_held_out_accuracy(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {row["doc_id"]: row for row in quality.score_documents(docs, labels).collect()}
    assert len(rows) == docs.count()
    for key, row in rows.items():
        assert row["held_out"] == (remainder(key) == 2)
        assert 0 <= row["score"] <= 1
        assert row["predicted"] == (row["score"] >= 0.7)
    held = [(row["quality"], rows[row["doc_id"]]) for row in labels.collect() if remainder(row["doc_id"]) == 2]
    assert np.mean([label == row["predicted"] for label, row in held]) > 0.95


def test_held_out_labels_change_nothing(spark, labels, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    turned = labels.selectExpr(
        "doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    other = quality.train(docs, turned)
    assert np.array_equal(model.weights, other.weights) and model.bias == other.bias


def test_only_the_text_is_scored(spark, model):
    rows = [(1, "The river changed.", "en"), (99, "The river changed.", "xx"), (None, "The river changed.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scores = {row[0] for row in docs.select(quality.quality(docs, model)).collect()}
    assert len(scores) == 1


def test_odd_rows(odd_docs, no_docs, labels):
    rows = quality.score_documents(odd_docs, labels.limit(0)).collect()
    assert [row["score"] for row in rows] == [0.5] * odd_docs.count()
    assert not any(row["held_out"] for row in rows if row["doc_id"] is None)
    assert quality.score_documents(no_docs, labels).collect() == []
    kept = quality.keep_good(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_labels_with_nulls_and_repeats(spark, sf_docs, labels):
    more = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema)).union(labels)
    assert quality.score_documents(sf_docs, more).count() == sf_docs.count()


def test_a_batch_scores_as_each_row(model):
    texts = ["", "The river changed.", "A A A\n1 | 2 | 3\n" * 50, "x", " "] * 3 + ["word " * 5000]
    rows = [quality.features(text) for text in texts]
    together = quality.raw_scores(model, rows)
    alone = [quality.raw_scores(model, [row])[0] for row in rows]
    assert together.tolist() == alone
    assert alone == pytest.approx([quality.raw_score(model, *row)[0] for row in rows], rel=1e-4, abs=1e-5)
    assert len(quality.raw_scores(model, [])) == 0


def test_sample_does_not_depend_on_the_layout(spark, labels, model):
    """Repeated doc_ids with other texts, in any order and partitioning, and a bound on features."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = docs.union(docs.selectExpr("doc_id", "concat(text, ' again') AS text")).union(docs)
    one = quality.train(more, labels, 100, 20_000)
    other = quality.train(more.repartition(7, "text"), labels, 100, 20_000)
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias
    assert not np.array_equal(one.weights, quality.train(more, labels, 100, 10_000).weights)
