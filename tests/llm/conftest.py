import pytest

SF_DIR = "/root/testdata/sf0.001"

ODD_TEXTS = [
    (None, "a text without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"),
    (5, "É Ünï — 日本 😀 \x1c 1½"), (6, "word " * 30_000), (7, "x" * 100_000),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(key, text, "en", None, index, 0.5, "b", 1)
            for index, (key, text) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
        "score double, block string, class int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
