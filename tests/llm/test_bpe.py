"""Prefix dynamic programming against the tokenizer library."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from salesmart.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text):
    return [token for run in bpe.encode_text(text, bpe.encoder(PATH)) for token in run]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinst ' é—\n\t日😀1٣", max_size=60)))
def test_ids_equal_the_library(library, text):
    assert encode(text) == library.encode_ordinary(text)


def test_texts_longer_than_a_run(library, monkeypatch):
    from salesmart.llm import pretokens

    text = "The river  changed its bed.\n\n" * 40
    monkeypatch.setattr(pretokens, "WHOLE_TEXT", 10)
    monkeypatch.setattr(pretokens, "RUN", 7)
    assert encode(text) == library.encode_ordinary(text)


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=12), st.data())
def test_appends_and_edits_equal_a_new_table(data, new, draw):
    vocabulary = bpe.encoder(PATH).vocabulary
    start = draw.draw(st.integers(0, len(data)))
    end = draw.draw(st.integers(start, len(data)))
    table = bpe.PrefixTable(vocabulary, data)
    table.replace(start, end, new)
    table.append(b" the end")
    whole = bpe.PrefixTable(vocabulary, data[:start] + new + data[end:] + b" the end")
    assert table.last == whole.last
    assert vocabulary.decode(table.encode()) == table.data


def test_an_edit_is_local():
    vocabulary = bpe.encoder(PATH).vocabulary
    table = bpe.PrefixTable(vocabulary, b"the river changed its bed again and again " * 50)
    assert table.replace(100, 103, b"new") <= 4 * vocabulary.longest


def test_round_trip(spark, library, odd_docs, no_docs):
    rows = bpe.round_trip(odd_docs, PATH, keep_ids=True).collect()
    texts = [row["text"] or "" for row in odd_docs.collect()]
    expected = [library.encode_ordinary(text) for text in texts]
    assert sorted(row["ids"] for row in rows) == sorted(expected)
    digests = {hashlib.sha256(text.encode()).hexdigest() for text in texts}
    assert {row["decoded_sha256"] for row in rows} == digests
    for row in rows:
        assert row["n_tokens"] == len(row["ids"])
        joined = ",".join(map(str, row["ids"]))
        assert row["ids_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert bpe.round_trip(no_docs, PATH).collect() == []


def test_many_pieces_at_once_equal_one_by_one(library):
    """Enough pieces for the arrays, of all lengths up to theirs and beyond, more than once."""
    import random

    draw = random.Random(1)
    cache = bpe.PieceCache(bpe.encoder(PATH).vocabulary)
    for _ in range(3):
        texts = ["".join(draw.choice(["a", "e", "n", "th", "ing", "é", "日", "😀", "-", "x1", " "])
                         for _ in range(draw.randrange(1, 30))) for _ in range(400)]
        found = dict(bpe.encoded_runs(list(enumerate(texts)), cache))
        for key, text in enumerate(texts):
            assert [token for run in found[key] for token in run] == library.encode_ordinary(text)


def test_full_caches_are_renewed(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 300)
    cache = bpe.PieceCache(bpe.encoder(PATH).vocabulary)
    for number in range(20):
        texts = [f"word{number}x{k} again{k} bed" for k in range(90)]
        for key, runs in bpe.encoded_runs(list(enumerate(texts)), cache):
            assert [token for run in runs for token in run] == library.encode_ordinary(texts[key])


def test_pairs_by_arrays_equal_pairs_by_objects():
    import numpy as np

    vocabulary = bpe.encoder(PATH).vocabulary
    arrays = bpe.encoder(PATH).arrays
    random = np.random.default_rng(5)
    made = np.flatnonzero(arrays.made)
    common = made[made < 2000]
    left, right = random.choice(common, 3000), random.choice(common, 3000)
    holds = arrays.follow(left, right)
    assert holds.tolist() == [vocabulary.follows(a, b) for a, b in zip(left.tolist(), right.tolist())]
    assert arrays.follow(left, right).tolist() == holds.tolist()
    assert 0 < holds.sum() < len(holds)
