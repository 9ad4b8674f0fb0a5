"""Token files against the tokenizer library."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from salesmart.llm import tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [item.ids + [0] for item in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs):
    """Rows sorted by start follow each other and hold the ids of the sorted documents."""
    rows = sorted(rows, key=lambda row: row["start"])
    ids = {}
    for (key, text), tokens in zip(docs, expected([text or "" for _, text in docs]), strict=True):
        ids.setdefault(key, []).append(zlib.crc32(np.array(tokens, "<u4").tobytes()))
    start = 0
    for row in rows:
        assert row["start"] == start
        start += row["n_tokens"]
        ids[row["doc_id"]].remove(row["ids_crc32"])
    assert not any(ids.values())
    keys = [row["doc_id"] for row in rows]
    assert keys == sorted(keys, key=lambda key: (key is not None, key))


def test_round_trip(sf_docs, odd_docs, no_docs):
    for docs in (sf_docs, odd_docs):
        rows = tokenfiles.round_trip(docs, PATH, 0).collect()
        check(rows, [tuple(row) for row in docs.select("doc_id", "text").collect()])
    assert tokenfiles.round_trip(no_docs, PATH, 0).collect() == []


def test_special_tokens_are_text():
    ids = tokenfiles.piece_ids(PATH).encode("a<|endoftext|>b").tolist()
    assert ids == expected(["a<|endoftext|>b"])[0][:-1]
    assert 50256 not in ids


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHE_ENTRIES", 8)
    cache = tokenfiles.PieceIds(PATH)
    for text in ["the river changed its bed", "the people moved up the hill", "the river"] * 3:
        assert cache.encode(text).tolist() == expected([text])[0][:-1]


def test_added_tokens_as_in_the_library(spark):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y  ", "<|endoftext|", "plain",
             " lead<|endoftext|>\n\nthe river  <|endoftext|> é😀"]
    plain = Tokenizer.from_file(PATH)
    want = [plain.encode(text, add_special_tokens=False).ids for text in texts]
    assert 50256 in want[0]
    cache = tokenfiles.piece_ids(PATH)
    assert [cache.encode_whole(text).tolist() for text in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(tokenfiles.round_trip(docs, PATH, 0).collect(), key=lambda row: row["doc_id"])
    assert [row["n_tokens"] for row in rows] == [len(ids) + 1 for ids in want]
    assert [row["ids_crc32"] for row in rows] == [
        zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for ids in want]
    assert [row["start"] for row in rows] == [sum(len(ids) + 1 for ids in want[:i]) for i in range(len(want))]
