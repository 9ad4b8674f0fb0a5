"""Removal of repeated passages against a plain search."""

import hashlib
import random

import pytest

from salesmart.llm import substrings


def plain(rows, size):
    """doc_id, n_words, n_removed and digest of each row, by listing every window."""
    def place(key, at):
        return (key is None, key or 0, at)

    texts = [(key, (text or "").encode().split()) for key, text in rows]
    first = {}
    for key, words in texts:
        for at in range(len(words) - size + 1):
            run = tuple(words[at:at + size])
            first[run] = min(first.get(run, place(key, at)), place(key, at))
    found = []
    for key, words in texts:
        covered = set()
        for at in range(len(words) - size + 1):
            if first[tuple(words[at:at + size])] < place(key, at):
                covered.update(range(at, at + size))
        kept = b" ".join(word for at, word in enumerate(words) if at not in covered)
        found.append((key, len(words), len(covered), hashlib.sha256(kept).hexdigest()))
    return found


def order(rows):
    return sorted(rows, key=lambda row: (row[0] is None, *row[:0], row[0] or 0, *row[1:]))


def check(spark, rows, size, **cuts):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(row) for row in substrings.remove_repeats(docs, size, **cuts).collect()]
    want = plain(rows, size)
    assert order(got) == order(want)
    return want


def made(count, seed):
    """Texts of few words that share passages, with repeats inside, nulls and repeated ids."""
    draw = random.Random(seed)
    shared = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(5)]
    rows = []
    for key in range(count):
        parts = []
        for _ in range(draw.randrange(6)):
            parts.append(draw.choice(shared) if draw.random() < 0.5 else
                         " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(40))))
        rows.append((draw.choice([key, key, key, None, count + 1, 0]), " ".join(parts)))
    return rows + [rows[0], rows[0], (7, None), (8, "")]


@pytest.mark.parametrize("size", [1, 3, 20])
def test_equals_plain_search(spark, size):
    want = check(spark, made(120, size), size)
    assert sum(row[2] for row in want) > 100


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    """Pieces share the words at their seams, so cuts change nothing."""
    monkeypatch.setattr(substrings, "LONG_TEXT", 200)
    texts = [text for _, text in made(60, 5)]
    words = " ".join(texts[3:9]).encode().split()
    for seam in (3, 19):
        pieces = list(substrings.pieces_of(" ".join(texts[3:9]), seam, 25))
        assert [word for _, own, _ in pieces for word in own] == words
        assert max(len(own) for _, own, _ in pieces) == 25
    for size, block, piece in ((4, 60, 25), (20, 100, 20), (7, 1, 1)):
        check(spark, made(60, size), size, block_words=block, piece_words=piece)


def test_sketch_never_estimates_too_low(spark, monkeypatch):
    """A sketch of hardly any cells lets everything through, and the result is the same."""
    monkeypatch.setattr(substrings, "CELLS", 0)
    check(spark, made(50, 9), 5)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(row.doc_id, row.text) for row in odd_docs.select("doc_id", "text").collect()]
    got = [tuple(row) for row in substrings.remove_repeats(odd_docs, 20).collect()]
    assert order(got) == order(plain(rows, 20))
    assert substrings.remove_repeats(no_docs).collect() == []


def test_first_copy_stays(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "x " + passage + " y"), (3, passage), (4, "Z " + passage.replace("w30", "W30"))]
    found = {row[0]: row[2] for row in check(spark, rows, 20)}
    assert found == {3: 0, 4: 59, 5: 60}
