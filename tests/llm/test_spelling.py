"""Spelling variants against a search of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from salesmart.llm import spelling


def plain_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            number = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if number % 31 == 0:
                at = number % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    words = plain_counts(rows)
    found = {}
    for word, n in words.items():
        near = [other for other in words if distance_is_one(word, other)]
        best = min(near, key=lambda other: (-words[other], other), default=None)
        form = best if best and words[best] >= 10 * n else None
        found[word] = (form, n, len(near), words[form] if form else None)
    rows = []
    for word, (form, n, n_near, form_n) in found.items():
        root = word
        while found[root][0]:
            root = found[root][0]
        rows.append((word, form, root, n, n_near, form_n))
    return sorted(rows)


def made(seed, texts=80):
    """Texts of few letters, so that many words are near, with accents and capitals."""
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcÀé") for _ in range(draw.randrange(7, 11))) for _ in range(60)]

    def vary(word):
        at = draw.randrange(len(word))
        kind = draw.randrange(8)
        letter = draw.choice("abcÀéXÿ")
        return {0: word[:at] + word[at + 1:], 1: word[:at] + letter + word[at:],
                2: word[:at] + letter + word[at + 1:]}.get(kind, word)

    rows = []
    for key in range(texts):
        words = [vary(vary(base[min(int(draw.expovariate(0.15)), 59)])) for _ in range(90)]
        rows.append((draw.choice([key, None, 3]), draw.choice([" ", ", ", "1"]).join(words)))
    return rows + [(1, None), (2, ""), (3, "abcabca abcabca"), rows[0]]


def test_equals_all_pairs(spark):
    rows = made(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(row) for row in spelling.variants(docs).collect())
    assert got == plain(rows)
    assert sum(row[1] is not None for row in got) > 50
    assert any(row[1] and row[2] != row[1] for row in got)


def test_chunks_and_cuts_change_nothing(spark, monkeypatch):
    """Blocks of many chunks, more groups, and Gram matrices cut by every letter."""
    rows = made(2, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "CHUNK_WORDS", 4)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 1)
    got = sorted(tuple(row) for row in spelling.variants(docs).collect())
    assert got == plain(rows)


def chunk(words):
    words = sorted(words)
    return words, spelling.Chunk(len(words[0]), "".join(words).encode("latin-1"),
                                 np.ones(len(words), "<i8").tobytes())


def test_cut_matrices_lose_no_pair(monkeypatch):
    draw = random.Random(4)
    by_length = {n: chunk({"".join(draw.choice("abcÀ") for _ in range(n)) for _ in range(200)})
                 for n in (7, 8)}
    for entries in (1, 50, 1 << 17):
        monkeypatch.setattr(spelling, "ENTRIES", entries)
        for m in (7, 8):
            for n in (7, 8):
                (left, a), (right, b) = by_length[m], by_length[n]
                pairs = {(int(i), int(j)) for x, y in spelling.close_pairs(a, b)
                         for i, j, near in zip(x, y, spelling.one_edit(a, b, x, y)) if near}
                want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right)
                        if distance_is_one(x, y)}
                assert pairs == want
                assert want


def test_near_words_stand_in_near_blocks(spark):
    words = list(plain_counts(made(3)))
    for groups in (3, 5):
        names = {row.word: row.name for row in spark.createDataFrame(
            [(word,) for word in words], "word string").select(
                "word", spelling.block_name(F.col("word"), groups).alias("name")).collect()}
        for word in words[:40]:
            near = spelling.near_blocks(names[word])
            assert len(near) == len(set(near))
            assert all(names[other] in near for other in words if distance_is_one(word, other))


def test_long_words(spark):
    """Counts whose squares need more than single precision."""
    long = "ab" * 30_000
    rows = [(1, f"{long} {long} {long}c {long}c"), (2, (long[:-1] + "c ") * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(row) for row in spelling.variants(docs).collect())
    assert got == plain(rows)
    assert len(got) == 3


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(row.doc_id, row.text) for row in odd_docs.select("doc_id", "text").collect()]
    assert sorted(tuple(row) for row in spelling.variants(odd_docs).collect()) == plain(rows)
    assert spelling.variants(no_docs).collect() == []
