"""Spelling variants among the words of a corpus, by blocked Gram matrices of letter counts.

Two words one edit apart have letter counts at a squared distance of one (a letter more or less)
or two (a letter replaced). Words are blocks by length and by how many letters of a few groups
they have; words one edit apart stand in the same or in adjacent blocks. Within a pair of blocks
the matrices are cut further, letter by letter, where counts differ by more than an edit allows.
What is left is multiplied: with the squared lengths, a Gram matrix gives all squared distances.
Pairs at the right distance are then compared code point by code point.

A block is one packed row. It goes to its own unit of work and to those of the blocks beside it,
which meet it one after the other, so a task holds two blocks at a time and returns one row per
word, however many pairs there are. Blocks of many words are cut by hash into chunks of their own
units, and groups grow in number with the vocabulary.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from salesmart.llm.common import LOWER, UPPER, map_rows
from salesmart.sources.staging import stage

#: Words have at least so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A near word is the form of a word if it occurs so many times as often.
FORM_FACTOR = 10
#: One in so many runs of a document loses a code point.
DAMAGE = 31
#: Words and code points of a chunk, and words of a block that the number of groups aims at.
CHUNK_WORDS, CHUNK_POINTS, BLOCK_WORDS = 1 << 12, 1 << 20, 1 << 15
#: Entries of a Gram matrix; larger pairs of parts are cut by one more letter.
ENTRIES = 1 << 17
#: Distinct words that a task counts before it sends them on.
COUNTED = 200_000

# The letters of words, Latin ones by how common they are in western texts.
COMMON = "etaoinshrdlcumwfgypbvkjxqz"
LETTERS = COMMON + UPPER + "".join(map(chr, range(0xC0, 0x100)))

RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
TO_LOWER = str.maketrans(UPPER, LOWER)

PACKED = "block string, chunk int, length int, words binary, counts binary, near array<string>"
FOUND = "word string, n bigint, n_near bigint, best string, best_n bigint"


def words_of(text: str | None, doc_id: int | None) -> Iterator[tuple[str, int]]:
    """The words of a text and how often each occurs, one run in ``DAMAGE`` shorter by a point."""
    runs: Counter[str] = Counter()
    for run, count in Counter(match.group() for match in RUN.finditer(text or "")).items():
        runs[run.lower() if run.isascii() else run.translate(TO_LOWER)] += count
    name = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, count in runs.items():
        number = zlib.crc32(run.encode(), name)
        if number % DAMAGE == 0:
            at = number % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LENGTH:
            yield run, count


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur at least ``LEAST_COUNT`` times; counted in tasks first."""
    def make():
        def work(source):
            counts: Counter[str] = Counter()
            for doc_id, text in source:
                for word, count in words_of(text, doc_id):
                    counts[word] += count
                if len(counts) >= COUNTED:
                    yield from counts.items()
                    counts.clear()
            yield from counts.items()
        return work

    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    return map_rows(texts, "word string, n bigint", make, chunk=8192).groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def groups_for(words: int) -> int:
    """Letter groups that leave about ``BLOCK_WORDS`` words to a block, as each one cuts it in four."""
    return max(3, math.ceil(math.log(max(1, words / BLOCK_WORDS), 4)))


def letter_group(letter: str, groups: int) -> int:
    """Groups take the letters in turn, to and fro, so that they are about equally common."""
    turn, place = divmod(LETTERS.index(letter), groups)
    return groups - 1 - place if turn % 2 else place


def block_name(word: Column, groups: int) -> Column:
    """How many letters of each group a word has."""
    counts = []
    for group in range(groups):
        others = "".join(x for x in dict.fromkeys(LETTERS) if letter_group(x, groups) != group)
        counts.append(F.length(F.translate(word, others, "")).cast("string"))
    return F.concat_ws(",", *counts)


def near_blocks(name: str) -> list[str]:
    """The blocks that hold words at most one edit from a word of this one."""
    counts = list(map(int, name.split(",")))
    found = [counts]
    for more in range(-1, len(counts)):
        for less in range(-1, len(counts)):
            if more != less:
                other = [count + (i == more) - (i == less) for i, count in enumerate(counts)]
                if min(other) >= 0:
                    found.append(other)
    return [",".join(map(str, other)) for other in found]


def _pack(rows: Iterable[tuple]) -> Iterator[tuple]:
    """One row per chunk of a block; its words have one length and stand in order."""
    for (block, chunk), group in groupby(rows, key=itemgetter(0, 1)):
        words, counts = zip(*[(word, n) for _, _, word, n in group], strict=True)
        yield (block, chunk, len(words[0]), "".join(words).encode("latin-1"),
               np.array(counts, "<i8").tobytes(), near_blocks(block))


class Chunk:
    """Words of one length as a matrix of code points, all of them below 256."""

    def __init__(self, length: int, words: bytes, counts: bytes):
        self.length = length
        self.points = np.frombuffer(words, np.uint8).reshape(-1, length)
        self.counts = np.frombuffer(counts, "<i8")

    def word(self, at: int) -> str:
        return self.points[at].tobytes().decode("latin-1")

    def letters(self, used: np.ndarray) -> np.ndarray:
        """How often each word has each of the code points ``used``."""
        column = np.zeros(256, np.int64)
        column[used] = np.arange(len(used))
        rows = np.repeat(np.arange(len(self.points)), self.length)
        return np.bincount(
            rows * len(used) + column[self.points.reshape(-1)],
            minlength=len(self.points) * len(used)).reshape(len(self.points), len(used))


def close_pairs(left: Chunk, right: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words whose letter counts are as far apart as one edit makes them."""
    step = right.length - left.length
    used = np.union1d(left.points, right.points)
    a, b = left.letters(used), right.letters(used)
    spread = np.argsort(-(a.var(axis=0) + b.var(axis=0)), kind="stable")
    # Squares of counts must be exact.
    kind = np.float32 if max(left.length, right.length) < 4096 else np.float64
    flat_a, flat_b = a.astype(kind), b.astype(kind)
    square_a, square_b = (flat_a ** 2).sum(axis=1), (flat_b ** 2).sum(axis=1)
    distance = 2 if step == 0 else 1
    # How many letters the right words may have one more of, and one less of.
    parts = [(np.arange(len(a)), np.arange(len(b)), int(step >= 0), int(step <= 0), 0)]
    while parts:
        mine, other, more, less, at = parts.pop()
        if not len(mine) or not len(other):
            continue
        if len(mine) * len(other) > ENTRIES and at < len(spread):
            first, second = a[mine, spread[at]], b[other, spread[at]]
            for count in np.unique(first):
                some = mine[first == count]
                parts.append((some, other[second == count], more, less, at + 1))
                if more:
                    parts.append((some, other[second == count + 1], 0, less, at + 1))
                if less:
                    parts.append((some, other[second == count - 1], more, 0, at + 1))
            continue
        rows = max(1, ENTRIES * 8 // len(other))
        for start in range(0, len(mine), rows):
            some = mine[start:start + rows]
            gram = flat_a[some] @ flat_b[other].T
            found = np.flatnonzero(
                square_a[some][:, None] + square_b[other][None, :] - 2 * gram == distance)
            if len(found):
                yield some[found // len(other)], other[found % len(other)]


def one_edit(left: Chunk, right: Chunk, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs differ by one code point put in, left out or replaced."""
    if left.length > right.length:
        return one_edit(right, left, j, i)
    near = np.empty(len(i), bool)
    rows = max(1, (1 << 23) // right.length)
    for start in range(0, len(i), rows):
        part = slice(start, start + rows)
        a, b = left.points[i[part]], right.points[j[part]]
        if left.length == right.length:
            near[part] = (a != b).sum(axis=1) == 1
        else:
            # Equal up to the added point, and equal after it.
            front = np.cumprod(a == b[:, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
            back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
            near[part] = front + back >= left.length
    return near


def _search(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Number and best of the near words of every word of each unit's first chunk."""
    for _, group in groupby(rows, key=itemgetter(0, 1)):
        home = Chunk(*next(group)[3:])
        n_near = np.zeros(len(home.counts), np.int64)
        best: dict[int, tuple[int, str]] = {}
        for _, _, _, *packed in group:
            other = Chunk(*packed)
            pairs = list(close_pairs(home, other))
            if not pairs:
                continue
            i, j = (np.concatenate(side) for side in zip(*pairs, strict=True))
            near = one_edit(home, other, i, j)
            i, j = i[near], j[near]
            n_near += np.bincount(i, minlength=len(n_near))
            order = np.lexsort((j, -other.counts[j], i))
            i, j = i[order], j[order]
            first = np.ones(len(i), bool)
            first[1:] = i[1:] != i[:-1]
            for at, found in zip(i[first].tolist(), j[first].tolist(), strict=True):
                entry = (-int(other.counts[found]), other.word(found))
                if at not in best or entry < best[at]:
                    best[at] = entry
        for at, (count, near_count) in enumerate(zip(home.counts.tolist(), n_near.tolist(), strict=True)):
            negative, word = best.get(at, (None, None))
            yield home.word(at), count, near_count, word, None if negative is None else -negative


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n): every word's near words, and the most frequent of them.

    ``words`` has distinct words of letters below U+0100, and n.
    """
    spark = words.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = words.withColumn("block", block_name(F.col("word"), groups_for(words.count())))
    points = F.count("*") * F.max(F.length("word"))
    blocks = stage(named.groupBy("block").agg(F.greatest(
        F.ceil(F.count("*") / CHUNK_WORDS), F.ceil(points / CHUNK_POINTS)).cast("int").alias("chunks")),
        "blocks")
    dealt = named.join(blocks, "block").select(
        "block", F.pmod(F.xxhash64("word"), "chunks").cast("int").alias("chunk"), "word", "n")
    chunks = stage(map_rows(
        dealt.repartition(tasks, "block", "chunk").sortWithinPartitions("block", "chunk", "word"),
        PACKED, lambda: _pack, chunk=8), "chunks")
    payload = ["length", "words", "counts"]
    homes = chunks.select("block", F.col("chunk").alias("home"), F.lit(0).alias("side"), *payload)
    beside = chunks.select(F.explode("near").alias("block"), *payload).join(blocks, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("home"),
        F.lit(1).alias("side"), *payload)
    units = homes.union(beside).repartition(tasks, "block", "home").sortWithinPartitions(
        "block", "home", "side")
    return map_rows(units, FOUND, lambda: _search, chunk=4096)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends; every round doubles the steps taken.

    A form occurs more often than its word, so chains end, and after few steps.
    """
    current = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stage(current.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "roots")
        current = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return current


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of ``docs``.

    Words are the runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased and one in 31
    damaged by its document, of at least 7 code points and 2 occurrences. Words are near if one
    code point put in, left out or replaced turns one into the other. The form of a word is its
    most frequent near word (of equal ones the first in code-point order) if that occurs at least
    ten times as often, else null; root is where the forms lead, the word itself without one.
    Every row counts, also repeated ones; null and empty texts have no words, a null doc_id is
    the empty text in a run's number. Tables without words give no rows.
    """
    words = stage(count_words(docs), "words")
    is_form = F.col("best_n") >= FORM_FACTOR * F.col("n")
    found = stage(near_words(words).select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near",
        F.when(is_form, F.col("best_n")).alias("form_n")), "near")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(
    list_prepend(n::BIGINT, range(0, 8)::BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS name, translate(unnest(regexp_extract_all(
    coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (
  SELECT name, run, count(*) AS n, hex(encode(name || ':' || run)) AS bytes
  FROM runs WHERE length(run) >= 7 GROUP BY name, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(0, length(bytes) // 2), lambda k: ('0x' || substr(bytes, 2 * k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
    ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 7
  GROUP BY word HAVING sum(n) >= 2),
cuts AS (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest
  FROM words, unnest(range(length(word))) AS t(i)),
pairs AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT words.word, cuts.word FROM words JOIN cuts ON cuts.rest = words.word
  UNION SELECT cuts.word, words.word FROM words JOIN cuts ON cuts.rest = words.word),
ranked AS (
  SELECT pairs.word, other, words.n, count(*) OVER (PARTITION BY pairs.word) AS n_near,
    row_number() OVER (PARTITION BY pairs.word ORDER BY words.n DESC, other) AS place
  FROM pairs JOIN words ON words.word = other),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN ranked.n >= 10 * words.n THEN other END AS form,
    CASE WHEN ranked.n >= 10 * words.n THEN ranked.n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
chain(word, root) AS (
  SELECT word, word FROM formed UNION
  SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root
  WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.form, chain.root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN chain ON chain.word = formed.word
JOIN formed AS last ON last.word = chain.root AND last.form IS NULL
"""
