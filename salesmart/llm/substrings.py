"""Removal of passages that repeat across or within documents, behind a count-min prefilter.

A window is a run of ``size`` consecutive words of one document. A first pass counts windows in
count-min sketches: every block of texts sketches its own windows, sketches of one slice of the
hash space are merged, and a window whose estimate stays below two occurs once, for estimates
are never too low. A second pass groups exactly only the windows that are left, by 96 bits of
their hash, and finds the earliest occurrence of each. Every later one marks its words.

Texts become block files of word numbers in the shared folder. A sketch is sent as its non-empty
cells, one row per block and slice, and the merged slice answers each block with a bit per cell;
the exact pass asks and answers the same way. A window is sent once per block, however often it
occurs there, and slices are ranges of hashes sized by the number of windows, so no passage makes
a slice hot and no task's memory grows with the table. A long text is cut into pieces that share
the words at their seams, and only its digest is taken by one stream over its pieces.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from salesmart.llm import sharedfs
from salesmart.llm.common import map_rows
from salesmart.llm.katz import by_shard, pack, pack_keys, unpack, unpack_keys
from salesmart.llm.words import mix
from salesmart.sources.staging import stage, work_folder

#: Words after which a block ends, and words of one piece of a long text.
BLOCK_WORDS, PIECE_WORDS = 1_500_000, 500_000
#: Windows of a slice, sketch cells per window and rows of a sketch: about one window in twenty
#: that occurs once passes the filter.
SLICE_WINDOWS, CELLS, DEPTH = 1 << 21, 4, 2
#: Texts of more bytes are read as a stream of words.
LONG_TEXT = 1 << 22

#: An odd number and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

WORD = re.compile(rb"[^\x20\x09-\x0D]+")

BLOCKS = "block string, words bigint"
SKETCHES = "slice int, block string, cells array<binary>, twice array<binary>"
ANSWERS = "block string, slice int, bits array<binary>"
CANDIDATES = ("slice int, block string, keys binary, checks binary, docs binary, starts binary")
VERDICTS = "block string, slice int, bits binary"
PIECES = ("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
          "text_key string, place bigint, kept binary")
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def words_of(data: bytes) -> Iterator[bytes]:
    if len(data) <= LONG_TEXT:
        return iter(data.split())
    return (match.group() for match in WORD.finditer(data))


def pieces_of(text: str | None, seam: int, limit: int) -> Iterator[tuple[list[bytes], list[bytes], list[bytes]]]:
    """(words before, own words, words after) of every piece of a text.

    A piece has up to ``limit`` words of its own and ``seam`` words of each piece beside it.
    """
    limit = max(limit, seam, 1)
    source = words_of((text or "").encode())
    before: list[bytes] = []
    own = list(islice(source, limit))
    while True:
        after = list(islice(source, limit)) if len(own) == limit else []
        yield before, own, after[:seam]
        if not after:
            return
        before, own = own[len(own) - seam:], after


class Block(NamedTuple):
    """Pieces of texts as word numbers, one after the other."""
    doc_ids: np.ndarray    # a null counts as the greatest number
    known_id: np.ndarray
    keys: np.ndarray       # of texts of many pieces, else 0
    offsets: np.ndarray    # of the piece's first word, shared ones included, in its text
    lengths: np.ndarray
    before: np.ndarray     # shared words at the start and at the end
    after: np.ndarray
    tokens: np.ndarray
    words: np.ndarray      # bytes of the distinct words, one per line

    def save(self, uri: str) -> None:
        parts = [zstandard.ZstdCompressor(level=1).compress(part.tobytes())
                 if part.dtype == np.uint8 else pack(part) for part in self]
        header = np.array([len(part) for part in parts], "<u8").tobytes()
        sharedfs.write_bytes(uri, header + b"".join(parts))

    @classmethod
    def load(cls, uri: str) -> Block:
        dtypes = ["<i8", "u1", "<u8", "<i8", "<i8", "<i8", "<i8", "<u4", "u1"]
        data = sharedfs.mapped(uri, "u1")
        sizes = np.frombuffer(data[:8 * len(dtypes)].tobytes(), "<u8").astype(np.int64)
        ends = 8 * len(dtypes) + np.cumsum(sizes)
        parts = [data[end - size:end].tobytes() for size, end in zip(sizes, ends, strict=True)]
        return cls(*[
            np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8)
            if dtype == "u1" else unpack(part, dtype)
            for part, dtype in zip(parts, dtypes, strict=True)])

    def vocabulary(self) -> list[bytes]:
        return self.words.tobytes().split(b"\n")


class Windows:
    """The windows of a block: every occurrence, and the distinct ones in the order of their keys."""

    def __init__(self, block: Block, size: int):
        ends = np.cumsum(block.lengths)
        first = ends - block.lengths
        counts = np.maximum(block.lengths - size + 1, 0)
        owner = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        #: Places of the windows in the block's words.
        self.at = first[owner] + offset
        doc = block.doc_ids[owner]
        start = block.offsets[owner] + offset
        digests = np.frombuffer(b"".join(
            xxhash.xxh3_128_digest(word) for word in block.vocabulary()), "<u8").reshape(-1, 2)
        keys = self._hashes(digests[:, 0], block.tokens, size)
        checks = self._hashes(digests[:, 1], block.tokens, size)
        self.order = np.argsort(keys)
        keys = keys[self.order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        #: Number of the distinct window of each occurrence, occurrences in the order of keys.
        self.group = np.cumsum(fresh) - 1
        heads = np.flatnonzero(fresh)
        self.keys = keys[heads]
        self.checks = (checks[self.order][heads] >> np.uint64(32)).astype("<u4")
        self.times = np.diff(heads, append=len(keys))
        # The earliest occurrence: the smallest doc_id, then the smallest start in it.
        self.doc, self.start = doc[self.order], start[self.order]
        self.least_doc, self.least_start = least(self.doc, self.start, heads, self.group)

    def _hashes(self, numbers: np.ndarray, tokens: np.ndarray, size: int) -> np.ndarray:
        """A rolling polynomial over the words of every window, modulo 2^64."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        powers = np.cumprod(np.full(len(tokens), BASE, np.uint64))
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(numbers[tokens] * powers, out=sums[1:])
        inverse = np.cumprod(np.full(len(tokens), INVERSE, np.uint64))
        return mix((sums[self.at + size] - sums[self.at]) * inverse[self.at])


def least(docs: np.ndarray, starts: np.ndarray, heads: np.ndarray,
          group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest (doc, start) of each group; groups are runs that begin at ``heads``."""
    if not len(heads):
        return docs[:0], starts[:0]
    doc = np.minimum.reduceat(docs, heads)
    far = np.iinfo(starts.dtype).max
    start = np.minimum.reduceat(np.where(docs == doc[group], starts, far), heads)
    return doc, start


def write_blocks(docs: DataFrame, folder: str, size: int, block_words: int = BLOCK_WORDS,
                 piece_words: int = PIECE_WORDS) -> DataFrame:
    """Write the texts as block files; returns one row per file."""
    sharedfs.make_folder(folder)
    seam = size - 1

    def make():
        def work(source):
            numbers: dict[bytes, int] = {}
            rows: list[tuple] = []
            tokens: list[np.ndarray] = []
            held = 0

            def end_block():
                # Named by attempt: only files of tasks that ended well are ever read.
                name = uuid.uuid4().hex
                columns = list(zip(*rows, strict=True))
                dtypes = ["<i8", "u1", "<u8", "<i8", "<i8", "<i8", "<i8"]
                Block(*[np.array(values, dtype) for values, dtype in zip(columns, dtypes, strict=True)],
                      np.concatenate(tokens), np.frombuffer(b"\n".join(numbers), np.uint8)
                      ).save(f"{folder}/{name}.block")
                return name, held

            for doc_id, text in source:
                key, offset = 0, 0
                for before, own, after in pieces_of(text, seam, piece_words):
                    if after:
                        key = key or uuid.uuid4().int >> 64 or 1
                    words = before + own + after
                    for word in words:
                        if word not in numbers:
                            numbers[word] = len(numbers)
                    rows.append((np.iinfo(np.int64).max if doc_id is None else doc_id,
                                 doc_id is not None, key, offset - len(before), len(words),
                                 len(before), len(after)))
                    offset += len(own)
                    tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                    held += len(words)
                    if held >= block_words:
                        yield end_block()
                        numbers, rows, tokens, held = {}, [], [], 0
            if rows:
                yield end_block()
        return work

    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    return stage(map_rows(texts, BLOCKS, make, chunk=16), "blocks")


class Shape(NamedTuple):
    """How windows are dealt to slices, and cells of a slice's sketch per row."""
    slices: int
    cells: int

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The slices that hold any of the sorted keys; the first one always, so a block is never lost."""
        for number, part in by_shard(keys, self.slices):
            if part.stop > part.start or number == 0:
                yield number, part

    def columns(self, keys: np.ndarray) -> list[np.ndarray]:
        """The cell of each key in each row of its slice's sketch."""
        return [(mix(keys + np.uint64(row * BASE % (1 << 64))) >> np.uint64(32))
                * np.uint64(self.cells) >> np.uint64(32) for row in range(1, DEPTH + 1)]


def sketches(blocks: DataFrame, folder: str, size: int, shape: Shape) -> DataFrame:
    """The count-min sketch of each block: non-empty cells and which of them count two or more."""
    def make():
        def work(rows):
            for (name,) in rows:
                windows = Windows(Block.load(f"{folder}/{name}.block"), size)
                columns = shape.columns(windows.keys)
                for number, part in shape.parts(windows.keys):
                    cells, twice = [], []
                    for column in columns:
                        used, place = np.unique(column[part], return_inverse=True)
                        counts = np.bincount(place, windows.times[part], len(used))
                        cells.append(pack(np.diff(used, prepend=np.uint64(0)).astype("<u4")))
                        twice.append(np.packbits(counts > 1).tobytes())
                    yield number, name, cells, twice
        return work

    return map_rows(blocks.select("block"), SKETCHES, make, chunk=16)


def _merge_sketches(rows: Iterable[tuple], shape: Shape) -> Iterator[tuple]:
    """Merge the sketches of each slice; tell each block which of its cells count two or more."""
    for number, group in groupby(rows, key=itemgetter(0)):
        held = [(block, cells, twice) for _, block, cells, twice in group]
        counters = np.zeros((DEPTH, shape.cells), np.uint8)
        for _, cells, twice in held:
            for row in range(DEPTH):
                used = np.cumsum(unpack(cells[row], "<u4"), dtype=np.int64)
                more = np.unpackbits(np.frombuffer(twice[row], np.uint8), count=len(used))
                counters[row][used] = np.minimum(counters[row][used] + 1 + more, 2)
        for block, cells, _ in held:
            yield block, number, [
                np.packbits(counters[row][np.cumsum(unpack(cells[row], "<u4"), dtype=np.int64)] > 1
                            ).tobytes() for row in range(DEPTH)]


def _candidates(rows: Iterable[tuple], folder: str, size: int, shape: Shape) -> Iterator[tuple]:
    """The windows of each block that are estimated to repeat, with their earliest places in it.

    Which these are waits in a file beside the block's, for the last pass.
    """
    for name, group in groupby(rows, key=itemgetter(0)):
        answers = {number: bits for _, number, bits in group}
        windows = Windows(Block.load(f"{folder}/{name}.block"), size)
        columns = shape.columns(windows.keys)
        repeated = np.ones(len(windows.keys), bool)
        for number, part in shape.parts(windows.keys):
            for column, bits in zip(columns, answers[number], strict=True):
                used, place = np.unique(column[part], return_inverse=True)
                marks = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(used)).astype(bool)
                repeated[part] &= marks[place]
        sharedfs.write_bytes(f"{folder}/{name}.candidates", np.packbits(repeated).tobytes())
        chosen = np.flatnonzero(repeated)
        keys = windows.keys[chosen]
        for number, part in shape.parts(keys):
            some = chosen[part]
            yield (number, name, pack_keys(keys[part]), windows.checks[some].tobytes(),
                   pack(windows.least_doc[some].astype("<i8")),
                   pack(windows.least_start[some].astype("<i8")))


def _merge_candidates(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Group the windows of each slice; tell each block for which another place is earlier."""
    for number, group in groupby(rows, key=itemgetter(0)):
        names, columns = [], []
        for _, name, keys, checks, docs, starts in group:
            names.append(name)
            columns.append((unpack_keys(keys), np.frombuffer(checks, "<u4"),
                            unpack(docs, "<i8"), unpack(starts, "<i8")))
        sizes = [len(column[0]) for column in columns]
        keys, checks, docs, starts = (np.concatenate(values) for values in zip(*columns, strict=True))
        order = np.lexsort((checks, keys))
        keys, checks, docs, starts = keys[order], checks[order], docs[order], starts[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        groups = np.cumsum(fresh) - 1
        doc, start = least(docs, starts, np.flatnonzero(fresh), groups)
        later = np.empty(len(keys), bool)
        later[order] = (docs != doc[groups]) | (starts != start[groups])
        for name, part in zip(names, np.split(later, np.cumsum(sizes)[:-1]), strict=True):
            yield name, number, np.packbits(part).tobytes()


def _finish(rows: Iterable[tuple], folder: str, size: int, shape: Shape) -> Iterator[tuple]:
    """What each block's pieces keep."""
    for name, group in groupby(rows, key=itemgetter(0)):
        answers = {number: bits for _, number, bits in group}
        block = Block.load(f"{folder}/{name}.block")
        windows = Windows(block, size)
        repeated = np.unpackbits(sharedfs.mapped(f"{folder}/{name}.candidates", "u1"),
                                 count=len(windows.keys)).astype(bool)
        chosen = np.flatnonzero(repeated)
        elsewhere = np.zeros(len(windows.keys), bool)
        for number, part in shape.parts(windows.keys[chosen]):
            some = chosen[part]
            elsewhere[some] = np.unpackbits(
                np.frombuffer(answers[number], np.uint8), count=len(some)).astype(bool)
        later = ((windows.doc != windows.least_doc[windows.group])
                 | (windows.start != windows.least_start[windows.group])
                 | elsewhere[windows.group])
        # A word is covered if more marked windows began up to it than ended before it.
        steps = np.zeros(len(block.tokens) + 1, np.int64)
        marked = windows.at[windows.order[later]]
        np.add.at(steps, marked, 1)
        np.add.at(steps, marked + size, -1)
        keep = np.cumsum(steps[:-1]) == 0
        vocabulary = block.vocabulary()
        end = 0
        for doc_id, known, key, offset, length, before, after in zip(
                *[column.tolist() for column in block[:7]], strict=True):
            own = slice(end + before, end + length - after)
            end += length
            kept = block.tokens[own][keep[own]].tolist()
            text = b" ".join(map(vocabulary.__getitem__, kept))
            count = own.stop - own.start
            whole = key == 0
            yield (doc_id if known else None, count, count - len(kept),
                   hashlib.sha256(text).hexdigest() if whole else None,
                   None if whole else f"{key:016x}", offset + before, None if whole else text)


def _join_pieces(rows: Iterable[tuple]) -> Iterator[tuple]:
    """One row per text of many pieces; its kept words pass through the digest as a stream."""
    for _, group in groupby(rows, key=itemgetter(0)):
        digest, n_words, n_removed, empty = hashlib.sha256(), 0, 0, True
        for _, doc_id, words, removed, kept in group:
            if kept:
                digest.update(kept if empty else b" " + kept)
                empty = False
            n_words, n_removed = n_words + words, n_removed + removed
        yield doc_id, n_words, n_removed, digest.hexdigest()


def remove_repeats(docs: DataFrame, size: int = 20, block_words: int = BLOCK_WORDS,
                   piece_words: int = PIECE_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of ``docs``.

    Words are runs of characters other than ASCII white space, unchanged. A word goes if it
    stands in a window of ``size`` words whose words also start earlier: in a smaller doc_id, or
    in the same doc_id at a smaller word. A null doc_id is greater than all others. Rows that
    repeat a doc_id are told apart by their starts alone, so equal rows all stay. A null or
    empty text has no words, a text shorter than a window loses none; both give the digest of
    what is left, which may be empty. Windows are judged on the input, and compared by 96 bits
    of hash after the sketches let them through.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{work_folder(spark)}/repeats-{uuid.uuid4().hex}"
    blocks = write_blocks(docs, folder, size, block_words, piece_words)
    number, words = blocks.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    slices = max(tasks, -(-words // SLICE_WINDOWS))
    shape = Shape(slices, max(1024, -(-CELLS * words // slices)))

    def deal(rows: DataFrame, key: str, then: str, parts: int) -> DataFrame:
        return rows.repartition(parts, key).sortWithinPartitions(key, then)

    # A block is a unit of work and of memory: each goes to a place of its own, if there are enough.
    places = max(1, min(number, 100 * tasks))
    spread = blocks.repartition(places, "block")
    sent = deal(sketches(spread, folder, size, shape), "slice", "block", slices)
    merged = map_rows(sent, ANSWERS, lambda: lambda rows: _merge_sketches(rows, shape), chunk=16)
    asked = map_rows(deal(merged, "block", "slice", places), CANDIDATES,
                     lambda: lambda rows: _candidates(rows, folder, size, shape), chunk=16)
    judged = map_rows(deal(asked, "slice", "block", slices), VERDICTS,
                      lambda: _merge_candidates, chunk=16)
    pieces = stage(map_rows(
        deal(judged, "block", "slice", places), PIECES,
        lambda: lambda rows: _finish(rows, folder, size, shape), chunk=64), "pieces")
    whole = pieces.where("text_key IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256")
    cut = pieces.where("text_key IS NOT NULL").select(
        "text_key", "doc_id", "n_words", "n_removed", "kept", "place")
    dealt = cut.repartition(tasks, "text_key").sortWithinPartitions("text_key", "place")
    return whole.union(map_rows(dealt.drop("place"), RESULT, lambda: _join_pieces, chunk=1))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, words[i + 1 : i + 20] AS run
  FROM d, unnest(range(greatest(len(words) - 19, 0))) AS t(i)),
earliest AS (
  SELECT run, min({'doc': doc_id, 'at': i}) AS first FROM windows GROUP BY run HAVING count(*) > 1),
marks AS (
  SELECT doc_id, i FROM windows JOIN earliest USING (run)
  WHERE first.doc < doc_id OR first.doc = doc_id AND first.at < i),
spread AS (
  SELECT d.doc_id, t.i, words[t.i + 1] AS word,
    max(marks.i) OVER (PARTITION BY d.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mark
  FROM d CROSS JOIN unnest(range(len(words))) AS t(i)
  LEFT JOIN marks ON marks.doc_id = d.doc_id AND marks.i = t.i),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM spread WHERE mark IS NULL GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
