"""Scoring texts with a Katz backoff model of word pairs, learned from the documents.

P(w | h) is the Good-Turing discounted share of w after h where training holds the pair, else
the backoff weight of h times P(w). P(w) is the discounted share of w, and what discounts
leave over belongs to one unknown word. A backoff weight shares out what the discounts of its
context left over to exactly the words not seen after it, so the probabilities after every
context sum to 1.

Texts are turned into blocks of word numbers, kept as files in the shared folder. A block asks
for the counts of its distinct words and pairs by sending sorted 64-bit keys with its own
counts to shards of the key space. Shards add up, store the model's tables and answer every
block in the order it asked. Requests are distinct per block before they are sent, and shards
are ranges of hashes, so a frequent word is one row per block and no shard is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from salesmart.llm import sharedfs
from salesmart.llm.common import key_remainder, map_rows
from salesmart.llm.words import MULTIPLIER, WordHashes, mix, plain_words
from salesmart.sources.staging import stage, work_folder

#: Rows whose key remainder by FOLDS is HELD_OUT are scored but not learned from.
FOLDS, HELD_OUT = 5, 1
#: Tokens after which a block ends; one text is never split.
BLOCK_TOKENS = 2_500_000
#: Counts above this are not discounted.
CUT = 5

# Words hold no white space and are not empty, so these two are no word's hashes.
END = xxhash.xxh64_intdigest(b"")
START = xxhash.xxh64_intdigest(b" ")

WORD, PAIR = 1, 2

BLOCKS = "block string, docs bigint, tokens bigint, train_docs bigint"
REQUESTS = "level int, shard int, block string, keys binary, counts binary"
MERGED = ("level int, shard int, block string, keys binary, counts binary, owned binary, "
          "total bigint, types bigint, repeats array<bigint>")
SUMS = "shard int, block string, keys binary, left binary, taken binary, counts binary"
SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
          "train_tokens bigint, base_score double, score double")


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from one to the next."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


class Block(NamedTuple):
    """Texts as word numbers: every text's words and the end, one after the other."""
    doc_ids: np.ndarray
    known_id: np.ndarray
    held_out: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    def save(self, uri: str) -> None:
        parts = [pack(part) for part in self]
        header = np.array([len(part) for part in parts], "<u8").tobytes()
        sharedfs.write_bytes(uri, header + b"".join(parts))

    @classmethod
    def load(cls, uri: str) -> Block:
        return cls(*load_parts(uri, ["<i8", "u1", "u1", "<i8", "<u4", "<u8"]))

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def contexts(self) -> np.ndarray:
        """The word number before each token; the start has the number after the last word."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = len(self.words)
        return before

    def pair_keys(self) -> np.ndarray:
        hashes = np.append(self.words, np.uint64(START))
        return mix(mix(hashes * MULTIPLIER)[self.contexts()] + self.words[self.tokens])


def load_parts(uri: str, dtypes: list[str]) -> list[np.ndarray]:
    data = sharedfs.mapped(uri, "u1")
    sizes = data[:8 * len(dtypes)].tobytes()
    ends = 8 * len(dtypes) + np.cumsum(np.frombuffer(sizes, "<u8")).astype(np.int64)
    starts = [8 * len(dtypes), *ends[:-1].tolist()]
    return [unpack(data[a:b].tobytes(), dtype)
            for a, b, dtype in zip(starts, ends.tolist(), dtypes, strict=True)]


def write_blocks(docs: DataFrame, folder: str) -> DataFrame:
    """Write the texts as block files; returns one row per file."""
    sharedfs.make_folder(folder)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text",
                       (key_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"))

    def make():
        hashes = WordHashes()

        def work(source):
            numbers: dict[bytes, int] = {}
            words, ids, known, held, lengths, tokens = [], [], [], [], [], []
            size = 0

            def end_block():
                # Named by attempt: only files of tasks that ended well are ever read.
                name = uuid.uuid4().hex
                Block(np.array(ids, "<i8"), np.array(known, "u1"), np.array(held, "u1"),
                      np.array(lengths, "<i8"), np.concatenate(tokens),
                      np.array(words, "<u8")).save(f"{folder}/{name}.block")
                return name, len(ids), size, held.count(False)

            for doc_id, text, held_out in source:
                if not lengths:
                    numbers, words = {}, [END]
                parts = plain_words(text)
                for word in set(parts):
                    if word not in numbers:
                        numbers[word] = len(words)
                        words.append(hashes[word])
                line = np.zeros(len(parts) + 1, "<u4")
                line[:-1] = np.fromiter(map(numbers.__getitem__, parts), np.uint32, len(parts))
                ids.append(doc_id or 0)
                known.append(doc_id is not None)
                held.append(held_out)
                lengths.append(len(line))
                tokens.append(line)
                size += len(line)
                if size >= BLOCK_TOKENS:
                    yield end_block()
                    ids, known, held, lengths, tokens, size = [], [], [], [], [], 0
            if lengths:
                yield end_block()
        return work

    return stage(map_rows(rows, BLOCKS, make), "blocks")


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Ranges of sorted keys, one per shard of the key space."""
    numbers = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    edges = np.searchsorted(numbers, np.arange(shards + 1, dtype=np.uint64))
    for shard in range(shards):
        yield shard, slice(int(edges[shard]), int(edges[shard + 1]))


def sorted_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's words by hash, and the place of each word in it."""
    order = np.argsort(block.words)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place


def training(block: Block) -> np.ndarray:
    return np.repeat(block.held_out == 0, block.lengths)


def requests(blocks: DataFrame, folder: str, shards: int) -> DataFrame:
    """What each block asks for: its distinct words and pairs with its training counts."""
    def make():
        def work(rows):
            for (name,) in rows:
                block = Block.load(f"{folder}/{name}.block")
                train = training(block)
                order, _ = sorted_words(block)
                counts = np.bincount(block.tokens[train], minlength=len(block.words))[order]
                yield from split(WORD, name, block.words[order], counts)
                keys, place = np.unique(block.pair_keys(), return_inverse=True)
                yield from split(PAIR, name, keys, np.bincount(place[train], minlength=len(keys)))

        def split(level, name, keys, counts):
            for shard, part in by_shard(keys, shards):
                if part.stop > part.start:
                    yield (level, shard, name, pack_keys(keys[part]),
                           pack(counts[part].astype("<u4")))
        return work

    return map_rows(blocks.select("block"), REQUESTS, make, chunk=16)


def _merge(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Totals of each shard: a row of the model's table, and an answer to each block.

    The first block that asks for a pair owns it, so that later sums count it once.
    """
    for (level, shard), group in groupby(rows, key=itemgetter(0, 1)):
        names, keys, counts = [], [], []
        for _, _, name, more, numbers in group:
            names.append(name)
            keys.append(unpack_keys(more))
            counts.append(unpack(numbers, "<u4"))
        every, first, place = np.unique(
            np.concatenate(keys), return_index=True, return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
        owned = np.zeros(len(place), bool)
        owned[first] = True
        seen = totals > 0
        repeats = np.bincount(totals[totals <= CUT + 1], minlength=CUT + 2)[1:].tolist()
        yield (level, shard, None, pack_keys(every[seen]), pack(totals[seen].astype("<u8")), None,
               int(totals.sum()), int(seen.sum()), repeats)
        end = 0
        for name, part in zip(names, keys, strict=True):
            start, end = end, end + len(part)
            yield (level, shard, name, None, pack(totals[place[start:end]].astype("<u8")),
                   pack(owned[start:end].astype("u1")), 0, 0, [])


class Discounts(NamedTuple):
    """Total count, number of types and the share of each count up to CUT that is kept."""
    total: int
    types: int
    kept: np.ndarray


def discounts(total: int, types: int, repeats: list[int]) -> Discounts:
    """Good-Turing discounts of counts up to CUT, from how many types have each count.

    Where the counts of counts give no proper discount (too little text), half a count is
    taken off instead.
    """
    kept = np.ones(CUT + 1)
    ones, beyond = repeats[0], repeats[CUT]
    common = (CUT + 1) * beyond / ones if ones else 1.0
    for count in range(1, CUT + 1):
        value = 0.0
        if repeats[count - 1] and common < 1:
            adjusted = (count + 1) * repeats[count] / (count * repeats[count - 1])
            value = (adjusted - common) / (1 - common)
        kept[count] = value if 0 < value < 1 else (count - 0.5) / count
    return Discounts(total, types, kept)


def kept_count(counts: np.ndarray, level: Discounts) -> np.ndarray:
    """Discounted counts."""
    return counts * np.where(counts <= CUT, level.kept[np.minimum(counts, CUT)], 1.0)


class Model(NamedTuple):
    """What every task needs besides the tables: a few numbers."""
    words: Discounts
    pairs: Discounts
    train_docs: int
    word_left: float

    def word_shares(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by training count; words of count 0 are the unknown word."""
        if self.word_left > 0:
            known = kept_count(counts, self.words) / max(1, self.words.total)
            return np.where(counts > 0, known, self.word_left)
        # Nothing is discounted: the unknown word gets one count more than all.
        return np.where(counts > 0, counts, 1) / (self.words.total + 1)


def model_numbers(merged: DataFrame, train_docs: int) -> Model:
    rows = merged.where("block IS NULL").groupBy("level").agg(
        F.sum("total").alias("total"), F.sum("types").alias("types"),
        *[F.sum(F.get("repeats", F.lit(i))).alias(f"r{i}") for i in range(CUT + 1)]).collect()
    levels = {row["level"]: discounts(row["total"], row["types"], [row[f"r{i}"] for i in range(CUT + 1)])
              for row in rows}
    repeats = {row["level"]: [row[f"r{i}"] for i in range(CUT)] for row in rows}
    nothing = discounts(0, 0, [0] * (CUT + 1))
    words = levels.get(WORD, nothing)
    left = sum(number * count * (1 - words.kept[count])
               for count, number in enumerate(repeats.get(WORD, []), 1)) / max(1, words.total)
    return Model(words, levels.get(PAIR, nothing), train_docs, float(left))


def context_sums(answers: DataFrame, folder: str, model: Model, shards: int) -> DataFrame:
    """Per block: what its owned pairs leave over and take of the words' shares, by context.

    Scores are settled as far as they need no backoff weight; they wait, with the contexts
    that back off, in a file beside the block's.
    """
    def make():
        def work(rows):
            for name, group in groupby(rows, key=itemgetter(0)):
                counts, owned = {WORD: [], PAIR: []}, []
                for _, level, _, numbers, owners in group:
                    counts[level].append(unpack(numbers, "<u8").astype(np.int64))
                    if level == PAIR:
                        owned.append(unpack(owners, "u1"))
                block = Block.load(f"{folder}/{name}.block")
                order, place = sorted_words(block)
                word_counts = np.concatenate(counts[WORD])[place]
                pair_place = np.unique(block.pair_keys(), return_inverse=True)[1]
                yield from settle(name, block, order, word_counts, np.concatenate(counts[PAIR]),
                                  np.concatenate(owned).astype(bool), pair_place)

        def settle(name, block, order, word_counts, pair_counts, owned, pair_place):
            shares = model.word_shares(word_counts)
            contexts, tokens = block.contexts().astype(np.int64), block.tokens.astype(np.int64)
            context_counts = np.append(word_counts, model.train_docs)
            context_counts[0] = 0  # nothing follows the end
            # One place in the block for each of its pairs.
            first = np.full(len(pair_counts), -1, np.int64)
            first[pair_place[::-1]] = np.arange(len(pair_place))[::-1]
            mine = owned & (pair_counts > 0)
            at, found = first[mine], pair_counts[mine]
            left = np.bincount(contexts[at], weights=found - kept_count(found, model.pairs),
                               minlength=len(context_counts))
            taken = np.bincount(contexts[at], weights=shares[tokens[at]],
                                minlength=len(context_counts))
            held = pair_counts[pair_place]
            seen = held > 0
            owners = block.owners()
            known = word_counts[tokens] > 0
            scale = model.words.total + 0.5 * (model.words.types + 1)
            base = np.log10((word_counts[tokens] + 0.5) / scale)
            logs = np.empty(len(tokens))
            logs[seen] = np.log10(
                kept_count(held[seen], model.pairs) / context_counts[contexts[seen]])
            logs[~seen] = np.log10(shares[tokens[~seen]])
            size = len(block.lengths)
            # Contexts in the order of their hashes, the start among them.
            hashes = np.append(block.words, np.uint64(START))
            context_order = np.argsort(hashes)
            rank = np.empty(len(hashes), np.int64)
            rank[context_order] = np.arange(len(hashes))
            parts = [
                block.doc_ids, block.known_id, block.held_out, block.lengths,
                np.bincount(owners, weights=known, minlength=size).astype("<u8"),
                np.bincount(owners, weights=base, minlength=size),
                np.bincount(owners, weights=logs, minlength=size),
                owners.astype("<u4"), rank[contexts].astype("<u4"), seen.astype("u1"),
                context_counts[context_order].astype("<u8")]
            packed = [pack(part) for part in parts]
            sharedfs.write_bytes(f"{folder}/{name}.scores", np.array(
                [len(part) for part in packed], "<u8").tobytes() + b"".join(packed))
            keys = hashes[context_order]
            for shard, part in by_shard(keys, shards):
                if part.stop > part.start:
                    yield (shard, name, pack_keys(keys[part]), pack(left[context_order[part]]),
                           pack(taken[context_order[part]]),
                           pack(context_counts[context_order[part]].astype("<u8")))
        return work

    return map_rows(answers, SUMS, make, chunk=16)


def _weights(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Backoff weights of each shard's contexts, as answers to the blocks.

    A weight is negative where a context's counts were not discounted at all: then one count
    is added to the context's, and that is what its unseen words share.
    """
    for shard, group in groupby(rows, key=itemgetter(0)):
        names, keys, left, taken, counts = [], [], [], [], []
        for _, name, more, *packed in group:
            names.append(name)
            keys.append(unpack_keys(more))
            for values, data, dtype in zip(
                    (left, taken, counts), packed, ("<f8", "<f8", "<u8"), strict=True):
                values.append(unpack(data, dtype))
        every, first, place = np.unique(
            np.concatenate(keys), return_index=True, return_inverse=True)
        all_left, all_taken = (np.bincount(place, weights=np.concatenate(values), minlength=len(every))
                               for values in (left, taken))
        count = np.concatenate(counts)[first].astype(np.float64)
        # A context without training has weight 1: its words have their own shares.
        rest = np.maximum(1 - all_taken, 1e-12)
        weight = np.where(all_left > 0, all_left / np.maximum(count, 1), -1 / (count + 1)) / rest
        weight[count == 0] = 1.0
        end = 0
        for name, part in zip(names, keys, strict=True):
            start, end = end, end + len(part)
            yield shard, name, pack(weight[place[start:end]])


def _finish(folder: str, train_tokens: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    """Scores of each block's texts, once its contexts' weights are known."""
    for name, group in groupby(rows, key=itemgetter(0)):
        weights = np.concatenate([unpack(data, "<f8") for _, _, data in group])
        (ids, known_id, held_out, lengths, known, base, logs, owners, contexts, seen,
         counts) = load_parts(f"{folder}/{name}.scores", [
             "<i8", "u1", "u1", "<i8", "<u8", "<f8", "<f8", "<u4", "<u4", "u1", "<u8"])
        # Pairs not seen take the weight; seen ones share with a count that is added.
        shared = np.where(weights < 0, np.log10(np.maximum(counts, 1) / (counts + 1.0)), 0)
        weight = np.log10(np.abs(weights))
        terms = np.where(seen == 1, shared[contexts], weight[contexts])
        scores = logs + np.bincount(owners, weights=terms, minlength=len(lengths))
        for at in range(len(lengths)):
            yield (int(ids[at]) if known_id[at] else None, bool(held_out[at]), int(lengths[at]),
                   int(known[at]), train_tokens, float(base[at]), float(scores[at]))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` under the model of those that are not held out.

    A null or empty text is the end token alone. A null doc_id is learned from; rows that
    repeat count each time. Without training rows every word is the unknown one. Words are
    known by 64-bit hashes.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{work_folder(spark)}/katz-{uuid.uuid4().hex}"
    blocks = write_blocks(docs, folder)
    number = blocks.agg(F.count("*"), F.sum("train_docs")).first()
    spread = blocks.repartition(max(1, min(number[0], 100 * shards)), "block")
    asked = requests(spread, folder, shards).repartition(shards, "level", "shard")
    merged = stage(map_rows(asked.sortWithinPartitions("level", "shard", "block"), MERGED,
                            lambda: _merge, chunk=16), "ngrams")
    model = model_numbers(merged, number[1] or 0)
    answers = merged.where("block IS NOT NULL").select(
        "block", "level", "shard", "counts", "owned").repartition(shards, "block")
    sums = stage(context_sums(answers.sortWithinPartitions("block", "level", "shard"), folder,
                              model, shards), "contexts")
    dealt = sums.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    weights = map_rows(dealt, "shard int, block string, weights binary", lambda: _weights, chunk=16)
    back = weights.select("block", "shard", "weights").repartition(shards, "block")
    tokens = model.words.total
    return map_rows(back.sortWithinPartitions("block", "shard"), SCORES,
                    lambda: lambda rows: _finish(folder, tokens, rows), chunk=4096)
