"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A folder holds, per partition, ``*.ids`` (little-endian unsigned integers, 16 bits wide if
the vocabulary allows, else 32), ``*.offsets`` (where each document starts in the file, and
its end) and ``*.keys`` (doc_ids). Partitions follow each other in doc_id order. The manifest,
a Parquet table with one row per partition, has the base of each: the prefix sum of the
tokens before it. All files can be memory-mapped and opened at any document.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from salesmart.llm import sharedfs
from salesmart.llm.common import map_rows
from salesmart.llm.pretokens import WHOLE_TEXT, batches, pieces
from salesmart.sources.staging import stage, work_folder

#: Pieces whose ids each worker keeps; a full cache is renewed from the pieces in use.
CACHE_ENTRIES = 2_000_000
#: Pieces that the library encodes at once.
PART = 20_000

MANIFEST = ("partition int, name string, width int, nulls bigint, docs bigint, tokens bigint")
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class PieceIds:
    """Ids by piece, from the tokenizer; it splits texts as ``pieces`` does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already fills the cores
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(token.single_word or token.lstrip or token.rstrip for token in added.values()):
            raise ValueError(f"{path}: added tokens that depend on what is beside them")
        self.added = {token.content: number for number, token in added.items()}
        # The first place counts, and there the longest token.
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, runs: list[list[str]]) -> None:
        """Encode the pieces that are not known yet, all at once."""
        used = set().union(*runs)
        fresh = used.difference(self.known)
        if len(self.known) + len(fresh) > CACHE_ENTRIES // 2:
            self.older, self.known = self.known, {}
            fresh = used
        new = []
        for piece in fresh:
            ids = self.older.get(piece)
            if ids is None:
                new.append(piece)
            else:
                self.known[piece] = ids
        # In parts, as the library's results take far more room than the ids.
        for start in range(0, len(new), PART):
            part = new[start:start + PART]
            found = [item.ids for item in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            data = np.fromiter(chain.from_iterable(found), f"<u{self.width}").tobytes()
            end = 0
            for piece, ids in zip(part, found, strict=True):
                begin, end = end, end + self.width * len(ids)
                self.known[piece] = data[begin:end]

    def split(self, text: str) -> Iterator[list[str] | int]:
        """Runs of pieces, and the ids of added tokens whose strings stand between them."""
        at = 0
        for found in self.marks.finditer(text) if self.marks else ():
            yield from pieces(text[at:found.start()])
            yield self.added[found.group()]
            at = found.end()
        yield from pieces(text[at:] if at else text)

    def packed(self, parts: Iterable[list[str] | int]) -> Iterator[bytes]:
        """Ids of known pieces, as they stand in the files."""
        for part in parts:
            if isinstance(part, int):
                yield part.to_bytes(self.width, "little")
            else:
                yield b"".join(map(self.known.__getitem__, part))

    def encode_all(self, rows: Iterable[tuple[int | None, str | None]]) -> Iterator[tuple[int | None, Iterable[bytes]]]:
        """Key and packed ids of each row, as the library encodes the text.

        The new pieces of rows of a bounded size are learned together, those of a long text run
        by run.
        """
        for batch in batches(rows):
            if len(batch[0][1]) > WHOLE_TEXT:
                [(key, text)] = batch
                yield key, self.streamed(self.split(text))
                continue
            parts = [(key, list(self.split(text))) for key, text in batch]
            self.learn([run for _, runs in parts for run in runs if not isinstance(run, int)])
            for key, runs in parts:
                yield key, self.packed(runs)

    def streamed(self, parts: Iterable[list[str] | int]) -> Iterator[bytes]:
        for part in parts:
            if not isinstance(part, int):
                self.learn([part])
            yield from self.packed([part])

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text without added tokens: their strings would be ordinary text."""
        return np.frombuffer(b"".join(self.streamed(pieces(text))), f"<u{self.width}")

    def encode_whole(self, text: str) -> np.ndarray:
        """The ids that the library gives the text; strings of added tokens are those tokens."""
        return np.frombuffer(b"".join(self.streamed(self.split(text))), f"<u{self.width}")


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write the files; returns the manifest with each partition's base.

    Documents are dealt by ranges of doc_id (then text), so one task holds a range, streams
    it to files named after the attempt, and only files of the attempt that ended well are
    in the manifest. The string of an added token in a text becomes that token, as in the
    library. A null text is empty and has the end id alone; null doc_ids come first;
    rows that repeat are all written.
    """
    sharedfs.make_folder(folder)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def make():
        def work(source):
            first = next(source, None)
            if first is None:
                return
            encoder = piece_ids(tokenizer)
            partition = TaskContext.get().partitionId()
            name = f"part-{partition:06d}-{uuid.uuid4().hex[:12]}"
            keys, offsets, nulls = [], [0], 0
            with sharedfs.open_output(f"{folder}/{name}.ids") as out:
                for doc_id, parts in encoder.encode_all(chain([first], source)):
                    size = 0
                    for data in parts:
                        out.write(data)
                        size += len(data)
                    out.write(end_id.to_bytes(encoder.width, "little"))
                    offsets.append(offsets[-1] + size // encoder.width + 1)
                    nulls += doc_id is None
                    keys.append(doc_id or 0)
            sharedfs.write_bytes(f"{folder}/{name}.offsets", np.array(offsets, "<u8").tobytes())
            sharedfs.write_bytes(f"{folder}/{name}.keys", np.array(keys, "<i8").tobytes())
            yield partition, name, encoder.width, nulls, len(keys), offsets[-1]
        return work

    written = stage(map_rows(dealt, MANIFEST, make), "token-files")
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the only table here that one task sees whole.
    return written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Map the files again: place, length and checksum of every document's ids.

    The checksum is taken over the ids as little-endian 32-bit integers, whatever the width.
    """
    def make():
        def work(source):
            for name, width, nulls, base in source:
                ids = sharedfs.mapped(f"{folder}/{name}.ids", f"<u{width}")
                offsets = sharedfs.mapped(f"{folder}/{name}.offsets", "<u8")
                keys = sharedfs.mapped(f"{folder}/{name}.keys", "<i8")
                for at, key in enumerate(keys.tolist()):
                    start, end = int(offsets[at]), int(offsets[at + 1])
                    crc = zlib.crc32(ids[start:end].astype("<u4"))
                    yield None if at < nulls else key, base + start, end - start, crc
        return work

    # A fixed number of tasks: adaptive execution would gather these few rows in one.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("name", "width", "nulls", "base").repartition(tasks, "name")
    return map_rows(spread, READ, make, chunk=4096)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back."""
    folder = f"{work_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder), folder)
