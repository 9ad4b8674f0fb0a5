"""Approximate nearest neighbours by multi-index hashing.

Unit vectors are centred, rotated and cut to signs. The rotations are learned, so that signs
lie near the vectors. Codes are split into bytes, each byte with a table of its own: codes
within a Hamming radius r of a query agree with it in some byte up to r // bytes bits, so
probing every table's buckets that near finds all codes within r. What is found is checked
on whole codes and ranked by the vectors themselves.

Vectors of one length are one search. A length of many vectors is indexed in shards, each a file
in the shared folder that is written once; blocks of queries are files too. A unit of work is a
block and a shard: only their names are shuffled, and what is found. Lengths of few vectors share
one pass, in which each is a shard and a block in one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from salesmart.llm import sharedfs
from salesmart.llm.common import map_rows
from salesmart.sources.staging import stage, work_folder

#: Bits of a code, a multiple of 64; a rotation yields as many bits as vectors have components.
BITS = 128
BYTES = BITS // 8
#: Bound of the sample that rotations and radius are fitted on, and queries in it.
SAMPLE_ROWS, SAMPLE_QUERIES = 4000, 400
#: The radius holds this share of the sample queries' nearest neighbours in the sample, which
#: are farther than the nearest of all rows.
SHARE = 0.99
ROTATION_STEPS = 25
#: Distinct vectors of a shard and query vectors of a block: the unit of work is one of each.
SHARD_ROWS, BLOCK_QUERIES = 20_000, 1_000
#: Distinct vectors of one length up to which they are searched in the pass of the small lengths.
FEW_ROWS = 1_000

STORED = "number int, file string"
CLASS = ["key", "class_id", "ids", "vector"]
FOUND = "query_key bigint, query_class bigint, ids array<bigint>, score double"
RESULT = "query_id bigint, rank int, vec_id bigint, score double"

_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


class Codes(NamedTuple):
    center: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.packbits((unit - self.center) @ self.rotation > 0, axis=1)


def _rotation(centered: np.ndarray, width: int, random: np.random.Generator) -> np.ndarray:
    """Principal directions, turned until signs and coordinates agree best."""
    _, axes = np.linalg.eigh(centered.T @ centered)
    axes = axes[:, ::-1][:, :width]
    placed = centered @ axes
    turn = np.linalg.qr(random.normal(size=(axes.shape[1], axes.shape[1])))[0]
    for _ in range(ROTATION_STEPS):
        left, _, right = np.linalg.svd(np.sign(placed @ turn).T @ placed)
        turn = (left @ right).T
    return axes @ turn


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


def fit(vectors: np.ndarray, k: int) -> Codes:
    """Learn codes and radius from a sample of distinct vectors."""
    random = np.random.default_rng(11)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    center = unit.mean(axis=0)
    turns, width = [], 0
    while width < BITS:
        turns.append(_rotation(unit - center, BITS - width, random))
        width += turns[-1].shape[1]
    codes = Codes(center, np.concatenate(turns, axis=1), BITS // 4)
    coded = codes.of(vectors)
    distances = []
    for query in range(min(SAMPLE_QUERIES, len(unit))):
        near = unit @ unit[query]
        near[query] = -2
        best = np.argsort(-near)[:min(k, len(unit) - 1)]
        distances.append(hamming(coded[best], coded[query]))
    every = np.concatenate(distances) if distances else np.zeros(0)
    radius = int(np.ceil(np.quantile(every, SHARE))) if len(every) else BITS // 4
    return codes._replace(radius=radius)


class MultiIndex:
    """One table per code byte: rows in order of the byte, and where each value starts."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(codes[:, at], kind="stable") for at in range(BYTES)]
        self.starts = [np.searchsorted(codes[rows, at], np.arange(257))
                       for at, rows in enumerate(self.rows)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within a Hamming radius.

        With radius = bytes * near + more, a code within it is as near as ``near`` in one of
        the first ``more + 1`` bytes or nearer in one of the others.
        """
        near, more = divmod(radius, BYTES)
        marked = np.zeros(len(self.codes), bool)
        for at in range(BYTES):
            reach = near if at <= more else near - 1
            starts = self.starts[at]
            for value in np.flatnonzero(_DISTANCE[code[at]] <= reach).tolist():
                marked[self.rows[at][starts[value]:starts[value + 1]]] = True
        rows = np.flatnonzero(marked)
        return rows[hamming(self.codes[rows], code) <= radius]

    def candidates(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """Rows within the radius, or within one that grows until ``least`` rows are found."""
        rows = self.within(code, radius)
        while len(rows) < min(least, len(self.codes)):
            radius += BYTES // 2
            rows = self.within(code, radius)
        return rows


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors by powers of two, so that no square under- or overflows; cosines stay what they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


class Stored(NamedTuple):
    """Distinct vectors, their codes and ids, as arrays; a key tells classes of one id apart."""
    keys: np.ndarray
    classes: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], codes: Codes) -> Stored:
        keys, classes, ids, vectors = zip(*rows, strict=True)
        matrix = scaled(np.array(vectors))
        return cls(np.array(keys, "<i8"), np.array(classes, "<i8"),
                   np.cumsum(list(map(len, ids)), dtype="<i8"),
                   np.concatenate([np.array(some, "<i8") for some in ids]), matrix, codes.of(matrix))

    def save(self, uri: str) -> None:
        sizes = np.array([len(self.classes), len(self.ids), self.vectors.shape[1]], "<i8")
        sharedfs.write_bytes(uri, b"".join(part.tobytes() for part in (sizes, *self)))

    @classmethod
    def load(cls, uri: str) -> Stored:
        data = sharedfs.mapped(uri, "u1")
        rows, members, width = data[:24].view("<i8").tolist()
        ends = 24 + np.cumsum([8 * rows, 8 * rows, 8 * rows, 8 * members, 8 * rows * width])
        parts = [data[start:end] for start, end in zip([24, *ends], [*ends, len(data)], strict=True)]
        keys, classes, last, ids = (part.view("<i8") for part in parts[:4])
        return cls(keys, classes, last, ids, parts[4].view("<f8").reshape(rows, width),
                   parts[5].reshape(rows, BYTES))

    def ids_of(self, row: int) -> list[int]:
        return self.ids[self.ends[row - 1] if row else 0:self.ends[row]].tolist()


class Shard:
    """Stored vectors with the tables of their codes."""

    def __init__(self, stored: Stored):
        self.stored = stored
        self.index = MultiIndex(stored.codes)
        self.norms = np.linalg.norm(stored.vectors, axis=1)

    def nearest(self, vector: np.ndarray, code: np.ndarray, radius: int, least: int) -> Iterator[tuple]:
        """(ids, score) of the ``least`` classes nearest to a vector; ties to the smaller class."""
        found = self.index.candidates(code, radius, least)
        scores = self.stored.vectors[found] @ vector / (self.norms[found] * np.linalg.norm(vector))
        for at in np.lexsort((self.stored.classes[found], -scores))[:least]:
            yield self.stored.ids_of(int(found[at])), float(scores[at])


@lru_cache(maxsize=2)
def shard_of(uri: str) -> Shard:
    return Shard(Stored.load(uri))


def _search(codes: Codes, k: int, units: Iterable[tuple]) -> Iterator[tuple]:
    """Each block's query classes against each shard's: the best k + 1 classes."""
    for block_file, shard_file in units:
        shard, block = shard_of(shard_file), Stored.load(block_file)
        for key, class_id, vector, code in zip(
                block.keys.tolist(), block.classes.tolist(), block.vectors, block.codes, strict=True):
            for ids, score in shard.nearest(vector, code, codes.radius, k + 1):
                yield key, class_id, ids, score


def _search_few(k: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    """The best k + 1 classes of each query class among those of its length."""
    for _, group in groupby(rows, key=itemgetter(0)):
        classes, asks = [], []
        for _, asking, *row in group:
            classes.append(row)
            asks.append(asking)
        if not any(asks):
            continue
        codes = fit(scaled(np.array([vector for *_, vector in classes])), k)
        stored = Stored.of(classes, codes)
        shard = Shard(stored)
        for at in np.flatnonzero(asks).tolist():
            for ids, score in shard.nearest(stored.vectors[at], stored.codes[at], codes.radius, k + 1):
                yield int(stored.keys[at]), int(stored.classes[at]), ids, score


def store(classes: DataFrame, codes: Codes, folder: str, files: int) -> DataFrame:
    """Deal distinct vectors to files of arrays; returns one row per file that holds any."""
    def make():
        def work(source):
            for number, group in groupby(source, key=itemgetter(0)):
                # Named by attempt: only files of tasks that ended well are ever read.
                file = f"{folder}/{uuid.uuid4().hex}.vectors"
                Stored.of([row[1:] for row in group], codes).save(file)
                yield number, file
        return work

    dealt = classes.select(
        F.pmod(F.xxhash64("class_id", "vector"), F.lit(files)).cast("int").alias("number"), *CLASS)
    return stage(map_rows(dealt.repartition(files, "number").sortWithinPartitions("number"), STORED, make,
                          chunk=1), "stored")


def search_length(classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """What is found (FOUND) among the many distinct vectors of one length."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("class_id", "vector")).limit(SAMPLE_ROWS).select("vector").collect()
    codes = fit(scaled(np.array([row["vector"] for row in sample])), k)
    folder = sharedfs.make_folder(f"{work_folder(spark)}/nearest-{uuid.uuid4().hex}")
    asking = classes.join(asked, ["key", "class_id"], "left_semi")
    shards = store(classes, codes, folder, -(-classes.count() // SHARD_ROWS))
    blocks = store(asking, codes, folder, max(1, -(-asking.count() // BLOCK_QUERIES)))
    # Every block meets every shard, as every query meets all rows; the tables have a row per file.
    count = shards.agg(F.max("number")).first()[0]
    units = blocks.select(
        "file", F.explode(F.sequence(F.lit(0), F.lit(count))).alias("number")).withColumnRenamed(
        "file", "block").join(shards, "number")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.select("block", "file").repartition(tasks, "block", "file").sortWithinPartitions("file")
    return map_rows(dealt, FOUND, lambda: lambda source: _search(codes, k, source), chunk=2048)


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id and vector of the rows whose vector has a direction.

    Left out: a null vec_id, null vectors, vectors of zeros or of no length, null or
    non-finite components.
    """
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")).where(
        "vec_id IS NOT NULL AND vector IS NOT NULL").where(finite).where(
        F.exists("vector", lambda x: x != 0))


def nearest(rows: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` nearest rows by cosine of each row whose vec_id is divisible by ``every``.

    Equal vectors are searched and indexed once: of each distinct vector only the k + 1
    smallest vec_ids can be among the nearest, as ties go to the smaller one. A query's own
    vec_id is no candidate. Vectors of different lengths have no cosine and never meet. Rows that
    repeat count once; a table without valid vectors gives no rows.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    valid = taking_part(rows)
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    classes = valid.withColumn("place", rank).where(F.col("place") <= k + 1).groupBy("vector").agg(
        F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = stage(classes.select(
        F.xxhash64("vector").alias("key"), F.get("ids", F.lit(0)).alias("class_id"), "ids", "vector",
        F.size("vector").alias("length")), "vectors")
    asking = stage(valid.where(F.col("vec_id") % every == 0).join(
        classes.select("vector", "key", "class_id", "length"), "vector").select(
        F.col("vec_id").alias("query_id"), "key", "class_id", "length").distinct(), "queries")
    asked = asking.select("key", "class_id", "length").distinct()
    # One row per length.
    sizes = {row["length"]: row["count"] for row in classes.groupBy("length").count().collect()}
    many = [length for length, count in sizes.items() if count > FEW_ROWS]
    few = classes.where(~F.col("length").isin(many)) if many else classes
    small = few.join(asked.withColumn("asks", F.lit(True)), ["key", "class_id", "length"], "left").select(
        "length", F.coalesce("asks", F.lit(False)).alias("asks"), *CLASS)
    found = map_rows(small.repartition(tasks, "length").sortWithinPartitions("length", "class_id", "key"),
                     FOUND, lambda: lambda source: _search_few(k, source), chunk=2048)
    for length in many:
        found = found.union(search_length(
            classes.where(F.col("length") == length), asked.where(F.col("length") == length), k))
    order = [F.desc("score"), F.col("vec_id")]
    query = ["query_key", "query_class"]
    hits = found.select(*query, "score", F.explode("ids").alias("vec_id"))
    best = hits.withColumn("place", F.row_number().over(
        Window.partitionBy(*query).orderBy(*order))).where(F.col("place") <= k + 1)
    same = (F.col("key") == F.col("query_key")) & (F.col("class_id") == F.col("query_class"))
    answered = asking.join(best.drop("place"), same).where("query_id != vec_id")
    return answered.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
