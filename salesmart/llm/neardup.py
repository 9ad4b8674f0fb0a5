"""Near-duplicate documents by min-max hashing.

Each hash function gives two signature values, the least and the greatest hash of a shingle
set. Both match another set's with the probability of their Jaccard similarity, so half the
hash evaluations give a signature of the same length. Signatures are cut into bands; sets
that share a band may be similar. Every possible link within a group that shares bands is
then confirmed on the full shingle sets, block against block.

Sets of equal documents are one class, so copies cost one row each and no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from salesmart.llm.common import map_rows
from salesmart.llm.components import components
from salesmart.llm.words import WordHashes, plain_words, shingle_set
from salesmart.sources.staging import stage

#: Signature values per band and bands: sets of similarity 0.8 miss each other in all bands
#: with a probability of 2e-5, sets of similarity 0.3 meet in one with a probability of 0.03.
ROWS, BANDS = 6, 36
#: Shingles of one block of sets that a task compares with another block.
BLOCK_SHINGLES = 150_000
#: Columns of the incidence matrix multiplied at once.
COLUMNS = 4096

SIGNATURES = ("doc_id bigint, text_hash bigint, n_shingles bigint, class binary, "
              "bands array<bigint>")


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    draw = random.integers(0, 1 << 63, (2, count), dtype=np.uint64) * np.uint64(2)
    return draw[0] + np.uint64(1), draw[1] ^ (draw[1] >> np.uint64(33))


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least hash under every function, then the greatest under every function."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    greatest = np.zeros(len(factors), np.uint64)
    for start in range(0, len(shingles), COLUMNS):
        part = np.multiply.outer(factors, shingles[start:start + COLUMNS])
        part += offsets[:, None]
        np.minimum(least, part.min(axis=1), out=least)
        np.maximum(greatest, part.max(axis=1), out=greatest)
    return np.concatenate([least, greatest])


def class_of(shingles: np.ndarray) -> bytes:
    """A 128-bit digest of a shingle set: the identity of all documents that have it."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, size: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Shingle count, class and band hashes of every document."""
    def make():
        hashes = WordHashes()
        factors, offsets = _coefficients(-(-rows * bands // 2))

        def work(source):
            for doc_id, text_hash, text in source:
                shingles = shingle_set(hashes.of(plain_words(text)), size)
                if not len(shingles):
                    yield doc_id, text_hash, 0, None, []
                    continue
                values = signature(shingles, factors, offsets)[:rows * bands].reshape(bands, rows)
                yield doc_id, text_hash, len(shingles), class_of(shingles), [
                    xxhash.xxh64_intdigest(band.tobytes(), number) - (1 << 63)
                    for number, band in enumerate(values)]
        return work

    hashed = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), "text")
    return map_rows(hashed, SIGNATURES, make)


def coarse_groups(classes: DataFrame) -> DataFrame:
    """(class, cluster) of the classes that share a band, directly or through others.

    Each band's classes are tied to the least of them: one edge per class and band, not one
    per pair.
    """
    banded = classes.select("class", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(
        F.min("class").alias("least"), F.count("*").alias("size")).where("size > 1")
    edges = banded.join(shared, "band").where("class != least").select("least", "class").distinct()
    tied = components(edges)
    return tied.select(F.col("node").alias("class"), F.col("root").alias("cluster")).union(
        tied.select("root", "root").distinct())


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of two lists have a Jaccard similarity of ``percent`` or more."""
    sides = [left, right]
    owners = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in sides]
    values = [np.concatenate(side) for side in sides]
    # Only shingles that both sides hold count.
    common = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    places = [np.searchsorted(common, v) for v in values]
    for number in range(2):
        places[number][places[number] == len(common)] = 0
        inside = (common[places[number]] == values[number]) if len(common) else np.zeros(0, bool)
        owners[number], places[number] = owners[number][inside], places[number][inside]
    shared = np.zeros((len(left), len(right)))
    for start in range(0, len(common), COLUMNS):
        parts = []
        for side, owner, place in zip(sides, owners, places, strict=True):
            part = np.zeros((len(side), min(COLUMNS, len(common) - start)), np.float32)
            inside = (place >= start) & (place < start + COLUMNS)
            part[owner[inside], place[inside] - start] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    sizes = np.add.outer([len(s) for s in left], [len(s) for s in right])
    return 100 * shared >= percent * (sizes - shared)


def forest(links: np.ndarray) -> np.ndarray:
    """The least node that each node of a symmetric matrix reaches."""
    roots = np.arange(len(links))
    links = links | np.eye(len(links), dtype=bool)
    while True:
        lower = np.where(links, roots[None, :], len(links)).min(axis=1)
        lower = lower[lower]
        if (lower == roots).all():
            return roots
        roots = lower


def _confirm(rows: Iterable[tuple], percent: int) -> Iterator[tuple]:
    """Edges that join what is linked in each sorted run of (cluster, low, high) rows."""
    for (_, low, high), group in groupby(rows, key=itemgetter(0, 1, 2)):
        names: list[bytes] = []
        blocks: list[int] = []
        sets: list[np.ndarray] = []
        for *_, block, name, shingles in group:
            if not names or names[-1] != name:  # several tasks may have met rows of one text
                names.append(name)
                blocks.append(block)
                sets.append(np.frombuffer(shingles, np.uint64))
        first = [i for i, block in enumerate(blocks) if block == low]
        second = [i for i, block in enumerate(blocks) if block == high]
        if not first or not second or len(names) < 2:
            continue
        links = np.zeros((len(names), len(names)), bool)
        found = linked([sets[i] for i in first], [sets[i] for i in second], percent)
        links[np.ix_(first, second)] = found
        links[np.ix_(second, first)] |= found.T
        for node, root in enumerate(forest(links).tolist()):
            if node != root:
                yield names[root], names[node]


def confirmed_edges(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges between linked classes, whose components are those of all links.

    ``members`` has class, cluster, doc_id and text_hash (of one of its documents) and n_shingles.
    A document is found again by both, so rows without or with one doc_id do not meet each other;
    rows equal in both have one text, of which a task makes one set. The
    classes of a cluster are dealt to blocks of a bounded number of shingles, and each pair
    of blocks is a unit of work, so a cluster of any size spreads over tasks. Only edges
    that join what is linked leave a task, not all pairs.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = members.groupBy("cluster").agg(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = members.join(blocks, "cluster").select(
        F.col("doc_id").alias("member_id"), F.col("text_hash").alias("member_hash"), "class", "cluster",
        "blocks",
        F.pmod(F.xxhash64("class"), "blocks").cast("int").alias("block"))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("member_id")) & (F.col("text_hash") == F.col("member_hash"))
    chosen = texts.join(placed, same).select("cluster", "block", "blocks", "class", "text")

    def make_sets():
        hashes = WordHashes()
        done: set[bytes] = set()

        def work(source):
            for cluster, block, blocks, name, text in source:
                if name in done:
                    continue
                shingles = shingle_set(hashes.of(plain_words(text)), size)
                if len(shingles) and class_of(shingles) == name:
                    done.add(name)
                    yield cluster, block, blocks, name, shingles.tobytes()
        return work

    sets = map_rows(
        chosen, "cluster binary, block int, blocks int, class binary, shingles binary", make_sets)
    other = F.col("other")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", other).alias("low"), F.greatest("block", other).alias("high"),
        "block", "class", "shingles")
    dealt = pairs.repartition(tasks, "cluster", "low", "high").sortWithinPartitions(
        "cluster", "low", "high", "class")
    return map_rows(dealt, "u binary, v binary", lambda: lambda rows: _confirm(rows, percent))


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles and root, the group of near duplicates, of every row.

    A row without shingles has no root.
    """
    signed = stage(signatures(docs, size), "signatures")
    classes = stage(signed.where("n_shingles > 0").groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("member"),
        F.min("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")).select(
            "class", "member.doc_id", "member.text_hash", "n_shingles", "bands"), "classes")
    members = coarse_groups(classes).join(
        classes.select("class", "doc_id", "text_hash", "n_shingles"), "class")
    roots = components(confirmed_edges(docs, members, size, percent))
    return signed.select("doc_id", "text_hash", "n_shingles", "class").join(
        roots.select(F.col("node").alias("class"), "root"), "class", "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("root", "class").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Documents whose sets of distinct ``size``-word shingles have a Jaccard similarity of
    ``percent`` or more are linked; component_id is the smallest doc_id reachable and the
    row that has it is kept. A null or empty text, or one without words, has no shingles and
    is linked with nothing. Rows that repeat a doc_id are judged each by its text. A null
    doc_id never is the smallest, unless its component has no other. Shingles are compared
    as 64-bit hashes, sets of equal documents as 128-bit digests.
    """
    marked = grouped(docs, size, percent)
    # Stored, so that the join can split a component with very many documents.
    least = stage(marked.where("root IS NOT NULL").groupBy("root").agg(
        F.min("doc_id").alias("least")), "least")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return marked.join(least, "root", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, and all rows that are in none.

    Rows are told apart by doc_id and text. The row of the smallest doc_id stays, null after
    all others; of different texts under it that of the smallest text hash; of rows equal in
    both, any one. Rows without words are like nothing and all stay.
    """
    rows = stage(grouped(docs, size, percent).where("root IS NOT NULL").groupBy(
        "root", "doc_id", "text_hash").agg(F.count("*").alias("copies")), "rows")
    # Stored, so that the join can split a component with very many documents.
    first = stage(rows.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")), "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (
        F.col("text_hash") == F.col("first.text_hash"))
    taken = stage(rows.join(first, "root").select(
        F.col("doc_id").alias("_row_id"), F.col("text_hash").alias("_row_hash"), "copies",
        stays.alias("stays")).where("NOT stays OR copies > 1").drop("copies"), "duplicates")
    same = F.col("doc_id").eqNullSafe(F.col("_row_id")) & (
        F.xxhash64("text") == F.col("_row_hash"))
    rest = docs.join(taken.drop("stays"), same, "left_anti")
    repeated = taken.where("stays").drop("stays")
    if repeated.isEmpty():
        return rest
    once = docs.join(repeated, same).dropDuplicates(["_row_id", "_row_hash"])
    return rest.union(once.select(*docs.columns))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) > 4 THEN words[i + 1 : i + 4] ELSE words END AS shingle
  FROM d, unnest(range(greatest(len(words) - 3, 1))) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
  WHERE 100 * k >= 80 * (sx.n + sy.n - k)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION
  SELECT reached.doc_id, edges.y FROM reached JOIN edges ON reached.other = edges.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
LEFT JOIN sizes USING (doc_id)
"""
