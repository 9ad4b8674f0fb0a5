"""Multi-index hashing against the cosine of all pairs."""

import numpy as np
import pytest

from salesmart.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def exact(rows, k, every):
    ids = np.array([key for key, _ in rows])
    vectors = np.array([vector for _, vector in rows], np.float64)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        scores = unit @ unit[at]
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if ids[i] != ids[at]][:k]
        out[int(ids[at])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def found(df):
    out = {}
    for row in df.orderBy("query_id", "rank").collect():
        out.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert row["rank"] == len(out[row["query_id"]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(key, [float(x) for x in v] if v is not None else None, 0, 9)
                                  for key, v in rows], SCHEMA)


def test_recall_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 500)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 15)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(row["vec_id"], row["embedding"]) for row in df.collect()], 5, 50)
    got = found(ann.nearest(df))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for query, near in got.items():
        scores = dict(want[query])
        assert len(near) == 5
        for key, score in near:
            if key in scores:
                assert score == pytest.approx(scores[key], abs=1e-12)


def test_copies_and_ties_go_to_smaller_ids(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(30, 8)).astype(np.float32)
    rows = [(key, base[0] if key % 3 else base[key % 30]) for key in range(300)]
    rows += [(5, base[0]), (1000, -base[1])]
    got = found(ann.nearest(frame(spark, rows), every=50))
    want = exact(sorted({(key, tuple(v.tolist())) for key, v in rows}), 5, 50)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {
        q: [i for i, _ in near] for q, near in want.items()}


def test_vectors_without_direction_take_no_part(spark):
    rows = [(0, [1, 0]), (1, [1, 1]), (2, None), (3, [0, 0]), (4, [float("nan"), 1]),
            (50, [float("inf"), 1]), (5, [1, 0, 0]), (6, []), (100, [0, 1])]
    df = frame(spark, rows).union(spark.createDataFrame(
        [(7, [None, 1.0], 0, 0), (None, [1.0, 0.0], 0, 0)], SCHEMA))
    got = found(ann.nearest(df))
    assert {q: [i for i, _ in near] for q, near in got.items()} == {0: [1, 100], 100: [1, 0]}
    assert ann.nearest(df.limit(0)).collect() == []
    assert ann.nearest(df.where("vec_id = 3")).collect() == []
    assert ann.nearest(df.where("vec_id = 0")).collect() == []


def test_probing_finds_every_code_within_the_radius():
    draw = np.random.default_rng(2)
    codes = draw.integers(0, 256, (500, ann.BYTES), dtype=np.uint8)
    codes[1:60] = codes[0]
    for row in range(1, 60):
        bits = draw.choice(ann.BITS, row, replace=False)
        flips = np.zeros(ann.BITS, np.uint8)
        flips[bits] = 1
        codes[row] ^= np.packbits(flips)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 15, 16, 17, 40, 57):
        want = np.flatnonzero(ann.hamming(codes, codes[0]) <= radius)
        assert index.within(codes[0], radius).tolist() == want.tolist()
    assert len(index.candidates(codes[200], 0, 6)) >= 6


def test_every_length_is_searched(spark, monkeypatch):
    """Lengths of few and of many vectors, each among itself; one vec_id may have several vectors."""
    monkeypatch.setattr(ann, "FEW_ROWS", 60)
    monkeypatch.setattr(ann, "SHARD_ROWS", 50)
    draw = np.random.default_rng(4)
    rows = {length: [(key, draw.normal(size=length).astype(np.float32)) for key in range(count)]
            for length, count in ((3, 200), (8, 150), (5, 40), (2, 7), (9, 1))}
    got = {}
    df = frame(spark, [row for some in rows.values() for row in some])
    for row in ann.nearest(df).collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    for query in (0, 50, 100, 150):
        scores = []
        for some in rows.values():
            if query < len(some):
                vector = some[query][1].astype(np.float64)
                for key, other in some:
                    other = other.astype(np.float64)
                    if key != query:
                        scores.append((key, vector @ other / np.linalg.norm(vector) / np.linalg.norm(other)))
        best = sorted(scores, key=lambda pair: (-pair[1], pair[0]))[:5]
        assert len(got[query]) == 5
        assert len({key for key, _ in got[query]} & {key for key, _ in best}) >= 4


def test_tiny_and_huge_components(spark):
    draw = np.random.default_rng(6)
    base = draw.normal(size=(120, 4))
    sizes = [1e-170, 1.0, 1e160, 1e-300, 1e300, 5e-320]
    schema = "vec_id long, embedding array<double>"
    rows = [(key, (base[key] * sizes[key % 5]).tolist()) for key in range(120)]
    got = found(ann.nearest(spark.createDataFrame(rows, schema)))
    want = exact([(key, vector.tolist()) for key, vector in enumerate(base)], 5, 50)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {
        q: [i for i, _ in near] for q, near in want.items()}
    for query, near in got.items():
        for (_, score), (_, other) in zip(near, want[query], strict=True):
            assert score == pytest.approx(other, abs=1e-12)
    tiny = spark.createDataFrame([(0, [5e-324, 0.0]), (1, [1e-320, 0.0])], schema)
    assert found(ann.nearest(tiny)) == {0: [(1, pytest.approx(1.0))]}


def test_only_names_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    units = []
    search = ann.map_rows
    monkeypatch.setattr(ann, "map_rows", lambda rows, *rest, **more: (
        units.append(rows.columns), search(rows, *rest, **more))[1])
    assert ann.nearest(df).count() == 200
    assert ["block", "file"] in units
