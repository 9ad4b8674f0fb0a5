"""Min-max hashing against a comparison of all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from salesmart.llm import neardup
from salesmart.llm.components import components as connect
from salesmart.llm.words import WordHashes, plain_words, shingle_set


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def components(texts, size, percent):
    """The smallest reachable key of every key, by all pairs that share a shingle."""
    sets = {key: shingles(text, size) for key, text in texts.items()}
    holders = defaultdict(list)
    parent = {key: key for key in sets}

    def root(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for key in sorted(sets):
        shared = Counter(other for shingle in sets[key] for other in holders[shingle])
        for other, count in shared.items():
            if 100 * count >= percent * (len(sets[key]) + len(sets[other]) - count):
                low, high = sorted((root(key), root(other)))
                parent[high] = low
        for shingle in sets[key]:
            holders[shingle].append(key)
    return {key: root(key) for key in sets}


def judged(docs, size=4, percent=80):
    return {row["doc_id"]: row for row in neardup.near_duplicates(docs, size, percent).collect()}


def drifting(seed, count):
    """Copies of copies, each a few words off, and texts that share a passage with them."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = draw.choices(words, k=150)
    texts = {}
    for key in range(count):
        if key % 3 == 0:
            texts[key] = " ".join(text[:75] + draw.choices(words, k=75))
            continue
        text = text[:]
        for _ in range(draw.choice([0, 1, 3])):
            text[draw.randrange(len(text))] = draw.choice(words)
        texts[key] = " ".join(text)
    return texts


def test_chains_of_near_copies_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2000)  # many blocks per cluster
    texts = drifting(1, 240)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = judged(docs)
    want = components(texts, 4, 80)
    assert {key: row["component_id"] for key, row in rows.items()} == want
    for key, row in rows.items():
        assert row["n_shingles"] == len(shingles(texts[key], 4))
        assert row["kept"] == (key == want[key])
    assert 1 < len(set(want.values())) < len(texts)


def test_a_link_at_exactly_the_threshold(spark):
    words = [f"w{i}" for i in range(12)]
    texts = {1: " ".join(words[:11]), 2: " ".join(words[:9] + ["x"]), 3: " ".join(words[:12])}
    # 8 shingles and 9: 1 and 3 share 8 of 9; 1 and 2 share 6 of 9.
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = judged(docs)
    assert {key: row["component_id"] for key, row in rows.items()} == components(texts, 4, 80)
    assert rows[3]["component_id"] == 1 and rows[2]["component_id"] == 2
    eighty = {1: " ".join(words[:8]), 2: " ".join(words[:7])}  # 4 of 5 shingles
    docs = spark.createDataFrame(list(eighty.items()), "doc_id long, text string")
    assert judged(docs)[2]["component_id"] == 1


def test_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count()
    by_key = {row["doc_id"]: row for row in rows}
    for key in (1, 2, 3):
        assert by_key[key]["n_shingles"] == 0
        assert by_key[key]["component_id"] == key and by_key[key]["kept"]
    assert by_key[None]["component_id"] is None and by_key[None]["kept"]
    assert [row["kept"] for row in rows if row["doc_id"] == 4] == [True, True]
    assert by_key[6]["n_shingles"] == 1
    assert neardup.near_duplicates(no_docs).collect() == []
    assert neardup.deduplicate(odd_docs).columns == odd_docs.columns


def test_deduplicate_keeps_one_of_each(spark, sf_docs):
    copies = sf_docs.union(sf_docs.withColumn("doc_id", sf_docs.doc_id + 10_000))
    texts = {row["doc_id"]: row["text"] for row in copies.collect()}
    want = components(texts, 5, 80)
    kept = {row["doc_id"] for row in neardup.deduplicate(copies).collect()}
    assert kept == {key for key, root in want.items() if key == root}


def test_deduplicate_judges_rows(spark):
    story, other, third, fourth = (
        " ".join(f"{name}{i}" for i in range(60)) for name in ("a", "b", "c", "d"))
    rows = [
        (1, story), (1, story), (1, story),  # equal rows
        (2, other), (2, story + " end"), (2, "unique words under a repeated key"),
        (None, third), (None, third), (None, third + " end"),  # no doc_id at all
        (None, other), (9, fourth), (9, fourth + " end"), (None, fourth),
        (5, ""), (5, ""), (None, None)]
    docs = spark.createDataFrame([(*row, "en") for row in rows], "doc_id long, text string, lang string")
    found = neardup.deduplicate(docs)
    assert found.columns == docs.columns
    kept = [(row["doc_id"], row["text"]) for row in found.collect()]
    names = {key: [text for k, text in kept if k == key] for key in (1, 2, 5, 9, None)}
    assert len(kept) == sum(map(len, names.values()))
    assert names[1] == [story]
    assert sorted(names[2]) == sorted([other, "unique words under a repeated key"])
    assert names[5] == ["", ""]
    assert len(names[9]) == 1 and names[9][0].startswith(fourth)
    assert sorted(names[None], key=str)[0] is None and len(names[None]) == 2
    assert any(text and text.startswith(third) for text in names[None])


def test_signature_estimates_similarity():
    hashes = WordHashes()
    factors, offsets = neardup._coefficients(512)
    draw = random.Random(3)
    words = [f"v{i}" for i in range(2000)]
    first = draw.choices(words, k=600)
    second = first[:420] + draw.choices(words, k=180)
    sets = [shingle_set(hashes.of(plain_words(" ".join(text))), 4) for text in (first, second)]
    exact = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    signatures = [neardup.signature(s, factors, offsets) for s in sets]
    assert np.mean(signatures[0] == signatures[1]) == pytest.approx(exact, abs=0.06)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    rows = connect(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {row["node"]: row["root"] for row in rows} == (
        {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)})
    assert connect(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rows_without_or_with_one_doc_id_do_not_meet(spark):
    """As many texts go to confirmation as there are classes, whatever the doc_ids."""
    texts = [" ".join(f"{'x' if i % 9 == k % 9 else 'w'}{k // 4}n{i}" for i in range(60)) for k in range(400)]
    seen = {}
    for name, key in (("own", lambda k: k), ("null", lambda k: None), ("one", lambda k: 7),
                      ("some", lambda k: k % 3 or None)):
        docs = spark.createDataFrame([(key(k), text) for k, text in enumerate(texts)] * 2,
                                     "doc_id long, text string")
        rows = neardup.grouped(docs, 4, 80).collect()
        assert len(rows) == 800
        roots = {}
        for row in rows:
            roots.setdefault(row["text_hash"], set()).add(bytes(row["root"]))
        assert all(len(found) == 1 for found in roots.values())
        seen[name] = {key: next(iter(found)) for key, found in roots.items()}
        signed = neardup.signatures(docs, 4).where("n_shingles > 0")
        members = signed.selectExpr("class", "doc_id", "text_hash", "n_shingles").dropDuplicates(
            ["class"]).selectExpr("*", "class AS cluster")
        edges = neardup.confirmed_edges(docs, members, 4, 80)
        assert edges.count() == 0
    assert seen["null"] == seen["own"] == seen["one"] == seen["some"]


def test_many_rows_without_doc_id(spark):
    """Rows without ids take about the time of rows with ids."""
    import time

    def seconds(key):
        docs = spark.range(3000).selectExpr(
            f"{key} AS doc_id",
            "array_join(transform(sequence(0, 59), i -> concat('w', i, 'n', id div 2, "
            "if(i = 7 AND id % 2 = 1, 'x', ''))), ' ') AS text")
        start = time.time()
        rows = neardup.near_duplicates(docs, 4, 80).collect()
        assert len(rows) == 3000
        return time.time() - start

    seconds("id")
    assert seconds("CAST(NULL AS BIGINT)") < 3 * seconds("id") + 5
