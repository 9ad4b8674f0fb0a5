"""Benchmark windows against a search place by place."""

import hashlib
import random
import re

from salesmart.llm import decontaminate

WORD = re.compile(decontaminate.WORD)


def words(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return WORD.findall(lower)


def expected(docs, items):
    windows = {}
    for item, text in items:
        found = words(text)
        for start in range(max(len(found) - 10, 0) + 1 if found else 0):
            windows.setdefault(tuple(found[start:start + 10]), set()).add(item)
    sizes = {len(window) for window in windows}
    out = []
    for key, text in docs:
        found, hit, listed = words(text), set(), set()
        for size in sizes:
            for start in range(len(found) - size + 1):
                held = windows.get(tuple(found[start:start + size]))
                if held:
                    hit |= set(range(start, start + size))
                    listed |= held
        ids = sorted(str(item) for item in listed if item is not None)
        out.append((key, len(found), len(hit), len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items):
    frames = (spark.createDataFrame(docs, "doc_id long, text string"),
              spark.createDataFrame(items, "item_id long, text string"))
    rows = [tuple(row) for row in decontaminate.contamination(*frames).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(rows, key=str) == expected(docs, items)
    return rows


def test_few_words_make_many_partial_matches(spark):
    draw = random.Random(5)
    some = [" ".join(draw.choices("abcd", k=draw.choice([0, 1, 3, 4, 7, 10, 11, 25]))) for _ in range(25)]
    items = list(enumerate(some)) + [(None, "x y z u v w x y z u v"), (3, some[2]), (90, None)]
    docs = [(i, " ".join(draw.choices("abcde", k=draw.choice([0, 2, 9, 30, 300])))) for i in range(60)]
    docs += [(1000, "So, X-Y z u/v w x! y Z u V."), (None, "nothing"), (1001, None), (1002, ""), (7, docs[7][1]),
             (8, "the same id, another text")]
    docs += [(2000 + i, " ".join(draw.choices("abcde", k=20)) + " " + text) for i, text in enumerate(some)]
    rows = check(spark, docs, items)
    assert any(row[5] for row in rows) and not all(row[5] for row in rows)


def test_letters_beyond_ascii_are_words_and_keep_their_case(spark):
    passage = "É été ñ ß 日本 one two three four five six"
    check(spark, [(1, f"x {passage}"), (2, f"x {passage.replace('É', 'é')}"), (3, passage.upper())], [(1, passage)])


def test_a_passage_in_many_documents_and_repeated(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"{i} {passage} and {passage} {i}") for i in range(300)] + [(999, " ".join(f"p{i}" for i in range(9)))]
    rows = check(spark, docs, [(1, passage), (2, passage), (3, passage + " more")])
    assert sum(row[5] for row in rows) == 300


def test_odd_rows(spark, odd_docs, no_docs, sf_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = decontaminate.contamination(odd_docs, items).collect()
    assert len(rows) == odd_docs.count() and not any(row["contaminated"] for row in rows)
    assert decontaminate.contamination(no_docs, items).collect() == []
    none = decontaminate.contamination(sf_docs, items.limit(0))
    assert none.count() == sf_docs.count() and none.where("contaminated").count() == 0
    left = decontaminate.remove_contaminated(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()


def test_no_python_in_the_plan(spark, sf_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = decontaminate.remove_contaminated(sf_docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
