"""URL verdicts: parsing, rules, digests and collisions."""

import pytest

from salesmart.llm import urls

CASES = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/x", "", "", None, "allow"),
    ("http://A.B.Org", "a.b.org", "", None, "allow"), ("http://ORG/", "org", "/", "org/", "allow"),
    ("x://sub.Example.ORG/es/1?x=/en/1", "sub.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/123#top", "example.org", "/en/123", "example.org/en/1", "block"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://example.org/EN/1", "example.org", "/EN/1", "org/", "allow"),
    ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"), ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    ("http://x.com?u=http://y.org/es/", "x.com", "", None, "allow"), ("http://x.com#/de/", "x.com", "", None, "allow"),
    ("https://www.free-bets.example.com/en/1", "www.free-bets.example.com", "/en/1", None, "block"),
    ("https://free-bets.example.com/fr/1", "free-bets.example.com", "/fr/1", "com/fr/", "allow"),
    ("https://xfree-bets.example.com/", "xfree-bets.example.com", "/", None, "allow"),
    ("http://user@h.net:80/p//q?", "user@h.net:80", "/p//q", None, "allow"), ("http://É.Net/É", "É.net", "/É", None, "allow"),
    ("http://" + "a." * 20_000 + "org/" + "x" * 50_000, "a." * 20_000 + "org", "/" + "x" * 50_000, "org/", "allow"),
]


def test_cases(spark):
    pages = spark.createDataFrame(
        [(key, case[0], "x", "rule") for key, case in enumerate(CASES)],
        "page_id long, url string, host string, rule string")
    rows = urls.judge(pages.union(pages), *urls.default_rules(spark)).collect()
    assert len(rows) == 2 * len(CASES)
    for row in rows:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == CASES[row["page_id"]][1:]
    assert urls.judge(pages.limit(0), *urls.default_rules(spark)).collect() == []


def test_empty_and_repeated_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules, hosts = urls.default_rules(spark)
    assert urls.judge(pages, rules.limit(0), hosts.limit(0)).first()["verdict"] == "allow"
    twice = spark.createDataFrame([("b", "/", "allow"), ("b", "/", "block"), ("b", "/c", "block"), (None, "/", "block")],
                                  rules.schema)
    assert urls.judge(pages, twice, hosts).first()["rule"] == "b/c"


@pytest.mark.parametrize("bits", [0, 3])
def test_index_confirms_keys(spark, tmp_path, monkeypatch, bits):
    keys = [f"host{i}.example" for i in range(300)] + ["é", ""]
    entries = spark.createDataFrame([(key, i % 7) for i, key in enumerate(keys)], "key string, value tinyint")
    folder = urls.build_index(entries.union(entries), f"file://{tmp_path}/index", bits)
    index = urls.DigestIndex(folder)
    probes = keys + [key + "x" for key in keys]
    assert index.find(probes) == [i % 7 for i in range(len(keys))] + [None] * len(keys)
    # A probe that has another key's digest is no hit.
    real = urls.digest
    monkeypatch.setattr(urls, "digest", lambda key: real("host5.example") if key == "other" else real(key))
    assert urls.DigestIndex(folder).find(["other", "host5.example"]) == [None, 5]


def test_rules_of_any_shape(spark):
    """Rules for whole hosts, and hosts and paths that read alike when put together."""
    pages = spark.createDataFrame([
        (1, "http://a.org/x"), (2, "http://a.org"), (3, "http://ab/c"), (4, "http://a/b/c"), (5, "http://z.ab/c"),
        (6, "http://q/"), (7, "no url")], "page_id long, url string")
    rules = spark.createDataFrame([
        ("a.org", "", "block"), ("a.org", "/x", "allow"), ("ab", "/", "block"), ("a", "/b/", "allow"),
        ("q", None, "block"), ("", "", "block"), (None, None, "block"), ("a", "b/", "block")],
        "host string, path string, verdict string")
    found = {row["page_id"]: (row["rule"], row["verdict"])
             for row in urls.judge(pages, rules, urls.default_rules(spark)[1]).collect()}
    assert found == {
        1: ("a.org/x", "allow"), 2: ("a.org", "block"), 3: ("ab/", "block"), 4: ("a/b/", "allow"),
        5: ("ab/", "block"), 6: ("q", "block"), 7: (None, "allow")}
