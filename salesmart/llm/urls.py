"""URL filters over sorted digest arrays.

An index holds, per shard of the digest space, a sorted array of 64-bit xxhash digests, the
keys themselves as bytes with offsets, and a value per key. Tasks map the files and probe
them with a vectorised binary search; a hit counts only if the stored key is the same string.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from salesmart.llm import sharedfs
from salesmart.llm.common import map_rows
from salesmart.sources.staging import work_folder

ALLOW, BLOCK = "allow", "block"

# Rules as (host, path, verdict).
RULES = [
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
]

# Hosts that the filter blocks, with their subdomains, where no rule fits.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org")]

#: Stands between host and path of a rule's key; neither a url's host nor its path can hold it.
MARK = "?"
#: Probe strings looked up at once.
PROBES = 1 << 16


#: The seed that Spark's own xxhash64 takes, so both sides of the build agree.
SEED = 42


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode(), SEED)


class Shard(NamedTuple):
    digests: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    def key(self, at: int) -> str:
        return self.keys[self.offsets[at]:self.offsets[at + 1]].tobytes().decode()


def build_index(entries: DataFrame, folder: str, bits: int = 4) -> str:
    """Write (key string, value tinyint) as ``2**bits`` shards; returns the folder.

    Repeated keys keep the smallest value; null keys are left out. A shard takes a range of
    digests, so shards are even whatever the keys; choose ``bits`` so that one fits a task.
    """
    sharedfs.make_folder(folder)
    shard_of = F.shiftrightunsigned(F.xxhash64("key"), 64 - bits) if bits else F.lit(0)
    unique = entries.where("key IS NOT NULL").groupBy("key").agg(F.min("value").alias("value"))
    dealt = unique.withColumn("shard", shard_of.cast("long")).repartition(1 << bits, "shard")

    def make():
        def work(rows):
            shards: dict[int, list[tuple[int, str, int]]] = {}
            for key, value, shard in rows:
                shards.setdefault(shard, []).append((digest(key), key, value))
            for shard, found in shards.items():
                found.sort()
                name = f"{shard:05d}-{uuid.uuid4().hex[:12]}"
                keys = [key.encode() for _, key, _ in found]
                ends = np.cumsum([0, *map(len, keys)])
                sharedfs.write_bytes(f"{folder}/{name}.digests", np.array(
                    [number for number, _, _ in found], "<u8").tobytes())
                sharedfs.write_bytes(f"{folder}/{name}.offsets", ends.astype("<u8").tobytes())
                sharedfs.write_bytes(f"{folder}/{name}.keys", b"".join(keys))
                sharedfs.write_bytes(f"{folder}/{name}.values", np.array(
                    [value for _, _, value in found], "u1").tobytes())
                yield shard, name
        return work

    # One row per shard comes back: 2**bits at most.
    written = map_rows(dealt.select("key", "value", "shard"), "shard long, name string", make).collect()
    names = {row["shard"]: row["name"] for row in written}
    sharedfs.write_bytes(f"{folder}/index.json", json.dumps(
        {"bits": bits, "names": names}).encode())
    return folder


class DigestIndex:
    """A written index, mapped into memory shard by shard on first use."""

    def __init__(self, folder: str):
        self.folder = folder
        described = json.loads(sharedfs.mapped(f"{folder}/index.json", "u1").tobytes())
        self.bits = described["bits"]
        self.names = {int(shard): name for shard, name in described["names"].items()}
        self.shards: dict[int, Shard] = {}

    def shard(self, number: int) -> Shard | None:
        if number not in self.names:
            return None
        if number not in self.shards:
            path = f"{self.folder}/{self.names[number]}"
            self.shards[number] = Shard(
                sharedfs.mapped(f"{path}.digests", "<u8"), sharedfs.mapped(f"{path}.offsets", "<u8"),
                sharedfs.mapped(f"{path}.keys", "u1"), sharedfs.mapped(f"{path}.values", "u1"))
        return self.shards[number]

    def find(self, probes: list[str]) -> list[int | None]:
        """The value of each probe, None if it is not a key."""
        found: list[int | None] = [None] * len(probes)
        digests = np.array([digest(probe) for probe in probes], np.uint64)
        numbers = digests >> np.uint64(64 - self.bits) if self.bits else np.zeros_like(digests)
        for number in np.unique(numbers).tolist():
            shard = self.shard(number)
            if shard is None:
                continue
            mine = np.flatnonzero(numbers == number)
            places = np.searchsorted(shard.digests, digests[mine])
            inside = places < len(shard.digests)
            mine, places = mine[inside], places[inside]
            equal = shard.digests[places] == digests[mine]
            for probe, place in zip(mine[equal].tolist(), places[equal].tolist(), strict=True):
                # Keys that share a digest stand side by side.
                while place < len(shard.digests) and shard.digests[place] == digests[probe]:
                    if shard.key(place) == probes[probe]:
                        found[probe] = int(shard.values[place])
                        break
                    place += 1
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def host_suffixes(host: str, longest: int) -> list[str]:
    """The host and its parent domains, as far as a key of ``longest`` characters can match."""
    suffixes, start = [], max(0, len(host) - longest)
    if start:
        dot = host.find(".", start - 1)
        start = dot + 1 if dot >= 0 else len(host)
    while host and start < len(host):
        suffixes.append(host[start:])
        dot = host.find(".", start)
        if dot < 0:
            break
        start = dot + 1
    return suffixes


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame, bits: int = 4) -> DataFrame:
    """Verdict of every url: the longest rule that fits, else whether its host is blocked.

    ``rules`` has host, path and verdict, ``blocked`` has host. A rule fits its host and all
    subdomains where the url's path starts with the rule's path; of two rules as long, that
    of the longer host wins; an empty or null path is the whole host. A null url or one without ``://`` has an empty host and path
    and is allowed; repeated rows are judged each; other columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    rules = rules.select(*[F.coalesce(name, F.lit("")).alias(name) for name in ("host", "path", "verdict")])
    shape = rules.agg(
        F.max(F.length("host")).alias("host"),
        F.sort_array(F.collect_set(F.length("path"))).alias("paths")).first()
    longest, lengths = shape["host"] or 0, shape["paths"]
    widest = blocked.agg(F.max(F.length("host"))).first()[0] or 0
    folder = f"{work_folder(spark)}/urls-{uuid.uuid4().hex}"
    rule_index = build_index(rules.select(
        F.concat("host", F.lit(MARK), "path").alias("key"),
        (F.col("verdict") == BLOCK).cast("tinyint").alias("value")), f"{folder}/rules", bits)
    block_index = build_index(blocked.select(
        F.col("host").alias("key"), F.lit(1).cast("tinyint").alias("value")),
        f"{folder}/blocked", bits)

    def make():
        rule_keys, block_keys = DigestIndex(rule_index), DigestIndex(block_index)

        def probes(host: str, path: str) -> Iterable[str]:
            for suffix in host_suffixes(host, longest):
                for length in lengths:
                    if length <= len(path):
                        yield suffix + MARK + path[:length]

        def answer(waiting):
            wanted = [probe for *_, candidates, _ in waiting for probe in candidates]
            values = iter(rule_keys.find(wanted))
            hosts = iter(block_keys.find([s for *_, suffixes in waiting for s in suffixes]))
            for page_id, host, path, candidates, suffixes in waiting:
                fits = [(len(rule), rule.index(MARK), rule.replace(MARK, "", 1), value)
                        for rule in candidates if (value := next(values)) is not None]
                listed = any([next(hosts) is not None for _ in suffixes])
                rule, value = max(fits)[2:] if fits else (None, int(listed))
                yield page_id, host, path, rule, BLOCK if value else ALLOW

        def work(rows):
            waiting, count = [], 0
            for page_id, url in rows:
                host, path = split_url(url)
                waiting.append((page_id, host, path, list(probes(host, path)),
                                host_suffixes(host, widest)))
                count += len(waiting[-1][3])
                if count >= PROBES or len(waiting) >= PROBES:
                    yield from answer(waiting)
                    waiting, count = [], 0
            if waiting:
                yield from answer(waiting)
        return work

    return map_rows(pages.select("page_id", "url"),
                    "page_id bigint, host string, path string, rule string, verdict string", make,
                    chunk=4096)


def default_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return rules, spark.createDataFrame([(host,) for host in BLOCKED_HOSTS], "host string")


_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
_HOST_ROWS = ", ".join(f"('{host}')" for host in BLOCKED_HOSTS)

ORACLE = rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
blocked(blocked_host) AS (VALUES {_HOST_ROWS}),
parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path
  FROM parts)
SELECT page_id, host, path, fit.rule AS rule,
  coalesce(fit.rule_verdict, CASE WHEN EXISTS (
    SELECT 1 FROM blocked WHERE host = blocked_host OR ends_with(host, '.' || blocked_host))
    THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN LATERAL (
  SELECT rule_host || rule_path AS rule, rule_verdict FROM rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC LIMIT 1) fit ON true
"""
