"""Versions of a warehouse: every load writes folders of its own, and a manifest says which count.

    root/<table>/load=<attempt>/...      what one attempt wrote
    root/_manifests/<number>.json        a version: the attempts of each table, and the loads done

A version appears by the rename of one small file, after all its tables are written. A reader sees
the last version that was published whole; what a broken attempt left is in no manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"
#: Partition column that tells attempts apart inside a table's folder.
ATTEMPT = "load"


class ConflictingLoad(RuntimeError):
    """Another load was published since this one began."""


class NoVersion(FileNotFoundError):
    """Nothing was published under the folder yet."""


@dataclass(frozen=True)
class Manifest:
    """One version: the attempts that make up each table, and what each load reported."""

    version: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    loads: dict[str, dict] = field(default_factory=dict)


def _files(spark: SparkSession, uri: str):
    """The Hadoop file system of a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, uri: str) -> list[str]:
    system, path = _files(spark, uri)
    return [status.getPath().getName() for status in system.listStatus(path)] if system.exists(path) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, in order."""
    names = _names(spark, f"{root.rstrip('/')}/{MANIFESTS}")
    return sorted(int(found[1]) for name in names if (found := re.fullmatch(r"(\d+)\.json", name)))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """A version's manifest, by default the last one's; an empty one if nothing was published."""
    published = versions(spark, root)
    if not published:
        return Manifest()
    version = published[-1] if version is None else version
    system, path = _files(spark, f"{root.rstrip('/')}/{MANIFESTS}/{version}.json")
    stream = system.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(version, **json.loads(text))


def publish(spark: SparkSession, root: str, after: Manifest, tables: dict[str, list[str]],
            loads: dict[str, dict]) -> Manifest:
    """Make the next version after ``after`` visible, in one step and only if none came between."""
    number = after.version + 1
    folder = f"{root.rstrip('/')}/{MANIFESTS}"
    system, draft = _files(spark, f"{folder}/.{number}-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(json.dumps({"tables": tables, "loads": loads}, sort_keys=True).encode())
    out.close()
    context = spark.sparkContext
    fs = context._jvm.org.apache.hadoop.fs
    target = fs.Path(f"{folder}/{number}.json")
    never_over = context._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        # A plain rename replaces the target in some file systems; this one does in none.
        fs.FileContext.getFileContext(
            system.makeQualified(target).toUri(), context._jsc.hadoopConfiguration()
        ).rename(system.makeQualified(draft), system.makeQualified(target), never_over)
    except Py4JJavaError as error:
        system.delete(draft, False)
        if system.exists(target):
            raise ConflictingLoad(f"version {number} of {root} was published by another load") from error
        raise
    return Manifest(number, tables, loads)


def new_attempt() -> str:
    """A name that no other attempt has; the letter keeps it a text in partition columns."""
    return f"a{uuid.uuid4().hex}"


def attempt_path(root: str, name: str, attempt: str) -> str:
    return f"{root.rstrip('/')}/{name}/{ATTEMPT}={attempt}"


def read_attempts(spark: SparkSession, root: str, name: str, attempts: list[str]) -> DataFrame:
    """The rows that some attempts wrote to a table."""
    if not attempts:
        raise NoVersion(f"no published table {name} under {root}")
    return spark.read.option("basePath", f"{root.rstrip('/')}/{name}").parquet(
        *[attempt_path(root, name, attempt) for attempt in attempts]).drop(ATTEMPT)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete the folders that none of the last ``keep`` versions holds, and older manifests.

    Not to be run beside a load: what it is writing is in no manifest yet.
    """
    published = versions(spark, root)
    held = [manifest(spark, root, number) for number in published[-max(1, keep):]]
    deleted = []
    for name in _names(spark, root):
        if name == MANIFESTS:
            gone = [f"{number}.json" for number in published[:-max(1, keep)]]
        else:
            used = {f"{ATTEMPT}={attempt}" for version in held for attempt in version.tables.get(name, [])}
            gone = [child for child in _names(spark, f"{root}/{name}")
                    if child.startswith(f"{ATTEMPT}=") and child not in used]
        for child in gone if held else []:
            system, path = _files(spark, f"{root}/{name}/{child}")
            system.delete(path, True)
            deleted.append(f"{name}/{child}")
    return sorted(deleted)
