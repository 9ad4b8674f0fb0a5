"""Run a registered query and its SQL, and bring both results into one comparable form."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    table = df.toArrow()
    return table.column_names, list(zip(*[c.to_pylist() for c in table.columns]))


def _norm(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def canonical(names: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    """Column names in order, and how often each exact row occurs."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(
        tuple(_norm(row[i]) for i in order) for row in rows)
