"""CSV files cut into many byte ranges, against the parser that takes them whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from salesmart.sources import quoted_csv, readers


@pytest.fixture
def small_splits(spark):
    """Byte ranges of a few hundred bytes, so that records cross several of them."""
    before = {key: spark.conf.get(key, None) for key in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def whole(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option(
        "quote", '"').option("escape", '"').csv(path)


def rows_of(df):
    return sorted(map(str, df.collect()))


def messy(seed, rows, end="\n"):
    """Fields with line breaks, doubled quotes, commas, stray quotes inside, empty fields and lines."""
    draw = random.Random(seed)
    out = io.StringIO()
    out.write(f"id,name,note,last{end}")
    for number in range(rows):
        fields = []
        for _ in range(3):
            text = "".join(draw.choice(["a", "é", ",", '"', "\n", " ", "xyz", "\n\n"]) for _ in range(
                draw.choice([0, 1, 3, 8, 8, 300 if draw.random() < 0.05 else 5])))
            if draw.random() < 0.4:
                # Unquoted: no break, no comma, and no quote at its start; quotes inside mean nothing.
                text = "q" + text.replace(",", "").replace("\n", "")
                fields.append(text)
            else:
                fields.append('"' + text.replace('"', '""') + '"')
        out.write(",".join([str(number), *fields]) + end)
        if draw.random() < 0.05:
            out.write(end)
    return out.getvalue()


@pytest.mark.parametrize("seed, size, end", [(1, 300, "\n"), (2, 64, "\n"), (3, 500, "\r\n")])
def test_equals_the_whole_parse(spark, tmp_path, small_splits, seed, size, end):
    path = tmp_path / "t.csv"
    path.write_bytes(messy(seed, 250, end).encode())
    want = whole(spark, str(path))
    small_splits(size)
    got = quoted_csv.read_quoted_csv(spark, str(path))
    assert got.columns == want.columns
    assert rows_of(got) == rows_of(want)
    ids = sorted(int(row.id) for row in got.collect())
    assert ids == list(range(250))


def test_parsed_by_many_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text(messy(7, 400))
    small_splits(800)
    lines = quoted_csv.line_table(spark, str(path))
    assert lines.select(F.spark_partition_id()).distinct().count() > 10
    found = quoted_csv.records(spark, str(path))
    assert found.groupBy("start").count().count() > 10
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan


def test_folder_of_files(spark, tmp_path, small_splits):
    for number in range(3):
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / f"{number}.csv").write_text(messy(20 + number, 60))
    want = whole(spark, str(tmp_path / "t"))
    small_splits(200)
    assert rows_of(quoted_csv.read_quoted_csv(spark, str(tmp_path / "t"))) == rows_of(want)


def test_reader_takes_large_files_in_ranges(spark, tmp_path, small_splits):
    rows = [[str(n), f"Name {n}", f'House {n}\n"The ""{n}""", Road', "x"] for n in range(80)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["SupplierID", "CompanyName", "Address", ""], *rows])
    path = tmp_path / "suppliers.csv"
    path.write_text(out.getvalue())
    want = readers.read_csv_table(spark, str(path), "suppliers")
    small_splits(400)
    got = readers.read_csv_table(spark, str(path), "suppliers")
    assert rows_of(got) == rows_of(want)
    assert {r.supplierid: r.address for r in got.collect()} == {int(a): c for a, _, c, _ in rows}


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('a,"b', True, False), ('a"b', False, False), ('"a""', True, False),
    ('"a"', False, False), ('x"', False, False), ('","', False, True), ('a,"b","c', True, True),
    ('b","c', True, True), ('""', False, True), ('"",""', False, True), (',"', True, False),
    ('"a"b"c', False, False), ('say "hi", ok', False, False), ('",', True, False), ('a""', False, True)])
def test_states_of_a_line(spark, line, outside, inside):
    """A quote that no delimiter follows ends the quotes as well, as in the parser."""
    df = spark.createDataFrame([(line,)], "text string")
    got = df.select(F.col("text").rlike(quoted_csv.OPEN_AFTER_OUTSIDE),
                    F.col("text").rlike(quoted_csv.OPEN_AFTER_INSIDE)).first()
    assert tuple(got) == (outside, inside)
