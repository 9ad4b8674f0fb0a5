import datetime
from types import SimpleNamespace

import fixtures
import pytest
from pyspark.errors import AnalysisException

from salesmart.sources import readers, sinks, staging
from salesmart.sources.schemas import RAW_SCHEMAS, SOURCE_FILES


@pytest.fixture
def folder(tmp_path):
    for name in fixtures.TABLES:
        fixtures.write_csv(tmp_path, name)
    return tmp_path


def test_extract_folder(spark, folder):
    raw = readers.extract(spark, str(folder))
    assert raw.keys() == RAW_SCHEMAS.keys() == SOURCE_FILES.keys()
    for name, df in raw.items():
        assert df.schema.names == RAW_SCHEMAS[name].names
        assert [f.dataType for f in df.schema] == [f.dataType for f in RAW_SCHEMAS[name]]
        assert df.count() == len(fixtures.TABLES[name][1])
    customers = {r.customerid: r for r in raw["customers"].collect()}
    assert customers["AAA"].postalcode == "05021"
    assert customers["AAA"].region is None and customers["BBB"].postalcode is None
    assert customers["DDD"].companyname == "Delta "
    assert customers["AAA"].fax is None


def test_extract_parquet(spark, folder, tmp_path):
    for name in SOURCE_FILES:
        fixtures.text_frame(spark, name).write.parquet(str(tmp_path / "pq" / name))
    files = {name: name for name in SOURCE_FILES}
    raw = readers.extract(spark, str(tmp_path / "pq"), files, fmt="parquet")
    csv = readers.extract(spark, str(folder))
    for name in SOURCE_FILES:
        assert sorted(map(str, raw[name].collect())) == sorted(map(str, csv[name].collect()))


def test_quoted_line_break_and_extra_column(spark, tmp_path):
    (tmp_path / "employees.csv").write_text(
        'EmployeeID,LastName,FirstName,Address,\n'
        '1,Stone,Ann,"House 1\nRoad ""B""", \n'
        '2,Reed,Bob,NULL,\n')
    rows = readers.read_csv_table(
        spark, str(tmp_path / "employees.csv"), "employees").orderBy("employeeid").collect()
    assert [r.address for r in rows] == ['House 1\nRoad "B"', None]
    assert rows[0].reportsto is None and rows[0].salary is None


def test_columns_match_by_name_not_position(spark, tmp_path):
    (tmp_path / "shippers.csv").write_text("Phone,ShipperID,CompanyName\n55,3,Fast\n")
    df = readers.read_csv_table(spark, str(tmp_path / "shippers.csv"), "shippers")
    assert df.first() == (3, "Fast", "55")


def test_missing_file_stops(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.extract(spark, str(tmp_path))


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown source format"):
        readers.extract(spark, str(tmp_path), fmt="xml")


def test_load_skips_nothing_to_write(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    assert sinks.load_table(None, str(tmp_path), "dim_date") is False
    assert sinks.load_table(df.filter("a > 1"), str(tmp_path), "dim_date") is False
    assert not (tmp_path / "dim_date").exists()
    assert sinks.load_table(df, str(tmp_path), "dim_date") is True


def test_load_modes(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    for mode, rows in (("overwrite", 1), ("overwrite", 1), ("append", 2), ("overwrite", 1)):
        sinks.load_table(df, str(tmp_path), "dim_date", mode)
        assert sinks.read_table(spark, str(tmp_path), "dim_date").count() == rows


def test_stage_round_trip(spark):
    df = spark.createDataFrame([(1, datetime.date(2020, 1, 1), None)], "a int, d date, s string")
    stored = staging.stage(df, "round-trip")
    assert stored.schema == df.schema
    assert stored.collect() == df.collect()
    assert staging.stage(df.filter("a > 1"), "empty").collect() == []


def test_shared_folder_follows_the_setting():
    def folder(**settings):
        conf = SimpleNamespace(get=lambda key, default=None: settings.get(key.split(".")[-2], default))
        return staging.shared_folder(SimpleNamespace(conf=conf))

    assert folder(checkpoint="hdfs://x/work/", warehouse="file:/w") == "hdfs://x/work"
    assert folder(warehouse="hdfs://x/warehouse") == "hdfs://x/warehouse/_staged"


def test_lines_are_read_in_parts(spark, tmp_path):
    assert set(readers.LINE_TABLES) == {"orders", "order_details"}
    (tmp_path / "employees.csv").write_text('EmployeeID,Address\n1,"one\ntwo"\n')
    assert readers.read_csv_table(spark, str(tmp_path / "employees.csv"), "employees").first().address == "one\ntwo"
    fixtures.write_csv(tmp_path, "orders")
    plan = readers.read_csv_table(spark, str(tmp_path / "orders.csv"), "orders")
    assert plan.count() == len(fixtures.TABLES["orders"][1])
