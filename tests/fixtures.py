"""Small raw tables, written as text the way the source files hold it."""

from __future__ import annotations

from salesmart.functions.cleaning import conform
from salesmart.sources.schemas import RAW_SCHEMAS

# The headers are those of the source files; the rows are invented.
TABLES = {
    "shippers": (["ShipperID", "CompanyName", "Phone"], [
        ("1", "Fast", "1-1"), ("2", "Slow", "NULL")]),
    "customers": (["CustomerID", "CompanyName", "Country", "Region", "PostalCode"], [
        ("AAA", "Alpha", "Chile", "NULL", "05021"),
        ("BBB", "Beta", "Chile", "South", "NULL"),
        ("CC1", "Twin", "NULL", "", "1"),
        ("CC2", "Twin", "NULL", "N/A", "2"),
        ("DDD", "Delta ", "Peru", "East", "3")]),
    "employees": (["EmployeeID", "LastName", "FirstName", "BirthDate", "HireDate", "Salary"], [
        ("1", "Stone", "Ann", "03/14/1961 0:00", "09/03/1990 0:00", "3107.25"),
        ("2", "Reed", "NULL", "bad", "1992-08-14", "n.a.")]),
    "categories": (["CategoryID", "CategoryName", "Description"], [
        ("1", "Drinks", "wet, cold"), ("2", "Chef's Choice", "dry")]),
    "suppliers": (["SupplierID", "CompanyName", "ContactName", "Country", "Phone"], [
        ("1", "North Farm", "Ida", "Norway", "5"), ("2", "South Farm", "NULL", "Spain", "NULL")]),
    "products": (
        ["ProductID", "ProductName", "SupplierID", "CategoryID", "UnitPrice", "UnitsInStock",
         "Discontinued"], [
            ("1", "Tea", "1", "1", "18.0000", "39", "0"),
            ("2", "Cake", "2", "2", "19", "NULL", "1"),
            ("3", "Rope", "9", "9", "5", "1", "NULL"),
            ("4", "Tea", "2", "1", "20", "1", "0")]),
    "orders": (
        ["OrderID", "CustomerID", "EmployeeID", "OrderDate", "ShippedDate", "ShipVia", "Freight"], [
            ("1", "AAA", "1", "1995-11-05", "1995-11-20", "1", "10"),
            ("2", "BBB", "1", "1995-11-07", "NULL", "1", "10"),
            ("3", "AAA", "2", "1996-01-09", "1996-01-10", "2", "3"),
            ("4", "CC1", "1", "1996-01-09", "1997-02-01", "2", "3"),
            ("5", "CC2", "1", "1996-03-31", "1996-04-01", "2", "3"),
            ("6", "BBB", "1", "1996-03-01", "bad", "1", "3"),
            ("7", "AAA", "1", "1996-03-01", "1996-03-02", "1", "3"),
            ("8", "CC1", "1", "1996-03-02", "1996-03-02", "1", "3"),
            ("20", "ZZZ", "1", "1996-03-02", "1996-03-02", "1", "3"),
            ("21", "NULL", "1", "1996-03-02", "1996-03-02", "1", "3"),
            ("22", "AAA", "9", "1996-03-02", "1996-03-02", "1", "3"),
            ("23", "AAA", "1", "bad", "1996-03-02", "1", "3"),
            ("24", "AAA", "1", "1996-03-02", "1996-03-02", "9", "3")]),
    "order_details": (["OrderID", "ProductID", "UnitPrice", "Quantity", "Discount"], [
        ("1", "1", "10", "1", "0"), ("2", "2", "10", "2", "0"),
        ("3", "1", "1.005", "1", "0"), ("3", "2", "0.125", "1", "0"),
        ("3", "4", "100", "3", "0.1"), ("4", "1", "50", "1", "0"),
        ("5", "3", "7", "1", "0"), ("6", "2", "270", "1", "0"),
        ("7", "1", "2", "2", "0.5"), ("8", "2", "50", "1", "0"),
        ("20", "1", "999", "1", "0"), ("21", "1", "999", "1", "0"),
        ("22", "1", "999", "1", "0"), ("23", "1", "999", "1", "0"),
        ("24", "1", "999", "1", "0"), ("1", "99", "999", "1", "0"),
        ("77", "1", "999", "1", "0")]),
}


def text_frame(spark, name):
    columns, rows = TABLES[name]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def raw_tables(spark):
    return {name: conform(text_frame(spark, name), RAW_SCHEMAS[name]) for name in TABLES}


def write_csv(folder, name):
    columns, rows = TABLES[name]
    quoted = [",".join('"' + v.replace('"', '""') + '"' for v in row) for row in rows]
    (folder / f"{name}.csv").write_text("\n".join([",".join(columns), *quoted]) + "\n")
