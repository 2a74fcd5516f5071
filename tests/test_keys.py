"""Key detection."""

import pytest

from concordia.operators.keys import cell_class, detect_key, name_excluded, profile


@pytest.mark.parametrize(
    ("name", "out"),
    [("ORDER_ID", False), ("CORPORATE_ID", True), ("PRODUCTS", True), ("NAME_X", True), ("MY_NAME", True), ("SURNAMES", False), ("ROW_ID", True), ("ARROW_ID", False), ("EVENT_TS", True), ("REGION", False), ("DW_KEY", True), ("extract_no", True)],
)
def test_names(name, out):
    assert name_excluded(name) is out


def rows(spark, header, data):
    names = header.split("|")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "rid long, " + ", ".join(f"{n} string" for n in names)), names


def test_single_unique_column(spark):
    df, names = rows(spark, "AMOUNT|CODE|KIND", [(str(i), f"AB-{i}", "x") for i in range(40)])
    assert detect_key(df, names, "rid") == ["CODE"]


def test_shortest_prefix(spark):
    df, names = rows(spark, "REGION|YEAR|KIND", [(f"R{i % 10}", str(2000 + i // 10), "same") for i in range(100)])
    assert sorted(detect_key(df, names, "rid")) == ["REGION", "YEAR"]


def test_few_values_look_boolean(spark):
    df, names = rows(spark, "ID|LABEL", [("1", "one thing"), ("2", "another thing")])
    assert detect_key(df, names, "rid") == ["LABEL"]


def test_empty_table_and_fallback(spark):
    df, names = rows(spark, "A|B", [])
    assert detect_key(df, names, "rid") == ["A", "B"]
    df, names = rows(spark, "A|B", [("x", "y")] * 5)
    assert sorted(detect_key(df, names, "rid")) == ["A", "B"]


def test_profile_takes_the_first_fifty_cells(spark):
    data = [("2024-01-01 00:00:00",)] * 50 + [(f"C{i}",) for i in range(500)]
    df, names = rows(spark, "WHEN_", data)
    row = profile(df, names, "rid").first()
    assert (row["col_type"], row["n_rows"], row["n_unique"]) == ("timestamp", 550, 501)


def test_classes(spark):
    from pyspark.sql import functions as F

    cells = {"T": "boolean", "01/02/2024 10:00:00": "timestamp", "A_20240101.txt": "filename", "-5": "integer", "5.5": "decimal", "a1": "alphanumeric", "a_b": "alphabetic", "a b": "text", "1e5": "alphanumeric"}
    df = spark.createDataFrame([(c,) for c in cells], "c string").select("c", cell_class(F.col("c")).alias("k"))
    assert {r["c"]: r["k"] for r in df.collect()} == cells
