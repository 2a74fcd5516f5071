"""Whole reconciliations: stated cases, and random tables against the model."""

import random
from collections import Counter

import model
import pytest

from concordia import Options, reconcile
from concordia.operators.cells import COLUMNS


def found(result):
    return Counter(tuple(r[c] for c in COLUMNS) for r in result.discrepancies.collect())


def kinds(result):
    return Counter(r["discrepancy_type"] for r in result.discrepancies.collect())


MATCHES = {
    "timestamps": ("ID|TS", [("a1", "2024-03-01T08:00:00.250"), ("a2", "2024-03-02 09:00:00")], [("a1", "2024-03-01 08:00:00"), ("a2", "2024-03-02T09:00:00.999999")]),
    "booleans": ("ID|A|B", [("k1", "TRUE", "no"), ("k2", "y", "F")], [("k1", "yes", "N"), ("k2", "true", "f")]),
    "nulls": ("ID|A|B|C", [("k1", "NULL", "n/a", "")], [("k1", "None", "#N/A", "NaN")]),
    "numbers": ("ID|A|B|C", [("k1", "12.50", "7,000", "-0.0")], [("k1", "12.5", "7000.00", "0")]),
    "big integers": ("ID|A", [("k1", "98765432109876543210")], [("k1", "+98,765,432,109,876,543,210")]),
    "case of rows": ("ID|CITY", [("k1", "Oslo")], [("K1", "OSLO")]),
    "case of names": ("id|name", [("1", "x")], [("1", "x")]),
    "order": ("A|B", [("1", "x"), ("2", "y")], [("2", "y"), ("1", "x")]),
    "equal duplicates": ("A|B", [("1", "x")] * 3, [("1", "x")] * 3),
    "separators in data": ("A|B", [("a|b", "c\x01NULL")], [("a|b", "c\x01NULL")]),
    "unicode": ("A|B", [("Łódź", "東京")], [("łódź", "東京")]),
    "both empty": ("A|B", [], []),
}


@pytest.mark.parametrize("name", MATCHES)
def test_matching_tables_have_no_discrepancy(text_table, name):
    header, source, target = MATCHES[name]
    result = reconcile(text_table(header, source), text_table(header.upper(), target))
    assert result.settled and not result.discrepancies.collect()
    assert result.summary().first()["exact_matches"] == len(source)


STATED = {
    "uneven duplicates": ("ID|V", [("a1", "x"), ("a1", "x"), ("b2", "y")], [("a1", "x"), ("b2", "y")], ("ID",), {"DUPLICATE_COUNT_MISMATCH": 1, "DUPLICATE_IN_SOURCE": 1, "MISSING_IN_TARGET": 1}),
    "missing rows": ("ID|V", [("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("d", "4")], ("ID",), {"MISSING_IN_TARGET": 2, "MISSING_IN_SOURCE": 1}),
    "slashes in keys": ("ID|V", [("East/West", "1")], [("East West", "1")], ("ID",), {"KEY_VALUE_MISMATCH": 1}),
    "far numbers as keys": ("ID|V", [("100", "1")], [("150", "1")], ("ID",), {"MISSING_IN_TARGET": 1, "MISSING_IN_SOURCE": 1}),
    "near number in the fourth key": ("A|B|C|D", [("a", "b", "c", "100")], [("a", "b", "c", "150")], ("A", "B", "C", "D"), {"KEY_VALUE_MISMATCH": 1}),
    "best of two": ("K|A|B", [("k", "1", "2"), ("k", "3", "4")], [("k", "3", "9"), ("k", "1", "8")], ("K",), {"VALUE_MISMATCH": 2}),
    "thief": ("K|V", [("a-b", "1"), ("a b", "2")], [("a b", "3")], ("K",), {"VALUE_MISMATCH": 1, "MISSING_IN_TARGET": 1}),
    "one side empty": ("A|B", [("1", "2"), ("3", "4")], [], None, {"MISSING_IN_TARGET": 2}),
    "null keys": ("K|V", [(None, "1")], [("NULL", "2")], ("K",), {"VALUE_MISMATCH": 1}),
    "tiny number in an otherwise equal row": ("K|V", [("a", "0.000000001")], [("a", "0")], ("K",), {}),
    "tiny number in a differing row": ("K|V|W", [("a", "0.000000001", "x")], [("a", "0", "y")], ("K",), {"VALUE_MISMATCH": 2}),
}


@pytest.mark.parametrize("name", STATED)
def test_stated_cases(text_table, name):
    header, source, target, keys, expected = STATED[name]
    result = reconcile(text_table(header, source), text_table(header, target), Options(keys=keys))
    assert kinds(result) == expected
    if keys:
        assert found(result) == model.reconcile(header.split("|"), source, target, list(keys))


def test_full_rows_keep_original_cells(text_table):
    result = reconcile(text_table("ID|SUM|OK", [("q7", "4,321.7500", "TRUE")]), text_table("ID|SUM|OK", [("q7", "4321.76", "yes")]), Options(keys=("id",)))
    row = result.discrepancies.first()
    assert (row["source_value"], row["target_value"]) == ("4321.75", "4321.76")
    assert (row["full_source_row"], row["full_target_row"]) == ("q7|4,321.7500|TRUE", "q7|4321.76|yes")


def test_strict_parity_off_canonicalises_once(text_table):
    a, b = text_table("K|V", [("a", "0.000000001")]), text_table("K|V", [("a", "0")])
    assert kinds(reconcile(a, b, Options(keys=("K",), strict_parity=False))) == {"VALUE_MISMATCH": 1}


def test_without_normalisation_cells_differ_by_case(text_table):
    a, b = [("k", "Abc", "1")], [("k", "abc", "2")]
    result = reconcile(text_table("K|V|W", a), text_table("K|V|W", b), Options(keys=("K",), normalise=False))
    assert found(result) == model.reconcile(["K", "V", "W"], a, b, ["K"], normalise=False)


def test_one_sided_columns_are_ignored(text_table):
    result = reconcile(text_table("A|B|X", [("1", "2", "3")]), text_table("Y|B|A", [("9", "2", "1")]))
    assert (result.columns, result.only_source, result.only_target) == (["A", "B"], ["X"], ["Y"]) and result.settled


def test_errors(text_table):
    a = text_table("A|B", [("1", "2")])
    with pytest.raises(ValueError, match="no column name in common"):
        reconcile(a, text_table("C", [("1",)]))
    with pytest.raises(ValueError, match="no such common column"):
        _ = reconcile(a, text_table("A|B", [("1", "3")]), Options(keys=("NOPE",))).keys
    with pytest.raises(ValueError, match="collide"):
        reconcile(a.toDF("a", "A "), a)


def test_group_guard(text_table):
    rows = [("k", str(i)) for i in range(30)]
    options = Options(keys=("K",), max_group=20)
    with pytest.raises(Exception, match="max_group"):
        reconcile(text_table("K|V", rows), text_table("K|V", [("k", f"x{v}") for _, v in rows[:-1]]), options).discrepancies.collect()


@pytest.mark.parametrize("seed", range(5))
def test_random_tables_are_the_models(text_table, seed):
    rng = random.Random(seed)
    columns = ["K", "L", "M", "N", "V", "W"][: rng.choice([3, 4, 6])]
    keys = columns[: rng.choice([1, 2, 4])]
    keys = keys[: len(columns) - 1]
    pools = [["a/b", "a b", "A-B", "1.5", "15", "x", None, ""], ["1", "1.0", "101", "y", "Y", "0.000000001"], ["p", "q"], ["100", "150", "260", "z"], ["u", "U", "v", "2.675"], ["0", "0.0", "w"]]
    rows = lambda n: [tuple(rng.choice(p) for p in pools[: len(columns)]) for _ in range(n)]
    source = rows(40)
    target = rng.sample(source, 15) + rows(25)
    header = "|".join(columns)
    a, b = text_table(header, source).coalesce(1), text_table(header, target).coalesce(1)
    assert found(reconcile(a, b, Options(keys=tuple(keys)))) == model.reconcile(columns, source, target, keys)


def test_conservation(spark):
    """Rows are matched exactly, matched by key, or missing: nothing is lost between."""
    from concordia.catalogue import orders_diff

    s = orders_diff(spark, "/root/testdata/sf0.001").summary().first()
    assert s["source_rows"] == s["exact_matches"] + s["key_matches"] + s["only_in_source"]
    assert s["target_rows"] == s["exact_matches"] + s["key_matches"] + s["only_in_target"]


def test_typed_input_is_rendered(spark):
    df = spark.sql("select 1 as id, date'2024-01-02' as d, array(1, 2) as l, named_struct('x', 1) as s, cast(1.50 as decimal(5,2)) as m")
    other = spark.sql("select '1' as id, '2024-01-02' as d, '[1,2]' as l, '{\"x\":1}' as s, '1.5' as m")
    assert reconcile(df, other).settled


def test_stream(spark, tmp_path):
    from concordia.streaming import reconcile_stream

    source = tmp_path / "in"
    spark.createDataFrame([("a", "1"), ("b", "2")], "K string, V string").write.parquet(str(source))
    target = spark.createDataFrame([("a", "1"), ("b", "3")], "K string, V string")
    stream = spark.readStream.schema("K string, V string").parquet(str(source))
    q = reconcile_stream(stream, lambda batch: target, str(tmp_path / "out"), str(tmp_path / "check"), Options(keys=("K",)))
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["discrepancy_type"], r["composite_key"]) for r in rows] == [("VALUE_MISMATCH", "K=b")]
