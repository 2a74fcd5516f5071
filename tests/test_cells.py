"""Canonical cells and fuzzy keys against the model."""

import random

import pytest
from model import canonical as model_canonical
from model import fuzzy_form, verdict
from pyspark.sql import functions as F

from concordia.functions import canonical_pair, fuzzy_equal, fuzzy_key
from concordia.functions.canonical import canonical

CELLS = [
    "007", "1,2,3", "1,5", "-0", "-0.0", " 5 ", "1_000", "inf", "-Infinity", "1e400", "1d", "1.5f", "１２３", "9.87E-5", "1.23E+10", "12345678901234567890.5",
    "0.000000001", "1.9999999", "-0.0000001", "-nan", "2.675", "0.0000005", "TRUE", "Yes", "n", "NA", "#n/a", " null ", "2025-01-02T03:04:05.123456",
    "2025-01-02 03:04:05", "2025-01-02", "2025-13-02", "01/02/2025", "1.500", ".5", "5.", "+3", "9,876.5000", " yes　", "abc ", "", "0", "00", "0.0", "1e5", "--1",
    "1.2.3", "12345678901234567890", "9" * 60, "9" * 60 + ".0", "0.00001234", "0.1234567", "1e-7", "+.5", ".", "-", "1__0", "NaN", "１.５", "2025-99-99 99:99:99",
    "2101-01-01", " 2025-01-02 ", "t", "f", "None", "nat", "line\nbreak", "\x1cyes\x1d", "0.0001", "0.00009999", "123456789012345.6", "1234567890123456.7", None,
]


def cells(spark, values, **settings):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [(r["once"], r["twice"]) for r in df.select("i", canonical_pair(F.col("c"), **settings).alias("p")).select("i", "p.*").orderBy("i").collect()]


@pytest.mark.parametrize("places", [0, 2, 6])
def test_canonical_is_the_models(spark, places):
    rng = random.Random(places)
    values = CELLS + [f"{rng.choice(['', '-', '+'])}{rng.randrange(10 ** rng.randrange(1, 12))}.{rng.randrange(10 ** rng.randrange(1, 9)):0{rng.randrange(1, 9)}d}" for _ in range(300)]
    got = cells(spark, values, decimal_precision=places)
    for v, (once, twice) in zip(values, got, strict=True):
        assert (v, once) == (v, model_canonical(v, places=places))
        assert (v, twice) == (v, model_canonical(model_canonical(v, places=places), places=places))


def test_timestamp_precision(spark):
    values = ["2025-01-02T03:04:05.1", "2025-01-02 03:04:05.123456", "2025-01-02 03:04:05"]
    assert [a for a, _ in cells(spark, values, timestamp_precision=3)] == ["2025-01-02 03:04:05.100", "2025-01-02 03:04:05.123", "2025-01-02 03:04:05"]


def test_without_normalisation(spark):
    assert [a for a, _ in cells(spark, ["", " NaN ", "null", "TRUE", " x "], normalise=False)] == [None, None, "null", "TRUE", " x "]


def test_without_exact_floats_hard_numbers_stay_text(spark):
    got = cells(spark, ["2.675", "1e5", "0.0000005", "1.50"], decimal_precision=2, exact_floats=False)
    assert [a for a, _ in got] == ["2.675", "1e5", "0.0000005", "1.5"]


def test_plan_has_no_python_without_exact_floats(spark):
    df = spark.createDataFrame([("1",)], "c string").select(canonical(F.col("c"), exact_floats=False))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


KEYS = ["A/B", "a b", "A - B", "x_y", "X.Y", "(q)", "Q", "<null>", "N/A", "", "100", "150", "201", "1,000", "1.5", "15", "inf", "nan", "abcdefghij", "abcdefghijk", "abcdefghijklm", "ab", "abcd", None]


def test_fuzzy_form_is_the_models(spark):
    df = spark.createDataFrame(list(enumerate(KEYS)), "i int, c string").select("i", fuzzy_key(F.col("c")).alias("k"))
    assert [r["k"] for r in df.orderBy("i").collect()] == [fuzzy_form(k) for k in KEYS]


def test_fuzzy_equality_is_the_models(spark):
    pairs = [(a, b) for a in KEYS for b in KEYS]
    canonical_ = [(model_canonical(a), model_canonical(b)) for a, b in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(canonical_)], "i int, a string, b string")
    got = [r["v"] for r in df.select("i", fuzzy_equal(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    for p, c, g in zip(pairs, canonical_, got, strict=True):
        assert (p, g) == (p, verdict(*c)[0])


def test_cogroup_and_column_agree(spark):
    """The pairing of large groups and the expression for single pairs give one answer."""
    from concordia.operators.pairing import read_cell, similar_cells

    rng = random.Random(4)
    pool = [*CELLS, " 5 ", "77", "1_000", "1001", "１２", "15", "٣٤.５", "inf", "-inf", "nan", "abc", "A-B/C", "a b c d", "ab", "abcd", "x" * 40, "x" * 43, "100000", "100900", "1 0"]
    pairs = [(" 5 ", "77"), ("1_000", "1001"), ("１２", "15")] + [(rng.choice(pool), rng.choice(pool)) for _ in range(10_000)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").repartition(8)
    cols = [x.alias(f"{side}{k}") for side in "ab" for k, x in enumerate(read_cell(F.col(side)))]
    similar = similar_cells(100.0, 0.01)
    rows = df.select("i", fuzzy_equal(F.col("a"), F.col("b")).alias("v"), *cols).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert similar(tuple(r[f"a{k}"] for k in range(4)), tuple(r[f"b{k}"] for k in range(4))) == (r["v"] != "DIFFERENT"), pairs[r["i"]]
    assert {r["v"] for r in rows if r["i"] < 3} == {"FUZZY_NUMERIC"}
