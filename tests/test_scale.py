"""Steps that must not grow faster than their input: which side a join sends around, how rows are dealt, compiled cells."""

import pytest
from model import canonical as model_canonical
from pyspark.sql import functions as F
from test_cells import CELLS

from concordia import Options
from concordia.operators import bag
from concordia.operators.align import HASH, ONCE, RID, TWICE, prepared
from concordia.staging import stage

MORE = CELLS + ["1-URGENT", "N", "F", "Index", "inf,", "i,nf", "12.50", "0.05", "0.00", "-7.00", "-0.50", "0.00001", "5\n", "word ", " word", "2025-01-02T03:04:05", "A", "x y", "4-TEN", "7E5", "é", "Zoë", "-12", "99"]


@pytest.mark.parametrize("width", [3, 20])
def test_cells_of_narrow_and_wide_tables_are_the_models(spark, width):
    n = len(MORE)
    columns = [f"C{i}" for i in range(width)]
    df = spark.createDataFrame([(j, *[MORE[(j + 7 * i) % n] for i in range(width)]) for j in range(n)], "J int, " + ", ".join(f"{c} string" for c in columns))
    got = prepared(df.repartition(3).orderBy("J").drop("J"), columns, Options()).orderBy(RID).collect()
    for j, r in enumerate(got):
        for i, c in enumerate(columns):
            v = MORE[(j + 7 * i) % n]
            assert (v, r[ONCE][c], r[TWICE][c]) == (v, model_canonical(v), model_canonical(model_canonical(v)))


def test_rules_in_full_are_left_to_few_rows(spark):
    df = spark.createDataFrame([("2024-01-05 10:20:30", "1-URGENT", "12.50", "7", "N", None)], "a string, b string, c string, d string, e string, f string")
    from concordia.functions.canonical import canonical_cells

    read, _, _ = canonical_cells(df, df.columns)
    assert "__c_once0" in read.columns  # cells of narrow tables are columns of their own, compiled
    assert "Arrow" in read._jdf.queryExecution().executedPlan().toString()


def test_order_keeps_its_ranges_where_rows_repeat(spark):
    """Forty thousand rows of four kinds shuffle to a few hundred bytes; they are still a task for each range."""
    df = spark.range(40_000).select((F.col("id") % 4).cast("string").alias("A"))
    rows = stage(prepared(df, ["A"], Options(order_by=("A",))), "rows")
    assert rows.select(F.shiftright(RID, 33)).distinct().count() > 1
    assert [r["A"] for r in rows.orderBy(RID).select(f"{ONCE}.A").distinct().orderBy("A").collect()] == ["0", "1", "2", "3"]


@pytest.mark.parametrize("few", [100_000, 0])
def test_rows_that_cancel_are_the_lowest(spark, monkeypatch, few):
    monkeypatch.setattr("concordia.staging.FEW", few)
    monkeypatch.setattr(bag, "FEW", few)
    monkeypatch.setattr(bag, "STEPS", (33, 6, 3, 0))
    ids = [(p << 33) + i for p in range(3) for i in range(200)]
    key = lambda r: "abcde"[(r * 7 + (r >> 33)) % 11 % 5]
    side = stage(spark.createDataFrame([(r, key(r)) for r in ids], f"{RID} long, {HASH} string"), "side")
    own = {h: sorted(r for r in ids if key(r) == h) for h in "abcde"}
    other = {"a": 1, "b": 100, "c": 0, "d": 10_000, "e": len(own["e"])}
    counts = stage(spark.createDataFrame([(h, len(own[h]), other[h]) for h in "abcde"], f"{HASH} string, ns long, nt long"), "counts")
    left = sorted(r[RID] for r in bag.residual(side, counts, "ns", "nt").collect())
    assert left == sorted(r for h in own for r in own[h][other[h]:])
    met = sorted(r[RID] for r in bag.matched(side, counts).collect())
    assert met == sorted(r for h in own for r in own[h][: other[h]])


def test_a_side_is_never_broadcast(spark, monkeypatch):
    """The files of a side are far below the planner's limit, its rows need not be."""
    side = stage(spark.range(50_000).select(F.col("id").alias(RID), (F.col("id") % 1000).cast("string").alias(HASH)), "side")
    counts = stage(spark.range(1000).select(F.col("id").cast("string").alias(HASH), F.lit(50).cast("long").alias("ns"), F.lit(20).cast("long").alias("nt")), "counts")
    plan = lambda: bag.residual(side, counts, "ns", "nt")._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan()
    monkeypatch.setattr("concordia.staging.FEW", 0)
    assert "Broadcast" not in plan() and "SortMergeJoin" in plan()


def test_worksheets_are_written_in_one_pass(spark, tmp_path):
    """Thirty files take no job for each."""
    from concordia.operators.cells import COLUMNS
    from concordia.sinks.report import write_report

    report = spark.range(295).select(*[F.format_string("%04d", "id").alias(c) for c in COLUMNS]).orderBy("composite_key")
    spark.sparkContext.setJobGroup("worksheets", "worksheets")
    try:
        files = write_report(report, str(tmp_path / "report"), ["A"], "xlsx", rows=10)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("worksheets")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(files) == 31 and len(jobs) < 25
    import zipfile

    found = []
    for f in files[:-1]:
        with zipfile.ZipFile(f) as z:
            found.append(z.read("xl/worksheets/sheet1.xml").decode())
    for i, text in enumerate(found):
        rows = [f"{j:04d}" for j in range(10 * i, min(295, 10 * i + 10))]
        assert text.count("<row ") == len(rows) + 1 and all(f">{j}<" in text for j in rows)
