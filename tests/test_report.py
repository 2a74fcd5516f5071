"""Report files and the command line."""

import csv
import re
import zipfile

from concordia import Options, reconcile
from concordia.cli import main, table_name
from concordia.operators.cells import COLUMNS
from concordia.sinks import write_report


def result(text_table, n=7):
    a, b = [(f"k{i:02}", f'v"{i}, <&>') for i in range(n)], [(f"k{i:02}", "w") for i in range(n)]
    return reconcile(text_table("K|V", a), text_table("K|V", b), Options(keys=("K",)))


def sheet(path):
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        return z.read("xl/worksheets/sheet1.xml").decode()


def test_csv(text_table, tmp_path):
    r = result(text_table)
    files = write_report(r.report, str(tmp_path / "out.x"), r.columns, "csv")
    with open(files[0], newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == COLUMNS and len(rows) == 8 and rows[1][1:4] == ["K=k00", "V", 'v"0, <&>']
    assert open(files[1]).read() == "1: K\n2: V\n"


def test_xlsx_in_parts(text_table, tmp_path):
    r = result(text_table)
    files = write_report(r.report, str(tmp_path / "out"), r.columns, "xlsx", rows=3)
    names = [f.rsplit("/", 1)[-1] for f in files]
    assert names == ["out_part1.xlsx", "out_part2.xlsx", "out_part3.xlsx", "out_column_reference.txt"]
    keys = [re.findall(r"K=k\d\d", sheet(f)) for f in files[:3]]
    assert keys == [["K=k00", "K=k01", "K=k02"], ["K=k03", "K=k04", "K=k05"], ["K=k06"]]
    text = sheet(files[0])
    assert "frozen" in text and 'autoFilter ref="A1:G4"' in text and "&lt;&amp;&gt;" in text


def test_empty_report_is_a_header(text_table, tmp_path):
    same = reconcile(text_table("K", [("a",)]), text_table("K", [("a",)]))
    assert write_report(same.report, str(tmp_path / "e"), same.columns, "csv") == [str(tmp_path / "e.csv")]
    assert open(tmp_path / "e.csv").read().strip() == ",".join(COLUMNS)
    assert write_report(same.report, str(tmp_path / "e"), same.columns, "xlsx") == [str(tmp_path / "e.xlsx")]
    assert not (tmp_path / "e_column_reference.txt").exists()


def test_statistics(text_table):
    r = result(text_table)
    assert [tuple(x) for x in r.by_type().collect()] == [("VALUE_MISMATCH", 7)]
    assert [tuple(x) for x in r.top_columns().collect()] == [("V", 7)]
    assert len(r.sample().collect()) == 5


def test_table_name():
    assert [table_name(x) for x in ("/x/acct_20240101_120000.csv", "acct_main.csv", "a_1_b.csv")] == ["acct", "acct_main", "a_1_b"]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "s_20240101_101010.csv").write_text("id|name\nq1|x\nq2|v\n")
    (tmp_path / "t.csv").write_text("id|name\nq1|x\nq2|z\n")
    args = [str(tmp_path / "s_20240101_101010.csv"), str(tmp_path / "t.csv"), "id", "--output-dir", str(tmp_path / "out"), "--output-format", "csv"]
    assert main(args) == 0
    report = next((tmp_path / "out").glob("s_discrepancy_report_*.csv")).read_text()
    assert "VALUE_MISMATCH,ID=q2,NAME,v,z" in report
    assert main([str(tmp_path / "none.csv"), str(tmp_path / "t.csv")]) == 1
    (tmp_path / "empty.csv").write_text("")
    assert main([str(tmp_path / "empty.csv"), str(tmp_path / "t.csv")]) == 1
    assert "no such file" in capsys.readouterr().err


def test_long_cells_are_whole_beside_the_worksheet(text_table, tmp_path):
    long = "x" * 40_000
    r = reconcile(text_table("K|V", [("a", long), ("b", "1\x01"), ("c", "1")]), text_table("K|V", [("a", "w"), ("b", "w"), ("c", "w")]), Options(keys=("K",)))
    files = write_report(r.report, str(tmp_path / "l"), r.columns, "xlsx")
    assert [f.rsplit("/", 1)[-1] for f in files] == ["l.xlsx", "l_long_cells.csv", "l_column_reference.txt"]
    with open(files[1], newline="") as f:
        rows = list(csv.reader(f))
    assert [x[1] for x in rows[1:]] == ["K=a", "K=b"] and rows[1][3] == long and rows[2][3] == "1\x01"
    assert "x" * 32_767 in sheet(files[0]) and "x" * 32_768 not in sheet(files[0])
    assert not list(tmp_path.glob(".*")) and not list(tmp_path.glob("*.parts"))


def test_tables_by_name_and_path(spark, text_table, tmp_path, caplog):
    (tmp_path / "a.csv").write_text("k,v\nq1,1\nq2,2\n")
    text_table("K|V", [("q1", "1"), ("q2", "3"), ("q2", "4")]).createOrReplaceTempView("told")
    r = reconcile(str(tmp_path / "a.csv"), "told", Options(keys=("K",)))
    with caplog.at_level("WARNING"):
        assert [tuple(x)[:3] for x in r.mismatches.collect()] == [("VALUE_MISMATCH", "K=q2", "V")]
    assert r.duplicate_target_keys == 1 and "1 keys stand more than once" in caplog.text
    text_table("K|V", [("x", "1")]).write.parquet(str(tmp_path / "p.parquet"))
    assert reconcile(str(tmp_path / "p.parquet"), text_table("K|V", [("x", "1")])).settled
