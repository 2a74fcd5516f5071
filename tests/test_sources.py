"""Delimited text: votes, repairs, widths."""

import pytest
from pyspark.sql import functions as F

from concordia.sources import errant_quotes, expand_row_text, file_delimiters, line_delimiter, line_delimiter_column, read_delimited


def read(spark, tmp_path, text, **how):
    path = tmp_path / "in.txt"
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    df = read_delimited(spark, str(path), keep_order=True, **how)
    return [c for c in df.columns if c != "__c_line"], [tuple(r)[1:] for r in df.orderBy("__c_line").collect()]


VOTES = {"a|b|c": "|", "a,b,c": ",", "a\tb": "\t", "a~b~c": "~", "a;b": ";", "a|b,c": "|", "a,b;c;d": ";", "plain": ",", "": ","}


def test_line_votes(spark):
    assert {k: line_delimiter(k) for k in VOTES} == VOTES
    df = spark.createDataFrame([(k,) for k in VOTES], "v string").select("v", line_delimiter_column(F.col("v")).alias("d"))
    assert {r["v"]: r["d"] for r in df.collect()} == VOTES


def test_file_votes():
    assert file_delimiters(["a|b", "1|2"]) == ("|", "|")
    assert file_delimiters(["a|b", "1,2", "3,4"]) == ("|", ",")
    assert file_delimiters(["a|b"]) == ("|", "|")
    assert file_delimiters(["a;b", "x", "y"]) == (";", ";")
    assert file_delimiters([]) == (",", ",")


QUOTES = {'"a|b"': True, '"a","b"': False, '""a","b""': True, '"': False, '""': True, 'a"b"': False, '"a"\t"b"': False, "plain": False, '"one cell"': True}


def test_errant_quotes(spark):
    df = spark.createDataFrame([(k,) for k in QUOTES], "v string").select("v", errant_quotes(F.col("v")).alias("e"))
    assert {r["v"]: r["e"] for r in df.collect()} == QUOTES


def test_plain(spark, tmp_path):
    assert read(spark, tmp_path, " id| name \n1| x y\n2|\n\n3|z|\n4") == (["ID", "NAME"], [("1", "x y"), ("2", ""), ("4", "")])


def test_crlf_and_quotes(spark, tmp_path):
    assert read(spark, tmp_path, 'a,b\r\n"x, y","q""q"\r\nQ"t,2\r\n') == (["A", "B"], [("x, y", 'q"q'), ('Q"t', "2")])


def test_whole_rows_in_quotes(spark, tmp_path):
    assert read(spark, tmp_path, '"a|b"\n"1|2"\n3|"4"\n') == (["A", "B"], [("1", "2"), ("3", '"4"')])


def test_escape(spark, tmp_path):
    assert read(spark, tmp_path, "a|b\nx\\|y|1\nz|2\n", escape="\\") == (["A", "B"], [("x|y", "1"), ("z", "2")])
    assert read(spark, tmp_path, "a|b\nx\\y|1\n") == (["A", "B"], [("x\\y", "1")])


def test_data_wider_than_header(spark, tmp_path):
    """Leading cells beyond the header are row labels; later narrower rows shift the same way."""
    assert read(spark, tmp_path, "a,b\n1,2,3\n4,5\n6,7,8,9\n") == (["A", "B"], [("2", "3"), ("5", "")])


def test_mixed_delimiters(spark, tmp_path):
    assert read(spark, tmp_path, "a,b\n1|2|3\n4|5\n") == (["A", "B", "COL_3"], [("1", "2", "3"), ("4", "5", None)])
    assert read(spark, tmp_path, "row_text\n1|2\n3|4\n") == (["ROW_TEXT", "COL_2"], [("1", "2"), ("3", "4")])


def test_tab_and_semicolon(spark, tmp_path):
    assert read(spark, tmp_path, "a\tb\n1\t2\n")[1] == [("1", "2")]
    assert read(spark, tmp_path, "a;b\n1;2\n")[1] == [("1", "2")]


def test_expand(spark):
    df = spark.createDataFrame([(0, "a|b|c"), (1, "d|e"), (2, "f|g|h|i"), (3, ""), (4, None)], "o int, TEXT string")
    out = expand_row_text(df, "o").orderBy("o").drop("o")
    assert [tuple(r) for r in out.collect()] == [("a", "b", "c"), ("d", "e", ""), ("f", "g", "h"), ("", "", ""), ("", "", "")]
    same = spark.createDataFrame([(0, "plain")], "o int, TEXT string")
    assert expand_row_text(same, "o").columns == ["o", "TEXT"]


def test_empty_and_colliding(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        read(spark, tmp_path, "")
    with pytest.raises(ValueError, match="collide"):
        read(spark, tmp_path, "a,A\n1,2\n")
    assert read(spark, tmp_path, "a|b\n") == (["A", "B"], [])


def test_invalid_bytes(spark, tmp_path):
    assert read(spark, tmp_path, b"a|b\n\xff1|2\n")[1] == [("�1", "2")]


OPEN = {'a,"b': True, 'a,"b"': False, 'a,b"c': False, '"a""': True, '"a"",b': True, '"a""",b': False, 'a, "b': True, 'x"y,"z': True, "": False, 'a,"b"c,"d': True}


def test_ends_open():
    from concordia.sources.delimited import ends_open

    assert {k: ends_open(k, ",") for k in OPEN} == OPEN
    assert ends_open('still,"', ",", opened=True) is False and ends_open("still", ",", opened=True) is True
    assert ends_open('a,"b\\"', ",", "\\") is True


def test_cells_over_several_lines(spark, tmp_path):
    text = 'id,note\n1,"one\n\ntwo, ""2"""\n2,plain\n3,"x\ny"\n'
    assert read(spark, tmp_path, text) == (["ID", "NOTE"], [("1", 'one\n\ntwo, "2"'), ("2", "plain"), ("3", "x\ny")])
    assert read(spark, tmp_path, text.replace("\n", "\r\n"))[1][2] == ("3", "x\ny")
    with pytest.raises(ValueError, match="still open"):
        read(spark, tmp_path, 'id,note\n1,"one\n2,two\n')


def test_records_over_parts_of_a_file(spark, tmp_path):
    """Parts that begin inside a cell, end inside one, or lie within one, against the standard reader."""
    import csv
    import random

    rng = random.Random(5)
    rows = [[str(i), rng.choice(["a", 'b "q", c', "l1\nl2", "long\n" * rng.randint(1, 60), ""])] for i in range(300)]
    path = tmp_path / "many.csv"
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "note"], *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = [[r["ID"], r["NOTE"]] for r in read_delimited(spark, str(path), keep_order=True).orderBy("__c_line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == rows


def test_the_header_is_repaired_with_the_data_only(spark, tmp_path):
    assert read(spark, tmp_path, '"a|b"\n1|2\n')[0] == ["A|B"]
    assert read(spark, tmp_path, '"a|b"\r\n1|2\r\n') == (["A", "B"], [("1", "2")])
