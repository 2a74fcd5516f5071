"""The delimited-text reader.

Lines come from ``spark.read.text``, so a file is split over tasks and nothing is copied.  Widths decide what
``spark.read.csv`` would get silently wrong: lines wider than the header and the first data line are
left out with a warning that counts them, shorter ones padded with empty cells, and if the data are wider than the header from the
start, their leading cells are row labels and not data.

A quoted cell may run over several lines.  Where no line ends inside a quote that it opened, which one pass over the
lines with quotes tells, every line is a record.  Otherwise each part of the file is read as if it began outside and
as if it began inside a quote; the parts' answers, a row a part, are chained in order, and then only
lines of records of several lines are brought together.
"""

from __future__ import annotations

import csv
import io
import logging
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.sources.lines import ROW_TEXT_NAMES, cleaned_lines, expand_row_text, file_delimiters
from concordia.staging import file_system, files_of

log = logging.getLogger(__name__)
ORDER = "__c_line"


def split_line(line: str, delimiter: str, quotes: bool = True, escape: str | None = None) -> list[str]:
    """Cells of one line: blanks after a delimiter go, doubled quotes inside quotes are one, *escape* protects
    the next character."""
    how = {"delimiter": delimiter, "skipinitialspace": True, "escapechar": escape}
    how |= {"quotechar": '"', "doublequote": True} if quotes else {"quoting": csv.QUOTE_NONE}
    return next(csv.reader(io.StringIO(line, newline=""), **how), [])


def _cells(line: Column, delimiter: str, quotes: bool, escape: str | None) -> Column:
    """Cells of each line.  Lines without quotes and escapes are split in the JVM; only others reach Python."""
    plain = F.transform(F.split(line, F.lit("\\Q" + delimiter + "\\E"), -1), lambda x: F.regexp_replace(x, "^ +", ""))
    if not quotes and escape is None:
        return plain
    hard = line.contains('"') if quotes else F.lit(False)
    if escape is not None:
        hard = hard | line.contains(escape)

    def cells(text):
        return None if text is None else split_line(text, delimiter, quotes, escape)

    return F.when(hard, F.udf(cells, "array<string>", useArrow=True)(F.when(hard, line))).otherwise(plain)


def ends_open(line: str, delimiter: str, escape: str | None = None, opened: bool = False) -> bool:
    """Whether a quoted cell is open after *line*, which begins inside one if *opened*."""
    quoted, start, i = opened, not opened, 0
    while i < len(line):
        c = line[i]
        if c == escape:
            start, i = False, i + 1
        elif quoted:
            if c == '"' and line[i + 1 : i + 2] == '"':
                i += 1
            elif c == '"':
                quoted = False
        elif c == delimiter:
            start = True
        elif start and c == '"':
            quoted, start = True, False
        elif c != " ":
            start = False
        i += 1
    return quoted


def _records(lines: DataFrame, delimiter: str, escape: str | None) -> DataFrame:
    """*lines* with those of one record joined by line feeds, under the place of its first."""
    may = lines.value.rlike("(^|" + re.escape(delimiter) + ') *"')
    check = F.udf(lambda v: v is not None and ends_open(v, delimiter, escape), "boolean", useArrow=True)
    if not lines.where(may).where(check("value")).take(1):
        return lines.select(ORDER, "value")

    def walk(rows, opened: bool, record: int):
        """(place, record, whether the line is a record by itself) of every line, then the state at the end."""
        for place, value in rows:
            begins = not opened
            record = place if begins else record
            opened = ends_open(value, delimiter, escape, opened) if '"' in value else opened
            yield place, record, begins and not opened
        yield opened, record, None

    def rows_of(batches):
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    def ends(batches):
        part, state = None, [(False, -1), (True, -1)]
        for batch in batches:
            for i, (opened, record) in enumerate(state):
                for found in walk(rows_of([batch]), opened, record):
                    part = found[0] >> 33 if found[2] is not None and part is None else part
                state[i] = found[:2]
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "open0": [state[0][0]], "rec0": [state[0][1]], "open1": [state[1][0]], "rec1": [state[1][1]]})

    src, starts, state = lines.select(ORDER, "value"), {}, (False, -1)
    for r in sorted(src.mapInArrow(ends, "part long, open0 boolean, rec0 long, open1 boolean, rec1 long").collect()):  # a row per part of the file
        starts[r["part"]] = state
        opened, record = (r["open1"], r["rec1"]) if state[0] else (r["open0"], r["rec0"])
        state = opened, state[1] if record < 0 else record
    if state[0]:
        raise ValueError("a quoted cell is still open at the end of the file")

    def joined(batches):
        now = None
        for batch in batches:
            rows = list(rows_of([batch]))
            if rows:
                *out, now = walk(rows, *(now or starts[rows[0][0] >> 33])[:2])
                yield pa.RecordBatch.from_pydict({ORDER: [x[0] for x in out], "record": [x[1] for x in out], "alone": [x[2] for x in out], "value": [v for _, v in rows]})

    lines = src.mapInArrow(joined, f"{ORDER} long, record long, alone boolean, value string")
    many = lines.where("not alone").groupBy("record").agg(F.array_sort(F.collect_list(F.struct(ORDER, "value"))).alias("lines"))
    return lines.where("alone").select(ORDER, "value").unionByName(many.select(F.col("record").alias(ORDER), F.concat_ws("\n", "lines.value").alias("value")))


def _has_crlf(spark: SparkSession, path: str) -> bool:
    """Whether the first 64 KiB hold a carriage return before a line feed."""
    for file in files_of(spark, path)[:1]:
        fs, at = file_system(spark, file)
        stream = fs.open(at)
        try:
            return b"\r\n" in bytes(stream.readNBytes(65536))
        finally:
            stream.close()
    return False


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    names = [n.strip().upper() for n in names]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"column names collide: {', '.join(twice)}")
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return df.select(ORDER, *cells)


def _mixed(rows: DataFrame, header: str, header_delimiter: str, delimiter: str) -> DataFrame:
    """Header and data with different delimiters: plain splits, width of the widest line, no quoting."""
    names = [x.strip().upper() for x in header.strip().split(header_delimiter)]
    stripped = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = rows.select(ORDER, stripped.alias("value")).where("value <> ''")
    rows = rows.select(ORDER, F.split("value", F.lit("\\Q" + delimiter + "\\E"), -1).alias("cells"))
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    names = names[:width] + [f"COL_{i + 1}" for i in range(len(names), width)]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"column names collide: {', '.join(twice)}")
    return rows.select(ORDER, *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_delimited(spark: SparkSession, path: str, escape: str | None = None, keep_order: bool = False) -> DataFrame:
    """A delimited text file as a table of strings with upper-case names.

    Delimiters are detected, of the header and of the data each.  Lines wrapped in quotes as a whole are repaired; if
    there are any among the data, quotes have no other meaning in the file.  The header is repaired only if a line of the data
    was or if lines end in carriage returns.  *keep_order* keeps the line order column.
    """
    lines = spark.read.text(path).withColumn(ORDER, F.monotonically_increasing_id())
    raw = lines.orderBy(ORDER).limit(11).select("value")
    head = [r["value"] for r in cleaned_lines(raw).select("value").collect()]
    if not head:
        raise ValueError(f"{path} is empty")
    first = lines.agg(F.min(ORDER)).first()[0]
    data = cleaned_lines(lines.where(F.col(ORDER) > first))
    fixed = data.agg(F.count_if("fixed")).first()[0]
    if not fixed and not _has_crlf(spark, path):
        head[0] = raw.first()["value"]
    header_delimiter, delimiter = file_delimiters(head)
    if header_delimiter != delimiter:
        df = _mixed(data, head[0], header_delimiter, delimiter)
    else:
        quotes = not fixed
        if quotes:
            records = _records(lines.withColumn("value", F.when(F.col(ORDER) == first, F.lit(head[0])).otherwise(F.col("value"))), delimiter, escape)
            head[0] = records.where(F.col(ORDER) == first).first()["value"]
            data = records.where(F.col(ORDER) > first)
        rows = data.where("trim(value) <> ''").select(ORDER, _cells(F.col("value"), delimiter, quotes, escape).alias("cells"))
        names = split_line(head[0], delimiter, quotes, escape)
        one = rows.orderBy(ORDER).select(F.size("cells").alias("n")).first()
        wide = one["n"] if one else len(names)
        label = max(0, wide - len(names))
        fits = F.size("cells") <= max(wide, len(names))
        if over := rows.where(~fits).count():
            log.warning("%s: %d lines are wider than the first and are left out", path, over)
        rows = rows.where(fits)
        if label:
            rows = rows.withColumn("cells", F.expr(f"slice(cells, {label + 1}, greatest(size(cells) - {label}, 0))"))
        df = _named(rows, names)
    cols = [c for c in df.columns if c != ORDER]
    if len(cols) == 1 and cols[0] in ROW_TEXT_NAMES:
        df = expand_row_text(df, ORDER)
    return df if keep_order else df.drop(ORDER)
