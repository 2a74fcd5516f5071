"""Report files: CSV, XLSX in parts, and the column reference.

CSV is written by Spark.  A worksheet takes 1,048,575 rows and a header, so an XLSX report is cut in parts of
that many rows, each made by one task from a stream of rows; no part is ever held in memory, and the number of
a part's first row comes from counts per partition, not from a global window.  All files are written through Hadoop's
file systems, so that a report's path may be on any of them.

A worksheet's cell holds 32,767 characters and no control characters.  Rows with a cell that does not fit are in the
worksheet as far as they go, and whole in a CSV file of the same columns beside it, ``_long_cells.csv``.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.operators.cells import COLUMNS
from concordia.staging import discard, files_of, remove, stage, write_file

SHEET_ROWS = 1_048_575
WIDTHS = (20, 50, 25, 40, 40, 60, 60)
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Longest text of a cell.
CELL_CHARS = 32_767


def _row(values, number: int, style: int) -> str:
    cells = []
    for i, v in enumerate(values):
        text = escape(_BAD.sub("", "" if v is None else str(v))[:CELL_CHARS])
        cells.append(f'<c r="{chr(65 + i)}{number}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


class _Outlet(io.RawIOBase):
    """A stream that can only be written; what was written is taken out in chunks."""

    def __init__(self):
        self.held = bytearray()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.held += data
        return len(data)

    def taken(self) -> bytes:
        out = bytes(self.held)
        self.held.clear()
        return out


def xlsx_chunks(rows: Iterable[tuple], least: int = 1 << 20) -> Iterator[bytes]:
    """The file of a formatted worksheet of *rows*, in chunks of about *least* bytes."""
    n, outlet = 0, _Outlet()
    fixed = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/>'
        f'<Override PartName="/xl/styles.xml" ContentType="{_TYPES}.styles+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        f'<Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {_NS} xmlns:r="{_REL}"><sheets><sheet name="Discrepancies" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        f'<Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {_NS}><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts>'
        '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
        '<fill><patternFill patternType="solid"><fgColor rgb="FF4472C4"/></patternFill></fill></fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf xfId="0"/><xf fontId="1" fillId="2" xfId="0" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="center"/></xf></cellXfs></styleSheet>',
    }
    last = chr(64 + len(COLUMNS))
    with zipfile.ZipFile(outlet, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in fixed.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as raw, io.TextIOWrapper(raw, "utf-8") as f:
            widths = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(WIDTHS, 1))
            f.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet {_NS}><sheetViews><sheetView workbookViewId="0">')
            f.write(f'<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>')
            f.write(_row(COLUMNS, 1, 1))
            for n, values in enumerate(rows, 1):
                f.write(_row(values, n + 1, 0))
                if len(outlet.held) >= least:
                    yield outlet.taken()
            f.write(f'</sheetData><autoFilter ref="A1:{last}{n + 1}"/></worksheet>')
    yield outlet.taken()


def numbered_parts(report: DataFrame, rows: int = SHEET_ROWS) -> DataFrame:
    """The sorted report, staged, with ``part``: which file each row goes to."""
    ordered = stage(report.withColumn("id", F.monotonically_increasing_id()), "report")
    slot = F.shiftright("id", 33)
    sizes = sorted((r["slot"], r["n"]) for r in ordered.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    before, starts = 0, {}
    for s, n in sizes:
        starts[s] = before
        before += n
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), slot) if starts else F.lit(0)
    return ordered.withColumn("part", F.floor((offset + F.expr("id & 8589934591")) / rows) + 1)


def write_csv(rows: DataFrame, to: str) -> None:
    """*rows* as one file with a header, in their order."""
    spark, tmp = rows.sparkSession, f"{to}.parts"
    how = rows.select(*COLUMNS).write.mode("overwrite").option("header", False).option("escape", '"')
    how.option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(tmp)
    write_file(spark, to, [",".join(COLUMNS).encode() + b"\n"], files_of(spark, tmp))
    remove(spark, tmp)


def write_report(report: DataFrame, path: str, columns: list[str], kind: str = "xlsx", rows: int = SHEET_ROWS) -> list[str]:
    """Write a sorted report under *path* (its extension is set by *kind*); returns the files.

    An empty report is a file with a header only, and has no column reference.
    """
    if kind not in ("csv", "xlsx"):
        raise ValueError(f"unknown report format {kind}")
    base, spark = os.path.splitext(path)[0], report.sparkSession
    empty = not report.take(1)
    if kind == "csv":
        files = [f"{base}.csv"]
        write_csv(report.limit(0) if empty else report, files[0])
    elif empty:
        files = [f"{base}.xlsx"]
        write_file(spark, files[0], xlsx_chunks(()))
    else:
        parts = numbered_parts(report, rows)
        many = sorted(r["part"] for r in parts.select("part").distinct().collect())

        def each(batches):
            import itertools

            import pandas as pd

            rest = (r for b in batches for r in zip(*(b[c] for c in ("part", *COLUMNS)), strict=True))
            held, size = [], 0
            for p, group in itertools.groupby(rest, key=lambda r: r[0]):
                for i, chunk in enumerate(xlsx_chunks(r[1:] for r in group)):
                    held.append((p, i, chunk))
                    size += len(chunk)
                    if size >= 1 << 20:  # small files go together, since a frame costs more than a file
                        yield pd.DataFrame(held, columns=["part", "i", "chunk"])
                        held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["part", "i", "chunk"])

        tasks = min(len(many), max(4 * spark.sparkContext.defaultParallelism, len(many) * rows // SHEET_ROWS))
        dealt = parts.repartition(tasks, "part").sortWithinPartitions("part", "id").drop("id")
        made = stage(dealt.mapInPandas(each, "part long, i long, chunk binary"), "sheets")
        names = {p: f"{base}.xlsx" if len(many) == 1 else f"{base}_part{p}.xlsx" for p in many}
        # one pass for all files, not a job for each: a file's chunks follow each other, and as many as a partition has are held
        for p, chunks in groupby(made.orderBy("part", "i").toLocalIterator(), key=lambda r: r["part"]):
            write_file(spark, names[p], (bytes(r["chunk"]) for r in chunks))
        files = [names[p] for p in many]
        discard(made)
        unfit = reduce(lambda a, b: a | b, [(F.length(c) > CELL_CHARS) | F.col(c).rlike(_BAD.pattern) for c in COLUMNS])
        if (left := parts.where(unfit)).take(1):
            files.append(f"{base}_long_cells.csv")
            write_csv(left.orderBy("id"), files[-1])
    if not empty:
        files.append(f"{base}_column_reference.txt")
        write_file(spark, files[-1], ["".join(f"{i}: {c}\n" for i, c in enumerate(columns, 1)).encode()])
    return files
