"""Command line: compare two delimited files and write a report.  Exit code 0, also with discrepancies; 1 if a file
is missing or cannot be read."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from concordia.options import Options
from concordia.plans.reconcile import reconcile
from concordia.sinks.report import write_report
from concordia.sources.delimited import ORDER, read_delimited
from concordia.staging import exists

log = logging.getLogger("concordia")


def table_name(path: str) -> str:
    """A file's name without extension and without a trailing date and time in digits."""
    name = os.path.splitext(os.path.basename(path))[0]
    parts = name.rsplit("_", 2)
    return "_".join(parts[:-2]) if len(parts) == 3 and parts[1].isdigit() and parts[2].isdigit() else name


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="concordia", description="Compare two delimited files and report how they differ.")
    p.add_argument("source", nargs="?", help="source file")
    p.add_argument("target", nargs="?", help="target file")
    p.add_argument("keys", nargs="*", help="key columns; detected if none are named")
    p.add_argument("--output-dir", help="folder of the report")
    p.add_argument("--no-normalisation", action="store_true", help="compare cells as they are")
    p.add_argument("--decimal-precision", type=int, default=6, help="decimals that numbers are rounded to")
    p.add_argument("--esc-char", help="escape character of the files")
    p.add_argument("--output-format", choices=("csv", "xlsx"), default="xlsx")
    p.add_argument("-v", "--verbose", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    source = args.source or input("Source file: ").strip()
    target = args.target or input("Target file: ").strip()
    keys = args.keys or ([] if args.source and args.target else [k.strip() for k in input("Key columns (comma-separated, empty to detect): ").split(",") if k.strip()])
    spark = SparkSession.builder.appName("concordia").getOrCreate()
    for path in (source, target):
        if not exists(spark, path):
            print(f"Error: no such file: {path}", file=sys.stderr)
            return 1
    options = Options(keys=tuple(keys) or None, normalise=not args.no_normalisation, decimal_precision=args.decimal_precision)
    try:
        tables = [read_delimited(spark, p, args.esc_char).drop(ORDER) for p in (source, target)]
        result = reconcile(*tables, options)
    except (ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    folder = args.output_dir or "."
    stem = os.path.join(folder, f"{table_name(source)}_discrepancy_report_{datetime.now():%Y%m%d_%H%M%S}")
    files = write_report(result.report, stem, result.columns, args.output_format)
    if result.only_source or result.only_target:
        log.info("only in source: %s; only in target: %s", ", ".join(result.only_source) or "-", ", ".join(result.only_target) or "-")
    for r in result.by_type().collect():
        log.info("%s: %d", r["discrepancy_type"], r["n"])
    if result.settled:
        log.info("no discrepancies")
    else:
        for r in result.top_columns().collect():
            log.info("  %s: %d value mismatches", r["column_name"], r["n"])
        for r in result.sample().collect():
            log.info("  %s", " | ".join(map(str, r)))
    log.info("report: %s", ", ".join(files))
    return 0


if __name__ == "__main__":
    sys.exit(main())
