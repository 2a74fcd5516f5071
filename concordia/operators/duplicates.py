"""Rows that occur more than once within a table, and keys that do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions.rows import composite_key, full_row
from concordia.operators.align import HASH, RID, TWICE
from concordia.staging import joined, stage


def duplicate_groups(side: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """hash, n, and the key and row of the first of each group of equal rows (combined before the shuffle)."""
    cell = lambda c: F.col(f"{TWICE}.`{c}`")
    counts = side.groupBy(HASH).agg(F.count(F.lit(1)).alias("n"), F.min(RID).alias(RID)).where("n > 1")
    first = joined(side.select(RID, TWICE), stage(counts, "duplicates"), RID)
    return first.select(HASH, "n", composite_key(keys, [cell(c) for c in keys]).alias("key"), full_row([cell(c) for c in columns]).alias("row"))


def duplicate_rows(side: DataFrame, keys: list[str], columns: list[str], label: str) -> DataFrame:
    """Discrepancies of type DUPLICATE_IN_<label>."""
    groups = duplicate_groups(side, keys, columns)
    own, none = F.col("row"), F.lit("N/A")
    left, right = (own, none) if label == "SOURCE" else (none, own)
    return groups.select(
        F.lit(f"DUPLICATE_IN_{label}").alias("discrepancy_type"), F.col("key").alias("composite_key"),
        F.concat(F.lit("IDENTICAL_ROWS_COUNT="), F.col("n").cast("string")).alias("column_name"),
        left.alias("source_value"), right.alias("target_value"), left.alias("full_source_row"), right.alias("full_target_row"),
    )


def duplicate_totals(side: DataFrame) -> DataFrame:
    """How many rows are duplicated, and how many rows that makes."""
    per = side.groupBy(HASH).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.agg(F.count(F.lit(1)).alias("unique_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"))


def duplicate_keys(side: DataFrame, keys: list[str], cells: str) -> DataFrame:
    """Composite keys that more than one row has."""
    key = composite_key(keys, [F.col(f"{cells}.`{c}`") for c in keys])
    return side.groupBy(key.alias("composite_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def count_mismatches(counts: DataFrame) -> DataFrame:
    """Discrepancies for hashes that both sides have, but not equally often."""
    times = lambda c: F.concat(F.col(c).cast("string"), F.lit(" occurrences"))
    na = F.lit("N/A")
    return counts.where("ns > 0 and nt > 0 and ns <> nt").select(
        F.lit("DUPLICATE_COUNT_MISMATCH").alias("discrepancy_type"), F.concat(F.lit("HASH:"), F.substring(HASH, 1, 16)).alias("composite_key"),
        F.lit("ALL").alias("column_name"), times("ns").alias("source_value"), times("nt").alias("target_value"), na.alias("full_source_row"), na.alias("full_target_row"),
    )
