"""Key detection: rank columns by what their values look like and how unique they are, then take the
shortest prefix of the ranking that identifies the rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.canonical import strip
from concordia.functions.patterns import NAME_PATTERNS

# Sample size, limits and the share of distinct rows that is enough; then classes, shares and boosts.
SAMPLE, MOST_CANDIDATES, MOST_PREFIX, FALLBACK, ENOUGH = 50, 30, 24, 20, 0.999
CLASSES = ("boolean", "timestamp", "filename", "integer", "decimal", "alphanumeric", "alphabetic", "text")
#: Column classes in the order they are tried: cell class, share to exceed, column class, boost.
RULES = (
    ("alphanumeric", 0.5, "alphanumeric", 150), ("integer", 0.5, "integer", 140), ("alphabetic", 0.5, "alphabetic_code", 80),
    ("timestamp", 0.3, "timestamp", -200), ("filename", 0.3, "filename", -200), ("boolean", 0.3, "boolean", -100),
    ("decimal", 0.5, "decimal", -50), ("text", 0.5, "text", -30),
)


def name_excluded(name: str, patterns: Sequence[str] = NAME_PATTERNS) -> bool:
    return any(re.match(p, name, re.IGNORECASE) for p in patterns)


def cell_class(c: Column) -> Column:
    """Lexical class of a cell."""
    s = strip(c)
    stamp = r"^(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}[T ]\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}|\p{Nd}{2}/\p{Nd}{2}/\p{Nd}{4} \p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}|\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}$)"
    file = r"(?i)(.*\.(csv|txt|dat|xml|json|xlsx?|parquet)$|^[A-Za-z0-9_-]+_\p{Nd}{8}.*\.)"
    return (
        F.when(F.lower(s).isin("true", "false", "yes", "no", "y", "n", "0", "1", "t", "f"), "boolean")
        .when(s.rlike(stamp), "timestamp")
        .when(s.rlike(file), "filename")
        .when(s.rlike(r"^-?\p{Nd}+$"), "integer")
        .when(s.rlike(r"^-?\p{Nd}+\.\p{Nd}+$"), "decimal")
        .when(s.rlike(r"^[A-Za-z0-9_-]+$") & s.rlike("[A-Za-z]") & s.rlike("[0-9]"), "alphanumeric")
        .when(s.rlike(r"^[A-Za-z_-]+$") & (F.length(s) <= 20), "alphabetic")
        .otherwise("text")
    )


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: col (place in *columns*), value, and the columns to keep."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(*keep, F.inline(cells))


def profile(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """One row per column: place, counts of each cell class in the first 50 non-null cells by *order*, rows,
    non-null and distinct counts, class, boost and priority."""
    cells = _long(df, columns, [order])
    first = F.row_number().over(Window.partitionBy("col").orderBy(order))
    sample = cells.where("value is not null").withColumn("r", first).where(F.col("r") <= SAMPLE).withColumn("k", cell_class(F.col("value")))
    looks = sample.groupBy("col").agg(F.count(F.lit(1)).alias("sampled"), *[F.count(F.when(F.col("k") == k, 1)).alias(f"n_{k}") for k in CLASSES])
    distinct = cells.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("col").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count("value").alias("n_unique")
    )
    names = F.array(*map(F.lit, columns))
    out = distinct.join(looks, "col", "left").withColumn("column_name", F.element_at(names, F.col("col") + 1))
    kind, boost = F.when(F.col("sampled").isNull(), "empty"), F.when(F.col("sampled").isNull(), -100)
    for cell, share, name, points in RULES:
        hit = F.col(f"n_{cell}") / F.col("sampled") > share
        kind, boost = kind.when(hit, name), boost.when(hit, points)
    out = out.withColumn("col_type", kind.otherwise("mixed")).withColumn("boost", boost.otherwise(0))
    unique, filled = F.col("n_unique") / F.col("n_rows"), F.col("non_null") / F.col("n_rows")
    priority = F.col("boost") + unique * 50 + filled * 30 - F.when(F.col("n_unique") < 10, 80).otherwise(0) - F.when(filled < 0.5, 50).otherwise(0)
    return out.select(
        "col", "column_name", "col_type", "n_rows", "non_null", "n_unique", unique.alias("unique_ratio"), filled.alias("non_null_ratio"), priority.alias("priority")
    )


def uniqueness(df: DataFrame, columns: Sequence[str]) -> float:
    """Distinct combinations of *columns* per row."""
    n, d = df.agg(F.count(F.lit(1)), F.count_distinct(F.struct(*[F.col(f"`{c}`") for c in columns]))).first()
    return d / n if n else 0.0


def detect_key(df: DataFrame, columns: Sequence[str], order: str, exclude: Sequence[str] = NAME_PATTERNS) -> list[str]:
    """Columns of *df* that identify its rows, or the best candidates if none do.

    The share of distinct prefixes grows with the prefix, so the shortest one that is enough is found by bisection.
    """
    if not df.take(1):
        return list(columns)[:FALLBACK]
    open_ = [c for c in columns if not c.startswith("_") and not name_excluded(c, exclude)]
    if not open_:
        return list(columns)[:FALLBACK]
    stats = profile(df, open_, order).where("col_type not in ('timestamp', 'filename')").collect()  # a row per column
    stats = sorted(sorted(stats, key=lambda r: r["col"]), key=lambda r: -r["priority"])
    for r in stats:
        if r["unique_ratio"] == 1.0 and r["non_null_ratio"] == 1.0:
            return [r["column_name"]]
    ranking = [r["column_name"] for r in stats][:MOST_CANDIDATES]
    low, high = 1, min(len(ranking), MOST_PREFIX)
    if high and uniqueness(df, ranking[:high]) >= ENOUGH:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if uniqueness(df, ranking[:mid]) >= ENOUGH else (mid + 1, high)
        return ranking[:low]
    return ranking[:FALLBACK] or list(columns)[:FALLBACK]
