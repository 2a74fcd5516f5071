"""Delimiter votes, repair of wrongly quoted lines, and expansion of single-column tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delimiters in the order that breaks ties, and column names that mean unsplit text.
DELIMITERS = "|,\t~;"
#: The vote inside a single text column breaks ties in another order.
ROW_TEXT_DELIMITERS = "|,\t;~"
ROW_TEXT_NAMES = frozenset(("ROW_TEXT", "ROW", "TEXT", "DATA", "LINE"))
PROPER = ('","', '"|"', '"\t"', '";"', '"~"')


def line_delimiter(line: str, among: str = DELIMITERS) -> str:
    """The commonest delimiter of a line, the earlier of equals; a comma if there is none."""
    best = max(among, key=line.count)
    return best if line.count(best) else ","


def occurrences(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def line_delimiter_column(c: Column, among: str = DELIMITERS) -> Column:
    """:func:`line_delimiter` as a column expression."""
    counts = [occurrences(c, d) for d in among]
    top = F.greatest(*counts)
    vote = F.when(top == 0, F.lit(","))
    for d, n in zip(among, counts, strict=True):
        vote = vote.when(n == top, F.lit(d))
    return vote


def file_delimiters(lines: list[str]) -> tuple[str, str]:
    """Delimiters of the header (first of *lines*) and of the data (the others, ten at most)."""
    if not lines:
        return ",", ","
    header, data = line_delimiter(lines[0].strip()), [x.strip() for x in lines[1:11]]
    votes = {d: sum(x.count(d) for x in data) for d in DELIMITERS}
    best = max(DELIMITERS, key=votes.get)
    return header, best if votes[best] else header


def errant_quotes(line: Column) -> Column:
    """Whether a whole line is wrapped in quotes that are not a field's: then a delimiter inside is lost."""
    wrapped = line.startswith('"') & line.endswith('"') & (F.length(line) > 1)
    doubled = line.startswith('""') & line.endswith('""') & (F.length(line) > 3)
    proper = reduce(lambda a, b: a | b, [line.contains(p) for p in PROPER])
    return wrapped & (doubled | ~proper)


def cleaned_lines(lines: DataFrame) -> DataFrame:
    """*lines* (value) without errant outer quotes; ``fixed`` says which lines had them."""
    errant = errant_quotes(F.col("value"))
    return lines.withColumn("fixed", errant).withColumn("value", F.when(errant, F.expr("substring(value, 2, length(value) - 2)")).otherwise(F.col("value")))


def expand_row_text(df: DataFrame, order: str | None = None) -> DataFrame:
    """Split a table's only column at the delimiter that its first ten values vote for: COL_1, COL_2, ...

    The first value with that delimiter sets the width; shorter rows are padded with empty cells, longer ones cut.
    """
    name = next(c for c in df.columns if c != order)
    text = F.col(f"`{name}`")
    head = (df.orderBy(order) if order else df).select(text).limit(10).collect()
    values = [r[0] for r in head if r[0]]
    votes = {d: sum(v.count(d) for v in values) for d in ROW_TEXT_DELIMITERS}
    best = max(ROW_TEXT_DELIMITERS, key=votes.get)
    if not votes[best]:
        return df
    width = len(next(v for v in values if best in v).split(best))
    parts = F.split(text, F.lit("\\Q" + best + "\\E"), -1)
    cells = [F.coalesce(F.when(F.length(text) > 0, F.get(parts, F.lit(i))), F.lit("")).alias(f"COL_{i + 1}") for i in range(width)]
    return df.select(*([order] if order else []), *cells)
