"""Renderings of a row: composite key, full row, hash, and the score of two rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown(c: Column) -> Column:
    return F.coalesce(c, F.lit("NULL"))


def composite_key(names: list[str], cells: list[Column]) -> Column:
    """NAME=value pairs joined by ||, nulls as NULL."""
    if not names:
        return F.lit("")
    return F.concat_ws("||", *[F.concat(F.lit(f"{n}="), shown(c)) for n, c in zip(names, cells, strict=True)])


def full_row(cells: list[Column]) -> Column:
    """All cells joined by |, nulls as NULL, empty cells empty."""
    return F.concat_ws("|", *map(shown, cells)) if cells else F.lit("")


def row_hash(cells: list[Column]) -> Column:
    """First 32 hex digits of the SHA-256 of the lower-cased canonical cells, joined by NUL."""
    return row_hash_of(F.array(*cells))


def row_hash_of(cells: Column) -> Column:
    """:func:`row_hash` of an array of cells."""
    parts = F.transform(cells, lambda c: F.coalesce(F.lower(c), F.lit("\x01NULL")))
    return F.substring(F.sha2(F.concat_ws("\x00", parts), 256), 1, 32)


def same_cell(a: Column, b: Column, ignore_case: bool = True) -> Column:
    """Null-safe equality of two cells, by default whatever the case."""
    return a.eqNullSafe(b) if not ignore_case else F.lower(a).eqNullSafe(F.lower(b)) | a.eqNullSafe(b)


def matching_columns(pairs: list[tuple[Column, Column]]) -> Column:
    """How many of the pairs of cells are equal, whatever the case."""
    return reduce(lambda x, y: x + y, [same_cell(a, b).cast("int") for a, b in pairs], F.lit(0))


def shortened(c: Column, most: int = 50) -> Column:
    """For display: at most *most* characters, then three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
