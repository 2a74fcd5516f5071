"""Fuzzy keys: a coarse text form for lookup, and tolerant equality of two canonical cells."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordia.functions.canonical import BLANK, let, strip

# Tokens that mean null in a key.
NULLS = ("", "null", "none", "nan", "nat", "n/a", "na", "<null>")
#: Key columns that the lookup form uses.
INDEX_COLUMNS = 3


def fuzzy_key(c: Column) -> Column:
    """Upper case, slashes and bars as blanks, blanks collapsed, then punctuation dropped; null tokens are NULL."""

    def form(s):
        t = F.regexp_replace(F.regexp_replace(s, r"[/|\\]", " "), f"{BLANK}+", " ")
        t = F.upper(strip(F.regexp_replace(t, r"[_\-.()\[\]{}]", "")))
        return F.when(s.isNull() | F.lower(s).isin(*NULLS), F.lit("NULL")).otherwise(t)

    return let(strip(c), form)


def fuzzy_index_key(names: list[str], cells: list[Column]) -> Column:
    """Lookup form of a composite key: its first three columns."""
    return F.concat_ws("||", *[F.concat(F.lit(f"{n}="), fuzzy_key(c)) for n, c in list(zip(names, cells, strict=True))[:INDEX_COLUMNS]])


def as_number(c: Column) -> Column:
    """The number that a cell's text says, null if it says none: outer blanks and commas are dropped, single underscores
    may stand between digits, and digits may be those of any script."""
    return let(strip(F.replace(c, F.lit(","), F.lit(""))), lambda t: let(F.when(t.rlike(r"^[\x00-\x7f]*$"), t).otherwise(F.translate(t, *_digits())), _number))


@cache
def _digits() -> tuple[str, str]:
    """All decimal digits of Unicode beyond ASCII, and what they stand for."""
    found = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(x)) for x in found)


def _number(t: Column) -> Column:
    run = "[0-9]+(_[0-9]+)*"
    number = F.when(t.rlike(rf"^[+-]?({run}\.?({run})?|\.{run})([eE][+-]?{run})?$"), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    infinite = F.when(F.lower(t).rlike("^[+-]?inf(inity)?$"), sign * F.lit(float("inf")))
    return F.coalesce(number, infinite, F.when(F.lower(t).rlike("^[+-]?nan$"), F.lit(float("nan"))))


def fuzzy_equal(a: Column, b: Column, tolerance: float = 100.0, share: float = 0.01) -> Column:
    """EXACT, FUZZY_NUMERIC, FUZZY_STRING or DIFFERENT, for two canonical cells."""

    def near(xy):
        x, y = xy["x"], xy["y"]
        gap = F.abs(x - y)
        close = (gap <= tolerance) | (gap / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) <= share)
        return F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(close & ~F.isnan(gap))

    def alike(st):
        s, t = st["s"], st["t"]
        m, n = F.length(s), F.length(t)
        slack = F.greatest(F.lit(2), F.floor(F.least(m, n) / 10))
        part = (m > 0) & (n > 0) & (F.abs(m - n) <= slack) & F.when(m >= n, s.contains(t)).otherwise(t.contains(s))
        return (s == t) | part

    numeric = let(F.struct(as_number(a).alias("x"), as_number(b).alias("y")), near)
    text = let(F.struct(fuzzy_key(a).alias("s"), fuzzy_key(b).alias("t")), alike)
    verdict = let(numeric, lambda ok: F.when(ok, "FUZZY_NUMERIC").when(~ok, "DIFFERENT").when(text, "FUZZY_STRING").otherwise("DIFFERENT"))
    return F.when(a.eqNullSafe(b), "EXACT").when(a.isNull() | b.isNull(), "DIFFERENT").otherwise(verdict)
