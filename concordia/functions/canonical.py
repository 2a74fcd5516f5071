"""Canonical form of a cell.

Rules, the first that holds: null tokens, booleans, timestamps, ISO dates, integers of any length, floats rounded
to a number of decimals, and everything else as it is.  All of it is JVM expressions but one step: a float
whose rounded text cannot be had by cutting digits (a half-way case, an exponent, more than 15
significant digits) goes through a small pandas UDF, which gets null for every row without one.

The rules as a whole are lambdas over arrays, which Spark interprets.  Nearly all cells are of a few plain shapes, whose
form a short expression says (:func:`_plain`); it is compiled, and only cells of no plain shape go through the rules.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that mean null, true and false.
NULLS = ("", "null", "none", "nan", "nat", "n/a", "na", "#n/a")
TRUE, FALSE = ("true", "yes", "y"), ("false", "no", "n")
#: White space as Unicode text processing strips it.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
STAMP = r"^(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2})[T ](\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2})"
MAYBE_NUMBER = r"(?i)^[+-]?(inf|infinity|nan|[\p{Nd}_]*\.?[\p{Nd}_]*(e[+-]?[\p{Nd}_]+)?)$"
ISO = r"^(19[0-9]{2}|20[0-9]{2}|2100)-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
#: Longer digit strings are text.
MOST_DIGITS = 4300


#: Which rule a cell falls under.
NULL, TRUTH, STAMPED, DATE, INTEGER, DECIMAL, EXACT, TEXT = range(8)
#: What a cell of a plain shape becomes: itself, null, true, false, a number without outer zeros, a stamp without its fraction.
SAME, NONE, YES, NO, CUT, FULL, HARD = range(7)
#: Plain shapes, whole cells: whole numbers, stamps, texts that begin with a letter, texts with a letter that no number, stamp or date has.
PLAIN_WHOLE, PLAIN_STAMP = r"^-?[1-9][0-9]*\z", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?\z"
PLAIN_TEXT = r"(?s)^[A-HJ-MO-Za-hj-mo-z](.*[!-~])?\z"
PLAIN_WORD = r"(?s)^(?=.*[b-dg-hj-mo-su-xzB-DG-HJ-MO-SU-XZ])[!-~](.*[!-~])?\z"
#: Most columns whose cells are compiled one by one; wider tables keep one expression for all.
NARROW = 16
DIGITS, NOTATION = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def stripped(c: Column) -> Column:
    """strip(c), without a search where the first and last characters are plain ones."""
    plain = lambda x: (x > 32) & (x < 127)
    return F.when(plain(F.ascii(c)) & plain(F.ascii(F.substring(c, -1, 1))), c).otherwise(strip(c))


def _exact(read: Column, places: int) -> Column:
    """Array with, for each cell that needs exact arithmetic, its text once and canonicalised again, joined by a space.

    The numbers of a row are one string, null for nearly all rows: nulls cost Python next to nothing.
    """
    def once(text: str) -> str | None:
        try:
            if re.fullmatch(r"[+-]?\d+", text):
                return str(int(text))
            x = float(text)
            return str(int(x)) if x.is_integer() else str(round(x, places))
        except ValueError:
            return None

    def both(text: str) -> str:
        first = once(text) if text else None
        if first is None:
            return ""
        second = "" if first == "nan" else once(first)
        return f"{first} {second}"

    def rows(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else "|".join(map(both, x.split("|"))) for x in column.array], dtype=object)

    number = F.transform(_hard(read), lambda n: F.coalesce(n, F.lit("")))
    answers = F.pandas_udf(rows, "string")(F.array_join(number, "|"))
    return F.transform(F.split(answers, r"\|"), lambda x: F.nullif(x, F.lit("")))


def _kind(v: Column, decimal_precision: int) -> Column:
    """The first rule that holds for a cell: fields c as it is, s stripped, n without commas, w and p its digits before and
    after the point without outer zeros."""
    c, s, n, w, p = (v[x] for x in "csnwp")
    low, code, size = F.lower(s), F.ascii(s), F.length(s)
    letter = (code.between(65, 90) | code.between(97, 122)) & ~code.isin(*map(ord, "iInN"))  # of numbers, only inf and nan have one
    # decimal notation whose shortest text is its digits without outer zeros
    cut = (F.length(w) + F.length(p) <= 15) & ((p == "") | (((w != "") | ~p.startswith("0000")) & (F.length(p) <= decimal_precision)))
    return (
        F.when(c.isNull(), NULL)
        .when((size <= 5) & low.isin(*NULLS), NULL)
        .when((size <= 5) & low.isin(*TRUE, *FALSE), TRUTH)
        .when(letter, TEXT)
        .when((size >= 19) & s.rlike(STAMP + r"(\.\p{Nd}+)?$"), STAMPED)
        .when((size == 10) & s.rlike(ISO), DATE)
        .when(c != s, TEXT)
        .when(n.rlike(DIGITS), F.when(F.length(n) > MOST_DIGITS, TEXT).otherwise(INTEGER))
        .when(w.isNotNull() & cut & n.rlike(NOTATION), DECIMAL)
        .when(n.rlike(MAYBE_NUMBER) & (n != ""), EXACT)
        .otherwise(TEXT)
    )


def _read(cells: Column, decimal_precision: int) -> Column:
    """Array of struct(c, s, n, w, p, k) of an array of cells; see :func:`_kind`."""
    point = lambda n: n.contains(".") & (F.ascii(n) < 58)
    whole = lambda n: F.ltrim(F.substring_index(n, ".", 1), F.lit("+-0"))
    part = lambda n: F.rtrim(F.substring_index(n, ".", -1), F.lit("0"))
    x = F.transform(cells, lambda c: F.struct(c.alias("c"), stripped(c).alias("s")))
    x = F.transform(x, lambda v: F.struct(v["c"].alias("c"), v["s"].alias("s"), F.when(v["s"].contains(","), F.replace(v["s"], F.lit(","), F.lit(""))).otherwise(v["s"]).alias("n")))
    x = F.transform(x, lambda v: F.struct(*[v[y].alias(y) for y in "csn"], F.when(point(v["n"]), whole(v["n"])).alias("w"), F.when(point(v["n"]), part(v["n"])).alias("p")))
    return F.transform(x, lambda v: F.struct(*[v[y].alias(y) for y in "csnwp"], _kind(v, decimal_precision).alias("k")))


def _hard(read: Column) -> Column:
    """Numbers of the cells that need exact arithmetic, null elsewhere; null if there is none."""
    return F.when(F.exists(read, lambda v: v["k"] == EXACT), F.transform(read, lambda v: F.when(v["k"] == EXACT, v["n"])))


def _forms(read: Column, exact: Column, timestamp_precision: int | None) -> Column:
    """Array of struct(once, twice) of cells as :func:`_read` has them; *exact* has the answers of exact arithmetic."""
    none = F.lit(None).cast("string")

    def form(v, i):
        c, s, n, w, p, k = (v[x] for x in "csnwpk")
        x = F.get(exact, i)
        minus = n.startswith("-")
        signed = lambda digits: F.when(digits == "", F.lit("0")).when(minus, F.concat(F.lit("-"), digits)).otherwise(digits)
        digits = F.when(F.ascii(n).between(49, 57), n).otherwise(signed(F.ltrim(n, F.lit("+-0"))))
        fraction = F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("")), F.when(w == "", F.lit("0")).otherwise(w), F.lit("."), p)
        stamp = F.concat(F.regexp_extract(s, STAMP, 1), F.lit(" "), F.regexp_extract(s, STAMP, 2))
        full = stamp
        if timestamp_precision:
            kept = F.rpad(F.substring(F.regexp_extract(s, r"\.(\p{Nd}+)$", 1), 1, timestamp_precision), timestamp_precision, "0")
            full = F.when(s.contains("."), F.concat(stamp, F.lit("."), kept)).otherwise(stamp)
        once = (
            F.when(k == TEXT, c).when(k == NULL, none).when(k == INTEGER, digits).when(k == DECIMAL, F.when(p == "", signed(w)).otherwise(fraction))
            .when(k == TRUTH, F.when(F.lower(s).isin(*TRUE), F.lit("true")).otherwise(F.lit("false"))).when(k == DATE, s)
            .when(k == STAMPED, full).otherwise(F.coalesce(F.split_part(x, F.lit(" "), F.lit(1)), c))
        )
        again = F.when(k == STAMPED, stamp) if timestamp_precision else None
        second = F.when(x.isNotNull(), F.nullif(F.split_part(x, F.lit(" "), F.lit(2)), F.lit(""))).otherwise(c)
        again = again.when(k == EXACT, second) if again is not None else F.when(k == EXACT, second)
        return F.struct(once.alias("once"), again.alias("again"), ((k == EXACT) | ((k == STAMPED) & F.lit(bool(timestamp_precision)))).alias("other"))

    return F.transform(F.transform(read, form), lambda f: F.struct(f["once"].alias("once"), F.when(f["other"], f["again"]).otherwise(f["once"]).alias("twice")))


def _skipped(c: Column) -> Column:
    """struct(once, twice) without normalisation."""
    kept = F.when(~F.lower(strip(c)).isin("", "nan", "nat"), c)
    return F.struct(kept.alias("once"), kept.alias("twice"))


def _plain(c: Column, decimal_precision: int, timestamp_precision: int | None) -> Column:
    """What becomes of a cell of a plain shape; HARD for all others, which the rules decide.  Agrees with :func:`_kind`."""
    low, number = F.lower(c), c < ":"
    kind = (
        F.when(c.isNull() | (c == ""), NONE)
        .when((F.octet_length(c) <= 5) & low.isin(*NULLS, *TRUE, *FALSE), F.when(low.isin(*TRUE), YES).when(low.isin(*FALSE), NO).otherwise(NONE))
        .when((c == "0") | (number & c.rlike(PLAIN_WHOLE) & (F.octet_length(c) < MOST_DIGITS)), SAME)
    )
    if places := min(6, decimal_precision):
        kind = kind.when(number & c.rlike(rf"^(-?[1-9][0-9]{{0,8}}|0)\.[0-9]{{1,{places}}}\z") & ~c.startswith("0.0000"), CUT)
    if not timestamp_precision:
        kind = kind.when(number & c.rlike(PLAIN_STAMP), FULL)
    return kind.when((number & c.rlike(ISO[:-1] + r"\z")) | c.rlike(PLAIN_TEXT) | c.rlike(PLAIN_WORD), SAME).otherwise(HARD)


def _plain_form(c: Column, kind: Column) -> Column:
    """The canonical form of a cell that is not HARD."""
    return (
        F.when(kind == SAME, c).when(kind == CUT, F.rtrim(F.rtrim(c, F.lit("0")), F.lit(".")))
        .when(kind == FULL, F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 12, 8))).when(kind == YES, F.lit("true")).when(kind == NO, F.lit("false"))
    )


def canonical_cells(
    df: DataFrame, columns: list[str], normalise: bool = True, timestamp_precision: int | None = None, decimal_precision: int = 6, exact_floats: bool = True,
) -> tuple[DataFrame, list[Column], list[Column]]:
    """*df* with columns of its own, and of them the canonical form of each of *columns* and that of its canonical form.

    The two differ only for floats (0.000000001 is 0.0, which is 0) and for timestamps that keep a fraction.  A row calls
    the rules only if one of its cells has no plain shape, and Python only if one needs exact arithmetic.  The cells of a
    table of more than NARROW columns are one array and each step one expression over it, so that plans stay small.
    """
    cells, places = [F.col(f"`{c}`") for c in columns], range(len(columns))
    if not normalise:
        df = df.withColumn("__c_forms", F.transform(F.array(*cells), _skipped))
        return df, [F.get("__c_forms", F.lit(i))["once"] for i in places], [F.get("__c_forms", F.lit(i))["twice"] for i in places]
    plain, narrow, keep = lambda c: _plain(c, decimal_precision, timestamp_precision), len(columns) <= NARROW, [F.col(f"`{c}`") for c in df.columns]
    # a projection with a lambda, whatever it does, is compiled in small methods; fused with its neighbours, it would be one
    # method too large for the JIT
    df = df.withColumns({"__c_kinds": F.array(*map(plain, cells)) if narrow else F.transform(F.array(*cells), plain), "__c_apart": F.transform(F.array(F.lit(1)), lambda x: x)})
    kind = lambda i: F.get("__c_kinds", i)
    left = F.transform(F.array(*cells), lambda c, i: F.when(kind(i) == HARD, c))
    df = df.withColumn("__c_read", F.when(F.array_contains("__c_kinds", HARD) & (F.size("__c_apart") == 1), _read(left, decimal_precision)))
    exact = F.array().cast("array<string>")
    if exact_floats:
        df = df.withColumn("__c_exact", _exact(F.col("__c_read"), decimal_precision))
        exact = F.col("__c_exact")
    forms = F.when(F.col("__c_read").isNotNull(), _forms(F.col("__c_read"), exact, timestamp_precision))
    easy = [_plain_form(cells[i], kind(F.lit(i))).alias(f"__c_easy{i}") for i in places] if narrow else []
    df = df.select(*keep, "__c_kinds", forms.alias("__c_forms"), *easy)
    if narrow:
        pick = lambda i, field: F.when(kind(F.lit(i)) == HARD, F.get("__c_forms", F.lit(i))[field]).otherwise(F.col(f"__c_easy{i}"))
        df = df.select(*keep, *[pick(i, f).alias(f"__c_{f}{i}") for f in ("once", "twice") for i in places])
        return df, [F.col(f"__c_once{i}") for i in places], [F.col(f"__c_twice{i}") for i in places]

    def chosen(c, i):
        easy = _plain_form(c, kind(i))
        return F.when(kind(i) == HARD, F.get("__c_forms", i)).otherwise(F.struct(easy.alias("once"), easy.alias("twice")))

    df = df.select(*keep, F.transform(F.array(*cells), chosen).alias("__c_forms"))
    return df, [F.get("__c_forms", F.lit(i))["once"] for i in places], [F.get("__c_forms", F.lit(i))["twice"] for i in places]


def with_canonical(df: DataFrame, columns: list[str], out: str, **settings) -> DataFrame:
    """*df* with *out*, an array with a struct (once, twice) for each of *columns*; see :func:`canonical_cells`."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    df, once, twice = canonical_cells(df, columns, **settings)
    return df.select(*keep, F.array(*[F.struct(a.alias("once"), b.alias("twice")) for a, b in zip(once, twice, strict=True)]).alias(out))


def canonical_pair(
    c: Column, normalise: bool = True, timestamp_precision: int | None = None, decimal_precision: int = 6, exact_floats: bool = True
) -> Column:
    """struct(once, twice) of one cell as an expression; for tables there is :func:`with_canonical`."""
    if not normalise:
        return _skipped(c)
    read = _read(F.array(c), decimal_precision)
    exact = _exact(read, decimal_precision) if exact_floats else F.array().cast("array<string>")
    # a Python UDF may not stand inside a lambda
    return let(F.struct(read.alias("r"), exact.alias("x")), lambda v: F.get(_forms(v["r"], v["x"], timestamp_precision), F.lit(0)))


def canonical(c: Column, **settings) -> Column:
    """Canonical form of *c*; see :func:`with_canonical`."""
    return canonical_pair(c, **settings)["once"]
