"""Document fingerprints by winnowing, with DataFrame functions only.

A text's words are cut into units of up to four characters, so that texts of few or very long words
have grams too.  Every run of K units has a hash, built by doubling: hashes of 2 units from units, of 4
from two of 2, and so on.  Of every window of W grams the least hash is selected, the rightmost of equal
ones, again by doubling.  A gram and its position are one long: 39 bits of hash above 24 bits that fall with
the position, so the least long is the least hash with ties to the right.  Any run of K + W - 1 units that
two texts share leaves a common fingerprint in both (Schleimer, Wilkerson and Aiken 2003).

Defined results: a null text is an empty text, whose fingerprint is empty; a text of under K units is one
gram, and one of under W grams keeps them all; two empty fingerprints are alike (1.0), an empty and another are not (0.0); positions of units
are counted modulo 2**24; rows follow in order of id (nulls last), of equal ids in order of their text's
hash; after the last row comes the first; the one row of a table follows itself; an empty table gives an empty table;
texts of any length are read whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm._common import ship, stage

K, W = 4, 6
UNIT = r"[^\x20\x09-\x0D]{1,4}"
_POS = (1 << 24) - 1
RANGE_ROWS, MOST_RANGES = 1000, 4096


def units(text: Column) -> Column:
    """Hashes of the units of *text*."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0)), lambda x: F.xxhash64(x))


def position(x: Column) -> Column:
    return _POS - x.bitwiseAND(_POS)


def with_selected(df: DataFrame, u: str, base: Column, out: str) -> DataFrame:
    """Appends *out*: the selected grams of the units *u*, whose first is at place *base*, in order of position.

    Every step is a projection of its own, so that each array is made once and kept flat; a lambda reads its
    neighbours in the array by index, which makes no arrays between.
    """
    keep = df.columns
    ahead = lambda c, i, by: F.get(F.col(c), i + by)
    first = lambda c, n: F.slice(F.col(c), F.lit(1), F.greatest(n, F.lit(0)))
    packed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 25), 24).bitwiseOR(_POS - (i.cast("long") + F.col("_at")) % (_POS + 1))
    df = df.withColumn("_at", base.cast("long"))
    df = df.withColumn("_2", F.transform(first(u, F.size(u) - 1), lambda x, i: F.xxhash64(x, ahead(u, i, 1))))
    gram = F.transform(first("_2", F.size(u) - 3), lambda x, i: packed(F.xxhash64(x, ahead("_2", i, 2)), i))
    whole = F.when(F.size(u) > 0, F.array(packed(F.xxhash64(u), F.lit(0)))).otherwise(F.array().cast("array<long>"))
    df = df.select(*keep, F.when(F.size(u) < K, whole).otherwise(gram).alias("_g"))
    df = df.withColumn("_3", F.transform(first("_g", F.size("_g") - 2), lambda x, i: F.least(x, ahead("_g", i, 1), ahead("_g", i, 2))))
    df = df.withColumn("_6", F.transform(first("_3", F.size("_g") - 5), lambda x, i: F.least(x, ahead("_3", i, 3))))
    return df.select(*keep, F.when(F.size("_g") < W, F.array_distinct("_g")).otherwise(F.array_distinct("_6")).alias(out))


def with_edited(df: DataFrame) -> DataFrame:
    """Appends ``fe``, the fingerprint of ``head || tail``, where ``u`` and ``fp`` are the units and selected grams of a text
    that starts with ``head``.

    The units that end in ``head`` are those of the text, so grams that all their windows share with the text are
    taken from its fingerprint; only the last K + 2 W - 3 of these units and those of the tail are hashed again.
    """
    again = K + 2 * W - 3
    # an unfinished unit at the end of the head goes on in the tail
    loose = F.length(F.regexp_extract(F.reverse("head"), r"\A[^\x20\x09-\x0D]*", 0)) % 4
    df = df.withColumn("_cut", F.char_length("head") - loose)
    df = df.withColumn("_m", F.regexp_count(F.substring("head", F.lit(1), F.col("_cut")), F.lit(UNIT)))
    df = df.withColumn("_t", units(F.concat(F.substring("head", F.col("_cut") + 1, loose), F.col("tail"))))
    small = F.size("u") + F.size("_t") <= _POS  # beyond that, positions repeat and everything is hashed again
    df = df.withColumn("_b", F.when(small, F.greatest(F.col("_m") - again, F.lit(0))).otherwise(0))
    df = df.withColumn("_v", F.concat(F.slice("u", F.col("_b") + 1, F.col("_m") - F.col("_b")), F.col("_t")))
    df = with_selected(df, "_v", F.col("_b"), "_new")
    settled = F.when(F.col("_b") > 0, F.col("_b") + W - 1).otherwise(0)
    df = df.withColumn("_s", settled.cast("long"))
    old = F.filter("fp", lambda x: position(x) < F.col("_s"))
    new = F.when(F.col("_s") > 0, F.filter("_new", lambda x: position(x) >= F.col("_s"))).otherwise(F.col("_new"))
    return df.withColumn("fe", F.when(F.col("_s") > 0, F.concat(old, new)).otherwise(new)).drop("_cut", "_m", "_t", "_b", "_v", "_new", "_s")


def hashes(fp: str) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftrightunsigned(x, 24)))


def rendered(fp: str) -> Column:
    """hash:position of each selected gram, joined by commas."""
    one = lambda x: F.concat(F.hex(F.shiftrightunsigned(x, 24)), F.lit(":"), position(x).cast("string"))
    return F.array_join(F.transform(fp, one), ",")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Appends *out*: the Jaccard index of two arrays of distinct hashes."""
    df = df.withColumn("_common", F.size(F.array_intersect(a, b)))
    total = F.size(a) + F.size(b) - F.col("_common")
    return df.withColumn(out, F.when(total == 0, F.lit(1.0)).otherwise(F.col("_common") / F.greatest(total, F.lit(1)))).drop("_common")


def range_bounds(keys: DataFrame, rows: int) -> list[tuple[int, int]]:
    """Bounds (id, hash) of ranges of about RANGE_ROWS rows, at approximate quantiles of the id; an id that holds several
    quantiles is cut at quantiles of the hash of its texts."""
    ranges = max(1, min(MOST_RANGES, -(-rows // RANGE_ROWS)))
    if ranges == 1:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = keys.agg(F.percentile_approx("o", shares, 20_000).alias("b")).first()["b"]
    times = {b: found.count(b) for b in set(found)}
    return sorted((b, -(1 << 63) + j * ((1 << 64) // n)) for b, n in times.items() for j in range(n))


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """How many of *bounds* are at or below (o, h): found among every 64th bound, then among the 64 after that one."""
    if not bounds:
        return F.lit(0)
    table = lambda some: F.from_json(F.lit(json.dumps([{"o": o, "h": h} for o, h in some])), "array<struct<o:bigint,h:bigint>>")
    below = lambda b: (b["o"] < F.col("o")) | ((b["o"] == F.col("o")) & (b["h"] <= F.col("h")))
    coarse = F.size(F.filter(table(bounds[::64]), below))
    start = F.greatest(coarse - 1, F.lit(0)) * 64
    return start + F.size(F.filter(F.slice(table(bounds), start + 1, F.lit(64)), below))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, u, fp, next_text, next_fp): each row with its units and fingerprint, and the text and fingerprint of
    the next one by id; one shuffle of the texts.

    Ids are cut in ranges (at most MOST_RANGES; a larger table has longer ones, sorted with spill), each sorted in
    one task.  The first row of every range, at most as many rows as ranges, is added at the end of the range before.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    text = F.coalesce("text", F.lit(""))
    src = docs.select("doc_id", text.alias("text"), order.alias("o"), F.xxhash64(text).alias("h"))
    ids = docs.select(order.alias("o"))
    bounds = range_bounds(ids, ids.count())
    src = src.withColumn("part", range_of(bounds))
    firsts = src.groupBy("part").agg(F.min(F.struct("o", "h")).alias("x")).select("part", "x.*")  # a row per range
    whole = Window.orderBy("part")
    around = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("before", F.coalesce(F.lag("part").over(whole), F.max("part").over(around)))
    at = F.broadcast(firsts.select(F.col("o").alias("first_o"), F.col("h").alias("first_h"), "before"))  # at most MOST_RANGES rows
    lead_rows = src.join(at, (F.col("o") == F.col("first_o")) & (F.col("h") == F.col("first_h")))
    ends = lead_rows.groupBy("before").agg(F.min(F.struct("o", "h", "text")).alias("x"))
    ends = ends.select(F.lit(None).cast(src.schema["doc_id"].dataType).alias("doc_id"), "x.text", "x.o", "x.h", F.col("before").alias("part"), F.lit(True).alias("end"))
    ends = stage(ends, "range-ends")
    rows = src.withColumn("end", F.lit(False)).unionByName(ends)
    rows = rows.repartition("part").withColumn("u", units(F.col("text")))
    rows = with_selected(rows, "u", F.lit(0), "fp")
    by_id = Window.partitionBy("part").orderBy("end", "o", "h", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(by_id)).withColumn("next_fp", F.lead("fp").over(by_id))
    return rows.where("not end").select("doc_id", "text", "u", "fp", "next_text", "next_fp")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns: each text's fingerprint against its edited text's and the next text's."""
    df = with_next(docs)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    df = df.select("doc_id", "u", "fp", "next_fp", n.cast("long").alias("n_chars"), F.substring("text", F.lit(1), n - cut).alias("head"), F.substring("next_text", F.lit(1), cut).alias("tail"))
    df = df.withColumn("edited_sha256", F.sha2(F.concat("head", "tail"), 256))
    df = with_edited(df)
    df = df.select("doc_id", "n_chars", "edited_sha256", "fp", "fe", hashes("fp").alias("hp"), hashes("fe").alias("he"), hashes("next_fp").alias("hn"))
    df = with_likeness(df, "hp", "he", "near_edited")
    df = with_likeness(df, "hp", "hn", "near_next")
    return df.select("doc_id", "n_chars", "edited_sha256", rendered("fp").alias("fingerprint"), rendered("fe").alias("edited_fingerprint"), "near_edited", "near_next")


ship(__name__)
