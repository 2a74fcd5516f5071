"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random 64-bit key.  Within a source, documents are sorted by key in ranges of
equal key width (so a source with a third of all rows has a third of the ranges), range sums give
distributed prefix sums of token counts, and the source is cut at its exact budget: whole epochs first,
then documents in key order, the last one in part.

Defined results: null text has size 0 and takes 0; a null source is a source of its own, last in order;
repeated rows count and are taken each on their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm._common import WORD, ship, stage, uniform_bucket

#: A source's target is at most so many times its size.
MOST_EPOCHS = 3
RANGE_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source: rank by code point (nulls last), size, rows and target.

    Sharing by weight with the cap and resharing the excess until none is above ends where every source
    has the smaller of its cap and L times its weight.  In ascending order of cap / weight, the capped
    sources come first, and L is the largest of (total - caps before) / (weights from here on).
    The windows here run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("source_rank", rank.cast("long"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * MOST_EPOCHS).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "source_rank")
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onwards))
    per = per.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap"), F.col("level") * F.col("w"))
    return per.select("source", "source_rank", "source_size", "source_rows", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42, size: Column | None = None) -> DataFrame:
    """One row per document: size, source_size, target of its source, and the words the mix takes of it."""
    size = word_count(F.col("text")) if size is None else size
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = docs.select("doc_id", "source", size.alias("size"), key.alias("key"))
    rows = stage(rows, "mix-sizes")  # one pass over the texts
    out = _cut(rows, stage(source_targets(rows, weights), "mix-targets"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def _cut(rows: DataFrame, targets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decide how much of each of *rows* (doc_id, source, size, key, *keep*) the mix takes."""
    budget = F.round("target").cast("long")
    targets = targets.select(
        "source_rank", F.col("source").alias("its_source"), "source_size", "target",
        F.ceil(F.col("source_rows") / RANGE_ROWS).alias("ranges"),
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        budget.alias("budget"),
    )
    dealt = lambda r: r.join(targets, F.col("source").eqNullSafe(F.col("its_source"))).withColumn(
        "range", uniform_bucket(F.col("key"), F.col("ranges"))
    )
    starts = (
        dealt(rows.select("source", "key", "size")).groupBy("source_rank", "range").agg(F.sum("size").alias("range_size"))
        .withColumn("start", F.sum("range_size").over(Window.partitionBy("source_rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
        .select("source_rank", "range", F.coalesce("start", F.lit(0)).alias("start"))
    )
    by_key = Window.partitionBy("source_rank", "range").orderBy(F.shiftrightunsigned("key", 1), "key", "doc_id", "size")
    inner = F.coalesce(F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt(rows).withColumn("inner", inner).join(starts, ["source_rank", "range"])
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("start") - F.col("inner")))
    out = out.withColumn("part", part.cast("long"))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", taken, "epochs", "part", *keep)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """The mix itself, in the columns of *docs*: whole epochs as repeated rows, the cut document shortened.

    Documents without a word, or beyond their source's budget, are not in it.  ``n_chars``, where it
    is a column, is set anew for shortened texts.
    """
    names = docs.columns
    size, key = word_count(F.col("text")), F.xxhash64(F.col("doc_id"), F.lit(seed))
    sizes = stage(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "mix-sizes")
    targets = stage(source_targets(sizes, weights), "mix-targets")
    rows = docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    out = _cut(rows, targets, keep=("row",))
    copies = F.col("epochs") + (F.col("part") > 0).cast("long")
    out = out.where((F.col("size") > 0) & (copies > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    short = (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    text = F.when(short, first_words(F.col("row.text"), F.col("part"))).otherwise(F.col("row.text"))
    cols = []
    for c in names:
        if c == "text":
            cols.append(text.alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            cols.append(F.when(short, F.char_length(text).cast(kind)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            cols.append(F.col("row")[c].alias(c))
    return out.select(*cols)


ship(__name__)
