"""Column alignment and the prepared form of a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.functions.canonical import canonical_cells
from concordia.functions.rows import row_hash
from concordia.options import Options

RID, HASH, ORIG, ONCE, TWICE = "__c_rid", "__c_hash", "__c_orig", "__c_once", "__c_twice"


def upper_names(df: DataFrame) -> DataFrame:
    """Column names stripped and upper-cased; names that then collide are an error."""
    names = [c.strip().upper() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide: {', '.join(twice)}")
    if reserved := [n for n in names if n.startswith("__C_")]:
        raise ValueError(f"column names are reserved: {', '.join(reserved)}")
    return df.toDF(*names)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as a string: nested ones as JSON, timestamps and dates in ISO form."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        elif not isinstance(f.dataType, T.StringType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def common_columns(source: DataFrame, target: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Columns of both in source order, then those of only one side, sorted."""
    both = [c for c in source.columns if c in target.columns]
    return both, sorted(set(source.columns) - set(both)), sorted(set(target.columns) - set(both))


def few_partitions(df: DataFrame) -> int:
    """How many partitions *df* should be spread over because its scan has fewer than there are cores; else 0.

    Only plans without a shuffle are asked: others would run for the answer.
    """
    plan = df._jdf.queryExecution()
    if re.search("Aggregate|Join|Sort|Window|Exchange|Python|Arrow|Pandas", plan.sparkPlan().toString()):
        return 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores if plan.toRdd().getNumPartitions() < cores else 0


def prepared(df: DataFrame, columns: list[str], options: Options) -> DataFrame:
    """rid, hash, original cells, canonical cells and twice canonical cells; one pass, narrow unless
    the input has fewer partitions than there are cores.

    Row ids rise with the partition and the place in it, so that id order is input order, or the order of
    ``order_by``; the caller stages the result before it is used twice.
    """
    if options.order_by:
        # not orderBy: rows that repeat shuffle to so few bytes that Spark would join all ranges to a few large tasks
        order, spark = [f"`{c.upper()}`" for c in options.order_by], df.sparkSession
        ranges = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        df = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    spread = few_partitions(df)
    df = df.select(*[F.col(f"`{c}`") for c in columns]).withColumn(RID, F.monotonically_increasing_id())
    if spread:  # a file of one row group is one task; the ids keep its order
        df = df.repartition(spread, RID)
    settings = {
        "normalise": options.normalise, "timestamp_precision": options.timestamp_precision,
        "decimal_precision": options.decimal_precision, "exact_floats": options.exact_floats,
    }
    df, once, twice = canonical_cells(df, columns, **settings)
    struct = lambda cells: F.struct(*[x.alias(c) for x, c in zip(cells, columns, strict=True)])
    second = twice if options.strict_parity else once
    original = F.struct(*[F.col(f"`{c}`") for c in columns])
    return df.select(RID, row_hash(second).alias(HASH), original.alias(ORIG), struct(once).alias(ONCE), struct(second).alias(TWICE))
