"""Bag matching: equal rows cancel one for one, lowest row ids first.

Most row hashes have as many rows on one side as on the other, or none there; for these the counts decide.  For each
other hash that both sides have, the id of the last row that cancels is found by counts, first per input partition and
then inside the one where the count runs out, so that one hash with a third of all rows is still many tasks and never
a sort of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.operators.align import HASH, RID
from concordia.staging import FEW, joined, stage

#: Low bits of a row id that are cut off, from step to step: the partition that numbered the row, runs of rows, rows.
STEPS, STEPS_OF_MANY = (33, 20, 10, 0), (33, 0)


def hash_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """hash, ns, nt for every hash of either side."""
    one = lambda d, ns, nt: d.select(HASH, F.lit(ns).cast("long").alias("ns"), F.lit(nt).cast("long").alias("nt"))
    return one(source, 1, 0).unionByName(one(target, 0, 1)).groupBy(HASH).agg(F.sum("ns").alias("ns"), F.sum("nt").alias("nt"))


def last_of(side: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash and the id of its *k*-th row by row id, for every hash and k of *wanted* (staged; the side has as many rows)."""
    steps = STEPS if wanted.count() <= FEW else STEPS_OF_MANY
    left = wanted.select(HASH, "k")
    for i, bits in enumerate(steps):
        rows = joined(side.select(RID, HASH), left, HASH)
        if i:
            rows = rows.where(F.shiftright(RID, steps[i - 1]) == F.col("cut"))
        per = rows.groupBy(HASH, F.shiftright(RID, bits).alias("cut")).agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k"))
        upto = F.sum("n").over(Window.partitionBy(HASH).orderBy("cut"))
        per = per.withColumn("before", upto - F.col("n")).where("before < k and k <= before + n")
        left = stage(per.select(HASH, "cut", (F.col("k") - F.col("before")).alias("k")), "last")
    return left.select(HASH, F.col("cut").alias("__c_last"))


def _ends(side: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash and the id up to which its rows cancel, for *wanted* (hash, own, other); -1 if none does."""
    wanted = stage(wanted, "unequal")
    some = stage(wanted.where("0 < other and other < own").select(HASH, F.col("other").alias("k")), "ranked")
    none = wanted.where("other = 0").select(HASH, F.lit(-1).cast("long").alias("__c_last"))
    every = wanted.where("other >= own").select(HASH, F.lit((1 << 63) - 1).alias("__c_last"))
    ends = none.unionByName(every)
    return stage(ends.unionByName(last_of(side, some)) if some.take(1) else ends, "ends")


def residual(side: DataFrame, counts: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of one side that found no equal row on the other."""
    ends = _ends(side, counts.where(F.col(own) > F.col(other)).select(HASH, F.col(own).alias("own"), F.col(other).alias("other")))
    return joined(side, ends, HASH).where(F.col(RID) > F.col("__c_last")).select(*side.columns)


def matched(side: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of the source that found an equal row in the target: row id and hash."""
    ends = _ends(side, counts.where("ns > 0 and nt > 0").select(HASH, F.col("ns").alias("own"), F.col("nt").alias("other")))
    return joined(side.select(RID, HASH), ends, HASH).where(F.col(RID) <= F.col("__c_last")).select(RID, HASH)
