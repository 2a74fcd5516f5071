"""Shared plumbing of the training-data operators: staging, joins that spread hot keys, components."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.staging import discard, fresh_folder, shared_folder, stage

__all__ = ["WORD", "components", "discard", "fresh_folder", "release", "shared_folder", "ship", "spread_join", "stage", "tidy", "uniform_bucket"]

#: Words as every contract here defines them: runs without space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: At most so many keys of a join are looked up by broadcast; fewer rows than LEAST_HOT are never hot.
MOST_HOT, LEAST_HOT = 1000, 1000


def ship(name: str) -> None:
    """Pickle the functions of a module by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete shuffle files of plans that nothing refers to any more.

    Loops over large tables call it after each pass: the driver's own collections may be far between.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run):
    """*run*, a function for ``mapInArrow``, that gives the memory it freed back to the system when its task ends.

    Spark keeps Python workers for the next stages.  Arrow's pool and malloc keep what was freed, so that an idle
    worker would hold the peak of an earlier stage beside the JVM's.
    """

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc has it, musl does not
            trim(0)

    return tidied


def uniform_bucket(key, buckets):
    """Range of a uniform 64-bit hash among *buckets* equal ranges (order-preserving in the unsigned hash)."""
    return F.floor(F.shiftrightunsigned(key, 1).cast("double") / F.lit(float(2**63)) * buckets).cast("long")


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """*rows* joined to *facts* (one row a key), whatever share of the rows one key holds.

    *count* of facts says how many of the *total* rows a key has.  Keys with more than 1 / MOST_HOT of them, so
    fewer than MOST_HOT keys, are looked up by broadcast and their rows stay where they are; all others meet by
    shuffle, at most a thousandth of the rows in one task.
    """
    most = max(LEAST_HOT, total // MOST_HOT)
    hot = F.broadcast(facts.where(F.col(count) > most).drop(count))
    cold = facts.where(F.col(count) <= most).drop(count)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on, how))


def components(edges: DataFrame, label: str = "cc", rounds: int = 40) -> DataFrame:
    """Connected components of an undirected edge list.

    *edges* has long columns ``a`` and ``b``.  Returns one row per node that occurs in an edge:
    ``node``, ``root`` (the smallest node of its component).  Alternates the large-star and
    small-star steps of Kiveris et al. (2014): every step is a grouped minimum plus one join, the
    edge list never grows, and a node with a large share of all edges is spread over tasks
    (``spread_join``), never a collected list.  Each round is written to the shared
    folder, so that a lost executor costs one round; the round before it is deleted then.  The
    number of rounds grows with the logarithm of the longest path; more than *rounds* is an error.
    """
    cur = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    cur = stage(cur, label)
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(cur)
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both.where("v > u"), low, ["u"], "n", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, low, ["u"], "n", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, cur = cur, stage(small, label)
        discard(last)
        if (now := mark(cur)) == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
