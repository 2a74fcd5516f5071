"""The reconciliation of two tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.functions.rows import shortened
from concordia.operators.align import ONCE, RID, as_text, common_columns, prepared, upper_names
from concordia.operators.bag import hash_counts, residual
from concordia.operators.cells import COLUMNS, cell_differences, missing_rows
from concordia.operators.duplicates import count_mismatches, duplicate_keys, duplicate_rows
from concordia.operators.keys import detect_key
from concordia.operators.pairing import pair_rows
from concordia.options import Options
from concordia.sources.delimited import read_delimited
from concordia.staging import stage

log = logging.getLogger(__name__)
SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in COLUMNS])


@dataclass
class Reconciliation:
    """Two prepared tables and everything that can be asked about their difference.

    Each part is a DataFrame and is planned when asked for; what several parts use is staged once.
    """

    source: DataFrame
    target: DataFrame
    columns: list[str]
    only_source: list[str]
    only_target: list[str]
    options: Options

    @cached_property
    def counts(self) -> DataFrame:
        """hash, ns, nt."""
        return hash_counts(self.source, self.target)

    @cached_property
    def unequal(self) -> DataFrame:
        """The counts of hashes that the sides don't have equally often."""
        return stage(self.counts.where("ns <> nt"), "counts")

    @cached_property
    def source_residual(self) -> DataFrame:
        return stage(residual(self.source, self.unequal, "ns", "nt"), "source-residual")

    @cached_property
    def target_residual(self) -> DataFrame:
        return stage(residual(self.target, self.unequal, "nt", "ns"), "target-residual")

    @cached_property
    def settled(self) -> bool:
        """Whether every row found an equal one."""
        return not self.source_residual.take(1) and not self.target_residual.take(1)

    @cached_property
    def keys(self) -> list[str]:
        """The named key columns, or the detected ones."""
        if self.options.keys:
            names = [k.strip().upper() for k in self.options.keys]
            if unknown := [k for k in names if k not in self.columns]:
                raise ValueError(f"no such common column: {', '.join(unknown)}; there are {', '.join(self.columns)}")
            return names
        rows = self.source_residual.select(RID, *[F.col(f"{ONCE}.`{c}`").alias(c) for c in self.columns])
        found = detect_key(rows, self.columns, RID, self.options.exclude)
        log.info("key columns: %s", ", ".join(found))
        return found

    @cached_property
    def duplicate_target_keys(self) -> int:
        """Keys that more than one unmatched target row has, so that pairing them is a choice."""
        return duplicate_keys(self.target_residual, self.keys, ONCE).count()

    @cached_property
    def pairs(self) -> DataFrame:
        """s_rid, t_rid, is_fuzzy."""
        if n := self.duplicate_target_keys:
            log.warning("%d keys stand more than once in the unmatched target rows", n)
        return stage(pair_rows(self.source_residual, self.target_residual, self.keys, self.columns, self.options), "pairs")

    @cached_property
    def count_mismatches(self) -> DataFrame:
        return count_mismatches(self.unequal)

    def duplicates(self, label: str) -> DataFrame:
        """DUPLICATE_IN_SOURCE or DUPLICATE_IN_TARGET rows."""
        return duplicate_rows(self.source if label == "SOURCE" else self.target, self.keys, self.columns, label)

    def missing(self, label: str) -> DataFrame:
        """MISSING_IN_TARGET or MISSING_IN_SOURCE rows."""
        return missing_rows(self.source_residual if label == "TARGET" else self.target_residual, self.pairs, self.keys, self.columns, label)

    @cached_property
    def mismatches(self) -> DataFrame:
        """VALUE_MISMATCH and KEY_VALUE_MISMATCH rows."""
        return cell_differences(self.pairs, self.source_residual, self.target_residual, self.keys, self.columns, self.options)

    @cached_property
    def discrepancies(self) -> DataFrame:
        """All discrepancies, unordered."""
        if self.settled:
            return self.source.sparkSession.createDataFrame([], SCHEMA)
        parts = [
            self.count_mismatches, self.duplicates("SOURCE"), self.duplicates("TARGET"), self.mismatches, self.missing("TARGET"), self.missing("SOURCE"),
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def report(self) -> DataFrame:
        """Discrepancies by type, key and column."""
        return self.discrepancies.orderBy("discrepancy_type", "composite_key", "column_name")

    def by_type(self) -> DataFrame:
        return self.discrepancies.groupBy("discrepancy_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "discrepancy_type")

    def top_columns(self, most: int = 10) -> DataFrame:
        """Columns with the most value mismatches."""
        rows = self.discrepancies.where("discrepancy_type = 'VALUE_MISMATCH'")
        return rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "column_name").limit(most)

    def sample(self, most: int = 5) -> DataFrame:
        """The first rows of the report, values shortened for display."""
        return self.report.limit(most).select("discrepancy_type", "composite_key", "column_name", shortened(F.col("source_value")).alias("source_value"), shortened(F.col("target_value")).alias("target_value"))

    def summary(self) -> DataFrame:
        """One row: rows on either side, matched exactly, matched by key, only in source, only in target."""
        n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
        parts = [
            n(self.source, "source_rows"), n(self.target, "target_rows"),
            self.counts.agg(F.coalesce(F.sum(F.least("ns", "nt")), F.lit(0)).alias("exact_matches")),
        ]
        if self.settled:
            zero = self.source.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("key_matches", "only_in_source", "only_in_target")])
            return reduce(DataFrame.crossJoin, [*parts, zero])  # one row each
        parts += [n(self.pairs, "key_matches"), n(self.missing("TARGET"), "only_in_source"), n(self.missing("SOURCE"), "only_in_target")]
        return reduce(DataFrame.crossJoin, parts)


def loaded(table: DataFrame | str) -> DataFrame:
    """A DataFrame as it is, a table by its name, a file or folder by its path: Parquet by its extension, else
    delimited text."""
    if isinstance(table, DataFrame):
        return table
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if "/" not in table and spark.catalog.tableExists(table):
        return spark.table(table)
    return spark.read.parquet(table) if table.rstrip("/").endswith(".parquet") else read_delimited(spark, table)


def reconcile(source: DataFrame | str, target: DataFrame | str, options: Options | None = None) -> Reconciliation:
    """Compare two tables (see :func:`loaded`); nothing but staging the prepared tables runs before a part is asked for."""
    options = options or Options()
    source, target = upper_names(loaded(source)), upper_names(loaded(target))
    both, left, right = common_columns(source, target)
    if not both:
        raise ValueError("the tables have no column name in common")
    s, t = (stage(prepared(as_text(d.select(*[F.col(f"`{c}`") for c in both])), both, options), n) for d, n in ((source, "source"), (target, "target")))
    return Reconciliation(s, t, both, left, right, options)
