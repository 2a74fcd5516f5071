"""From pairs of rows to discrepancies: one row per differing cell, and the rows without a partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions.fuzzy import fuzzy_equal
from concordia.functions.rows import composite_key, full_row, same_cell, shown
from concordia.operators.align import ONCE, ORIG, RID, TWICE
from concordia.options import Options

COLUMNS = ["discrepancy_type", "composite_key", "column_name", "source_value", "target_value", "full_source_row", "full_target_row"]


def cell_differences(pairs: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], options: Options) -> DataFrame:
    """VALUE_MISMATCH and KEY_VALUE_MISMATCH rows of matched pairs; the unpivot is an array in the JVM, not a join."""
    side = lambda d, p: d.select(F.col(RID).alias(f"{p}_rid"), *[F.col(x).alias(f"{p}_{n}") for x, n in ((ORIG, "orig"), (ONCE, "once"), (TWICE, "twice"))])
    rows = pairs.join(side(source, "s"), "s_rid").join(side(target, "t"), "t_rid")
    cells = []
    for c in columns:
        s, t = F.col(f"s_once.`{c}`"), F.col(f"t_once.`{c}`")
        differs = ~same_cell(s, t, ignore_case=options.normalise)
        if c in keys:
            s2, t2 = F.col(f"s_twice.`{c}`"), F.col(f"t_twice.`{c}`")
            loose = F.col("is_fuzzy") & (fuzzy_equal(s2, t2, options.tolerance, options.tolerance_share) != "EXACT")
            s, t, differs = F.when(loose, s2).otherwise(s), F.when(loose, t2).otherwise(t), loose | differs
        kind = "KEY_VALUE_MISMATCH" if c in keys else "VALUE_MISMATCH"
        cells.append(F.struct(F.lit(kind).alias("discrepancy_type"), F.lit(c).alias("column_name"), shown(s).alias("source_value"), shown(t).alias("target_value"), differs.alias("differs")))
    key = lambda p: composite_key(keys, [F.col(f"{p}_once.`{c}`") for c in keys])
    label = F.when(F.col("is_fuzzy"), F.concat(key("s"), F.lit(" ~> "), key("t"))).otherwise(key("s"))
    full = lambda p: full_row([F.col(f"{p}_orig.`{c}`") for c in columns])
    found = rows.withColumn("d", F.filter(F.array(*cells), lambda x: x["differs"])).where(F.size("d") > 0)
    found = found.select(label.alias("composite_key"), full("s").alias("full_source_row"), full("t").alias("full_target_row"), F.inline("d"))
    return found.select(*COLUMNS)


def missing_rows(side: DataFrame, pairs: DataFrame, keys: list[str], columns: list[str], label: str) -> DataFrame:
    """Rows of one residual without a partner: MISSING_IN_<label>."""
    own = "s_rid" if label == "TARGET" else "t_rid"
    rows = side.join(pairs.select(F.col(own).alias(RID)), RID, "left_anti")
    row, none = full_row([F.col(f"{ORIG}.`{c}`") for c in columns]), F.lit("ROW_NOT_FOUND")
    left, right = (row, none) if label == "TARGET" else (none, row)
    return rows.select(
        F.lit(f"MISSING_IN_{label}").alias("discrepancy_type"), composite_key(keys, [F.col(f"{ONCE}.`{c}`") for c in keys]).alias("composite_key"),
        F.lit("ALL").alias("column_name"), left.alias("source_value"), right.alias("target_value"), left.alias("full_source_row"), right.alias("full_target_row"),
    )
