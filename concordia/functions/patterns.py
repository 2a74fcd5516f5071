"""Names of columns that rarely identify rows."""

from __future__ import annotations

# Patterns of column names that key detection leaves out, matched from the start, whatever the case.
NAME_PATTERNS: tuple[str, ...] = (
    r".*_?DESC.*", r".*_?DESCRIPTION.*", r".*_?COMMENT.*", r".*_?NOTE.*", r".*_?TEXT.*",
    r".*_?AMOUNT.*", r".*_?VALUE.*", r".*_?PRICE.*", r".*_?QUANTITY.*", r".*_?QTY.*",
    r".*_?BALANCE.*", r".*_?TOTAL.*", r".*_?PERCENT.*", r".*_?PCT.*", r".*_?RATIO.*", r".*_?RATE.*",
    r"CREATED.*", r"UPDATED.*", r"MODIFIED.*",
    r".*_?TIMESTAMP.*", r".*_?DATETIME.*", r".*_?TIME$", r".*_?DT$", r".*_?TS$",
    r".*_?FILE.*", r".*_?PATH.*", r".*_?FILENAME.*",
    r".*_?LOAD.*", r".*_?ETL.*", r".*_?BATCH.*", r".*_?RUN.*", r".*_?PROCESS.*",
    r".*_?AUDIT.*", r".*_?INSERT.*", r".*_?UPDATE.*",
    r"^ROW_.*", r".*_?SOURCE$", r".*_?SRC$", r".*_?NAME$", r"^NAME_?.*",
    r".*_?STATUS.*", r".*_?FLAG.*", r".*_?IND$", r".*_?INDICATOR.*",
    r".*_?UUID.*", r".*_?GUID.*", r".*_?HASH$",
    r"^EDD_.*", r"^ETL_.*", r"^DW_.*", r"^DWH_.*",
    r".*_?EXTRACT_.*", r"^EXTRACT_.*",
    r"^GENERATED_.*", r".*_GENERATED$",
)
