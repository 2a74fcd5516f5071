"""Column functions: canonical cells, fuzzy keys, row renderings."""

from concordia.functions.canonical import canonical, canonical_pair, strip, with_canonical
from concordia.functions.fuzzy import fuzzy_equal, fuzzy_index_key, fuzzy_key
from concordia.functions.rows import composite_key, full_row, matching_columns, row_hash, shortened

__all__ = [
    "canonical", "canonical_pair", "strip", "with_canonical", "fuzzy_equal", "fuzzy_index_key", "fuzzy_key", "composite_key", "full_row",
    "matching_columns", "row_hash", "shortened",
]
