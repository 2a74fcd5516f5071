"""Settings of a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass, field

from concordia.functions.patterns import NAME_PATTERNS


@dataclass(frozen=True)
class Options:
    """How two tables are compared.

    ``keys``               key columns; None: detected from what is left after exact matching
    ``normalise``          canonicalise cells; off: only empty, nan and nat are null, and cells compare by case
    ``decimal_precision``  decimals that floats are rounded to
    ``timestamp_precision`` fraction digits that timestamps keep; None: none
    ``tolerance``, ``tolerance_share``  numeric slack of fuzzy keys, absolute and relative
    ``strict_parity``      hash the canonical form of the canonical form, as the reference behaviour has it;
                           off: canonicalise once
    ``exact_floats``       round floats that text rules cannot (halves, exponents) by exact arithmetic; off: leave them
    ``order_by``           columns that define row order, which breaks ties; None: the order of the input
    ``exclude``            name patterns of columns that are no key candidates
    ``max_group``          most rows of one fuzzy-key group that the greedy matcher takes into one task
    """

    keys: tuple[str, ...] | None = None
    normalise: bool = True
    decimal_precision: int = 6
    timestamp_precision: int | None = None
    tolerance: float = 100.0
    tolerance_share: float = 0.01
    strict_parity: bool = True
    exact_floats: bool = True
    order_by: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = field(default=NAME_PATTERNS)
    max_group: int = 50_000
