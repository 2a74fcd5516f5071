"""Relational building blocks of a reconciliation: alignment, bag matching, keys, pairing, cell differences."""
