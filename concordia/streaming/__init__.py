"""Reconciliation of a stream against a table."""

from concordia.streaming.incremental import reconcile_stream

__all__ = ["reconcile_stream"]
