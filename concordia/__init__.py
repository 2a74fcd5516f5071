"""Table reconciliation on Spark: what differs between two tables, and why."""

from concordia.options import Options
from concordia.plans.reconcile import Reconciliation, reconcile
from concordia.sources.delimited import read_delimited

__all__ = ["Options", "Reconciliation", "read_delimited", "reconcile"]
