"""Whole plans built from the operators."""

from concordia.plans.reconcile import Reconciliation, reconcile

__all__ = ["Reconciliation", "reconcile"]
