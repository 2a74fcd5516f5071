"""Where reports go."""

from concordia.sinks.report import write_report

__all__ = ["write_report"]
