"""All registered queries."""

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> None:
    from . import cleanup, features, functions, kept, lookups, merged, more, names_rules, refreshed, reports, source_text, structure, traces, trees  # noqa: F401
