"""Named queries over the standard tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tablewright.registry.base import ORACLES, QUERIES
from tablewright.registry import cleaning, ddl, profiling, questions, relations, sources  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
