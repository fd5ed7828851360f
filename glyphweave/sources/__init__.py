"""Inputs and outputs: Spark's own readers and writers, and the log of clerical decisions."""

from glyphweave.operators.review import read_decisions
from glyphweave.sources.decisions import append_decisions

__all__ = ["append_decisions", "read_decisions"]
