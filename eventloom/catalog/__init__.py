"""All registered queries."""

from . import composite, corpus, events, graph, landed  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
