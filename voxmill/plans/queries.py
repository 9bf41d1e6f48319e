"""All registered queries."""

from . import interiors, mapping, studies, surfaces  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
