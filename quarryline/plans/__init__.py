"""Registered queries."""

from . import dense, lexical, lifecycle, web  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
