"""Operators of a training-data pipeline over documents and pages, with their registered queries."""

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
