"""All queries of the library proper."""

from rainloom.plans import calibrated, coasts, fields, learning, projected, series, tables, validation, verification  # noqa: F401
from rainloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
