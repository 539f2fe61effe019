"""Every operator as a named query over the driver's tables, with its SQL counterpart."""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _module in ("rollups", "live", "quality", "schedule", "windows", "scalars", "feeds", "merges", "streams"):
    import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
