"""All registered queries."""

from importlib import import_module

from .registry import QUERIES, SQL

for _m in ("keys", "flags", "scalar", "series", "joins", "stats", "responses", "grids", "trees", "lagreg", "features", "sources", "datasets", "streams", "extensions"):
    import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "SQL"]
