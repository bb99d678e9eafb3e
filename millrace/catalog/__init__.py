"""All registered queries."""

import importlib
import pkgutil

from .registry import ORACLES, QUERIES, Tables, query

for _m in pkgutil.iter_modules(__path__):
    if _m.name != "registry":
        importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["ORACLES", "QUERIES", "Tables", "query"]
