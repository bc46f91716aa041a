"""Tidewater: an analytics engine on Spark SQL and DataFrames."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

#: Where the public names live; they load when first used, so that a worker that needs one module loads no other.
_HOMES = {
    "EngineError": "tidewater.errors",
    "Frame": "tidewater.frame",
    "Session": "tidewater.session",
    "SessionOptions": "tidewater.session",
    **dict.fromkeys(("avg", "col", "count", "lit", "max", "min", "sum"), "pyspark.sql.functions"),
}
__all__ = list(_HOMES)


def __getattr__(name: str):
    if name in _HOMES:
        return getattr(importlib.import_module(_HOMES[name]), name)
    raise AttributeError(name)
