"""Every query by name, with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from cityflux.registry.base import ORACLES, QUERIES

_MODULES = ["scans", "rollup", "serving", "cleaning", "features", "describe", "evaluation", "models", "streaming"]
for _name in _MODULES:
    import_module(f"cityflux.registry.{_name}")

__all__ = ["ORACLES", "QUERIES"]
