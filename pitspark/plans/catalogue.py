"""All registered queries."""

from __future__ import annotations

import importlib

from pitspark.plans.registry import ORACLES, QUERIES

MODULES = ("joins", "series", "sources", "quality", "visibility", "scalars", "aggregates",
           "labels", "strategies", "backtests", "calibration", "sizing", "news", "analysis", "extended", "flagship")

MODULE_OF: dict[str, str] = {}
for _m in MODULES:
    importlib.import_module(f"pitspark.plans.{_m}")
    for _q in QUERIES:
        MODULE_OF.setdefault(_q, _m)

__all__ = ["MODULE_OF", "ORACLES", "QUERIES"]
