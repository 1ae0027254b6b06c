"""All registered queries: importing the modules of ``opsloom.plans`` fills the registry."""

from __future__ import annotations

import importlib
import pkgutil

import opsloom.plans
from opsloom.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(opsloom.plans.__path__)):
    if _m.startswith("q_"):
        importlib.import_module(f"opsloom.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
