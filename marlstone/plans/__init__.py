"""Importing this package registers every query."""

import importlib
import pkgutil

from marlstone.plans.registry import ENTRIES, Entry, query

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ENTRIES", "Entry", "query"]
