"""Registered queries, one module per family of operators."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Imports every module of this package, so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
