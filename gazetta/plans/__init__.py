"""Registered queries over the driver's tables, each beside its oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def load():
    """Import every module of this package, so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return registry
