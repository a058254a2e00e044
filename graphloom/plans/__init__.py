"""Registered queries, one module per family of operators."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package, so that its queries are registered."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
