"""Registered queries and the SQL they are checked against."""

import importlib
import pkgutil

from .registry import ORACLES, QUERIES


def load_all():
    """Import every plan module once and return (queries, SQL texts)."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "registry"):
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
