"""Registered queries by area."""

import importlib
import pkgutil


def load() -> None:
    for mod in pkgutil.iter_modules(__path__):
        if mod.name not in ("registry", "prelude"):
            importlib.import_module(f"{__name__}.{mod.name}")
