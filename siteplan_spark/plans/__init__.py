"""Registered queries, grouped by the stage of the work they belong to."""

from importlib import import_module

MODULES = ("staging", "supply", "access", "allocation", "modelling", "siting", "checks")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
