"""Registered queries over the given tables, with the SQL each is checked against."""

from importlib import import_module

MODULES = ("profiles", "structure", "searches", "pruning", "cleaning", "contracts", "validation", "tables", "sources")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tablesight.catalog.{name}")
