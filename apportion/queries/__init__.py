"""Named queries over the given tables."""

from importlib import import_module

MODULES = ("relational", "aggregates", "scalars", "windows", "iterative", "models", "files", "streams")


def load() -> None:
    for name in MODULES:
        import_module(f"apportion.queries.{name}")
