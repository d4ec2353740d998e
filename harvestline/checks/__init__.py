"""Registered queries, each with the SQL that checks it."""

from importlib import import_module

_MODULES = ["sources", "quality", "functions", "joins", "aggregates", "workflow", "serving",
            "streaming", "model", "gold", "mirrors"]


def load_all() -> None:
    """Import every module that registers queries. `gold` first: others use its views."""
    for name in sorted(_MODULES, key=lambda n: n != "gold"):
        import_module(f"{__name__}.{name}")
