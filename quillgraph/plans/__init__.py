"""Registered queries over the given tables."""

from importlib import import_module

CATALOGUE = ("ingest", "graphs", "answers", "updates")


def load_all() -> None:
    """Import every catalogue module, which registers its queries."""
    for name in CATALOGUE:
        import_module(f"quillgraph.plans.{name}")
