"""Named queries over the given tables."""

from importlib import import_module

SECTIONS = ("changes", "stalls", "ledger", "answers", "runlogs", "texts", "graphs", "gates")


def load_all() -> None:
    """Import every section; importing registers its queries."""
    for name in SECTIONS:
        import_module(f"hindsight.plans.{name}")
