"""Named queries over the driver tables, grouped by area."""

from importlib import import_module

AREAS = ("catalog", "framing", "routing", "operations", "detection", "layout", "streams")


def load_all() -> None:
    for area in AREAS:
        import_module(f"framejobs.plans.{area}")
