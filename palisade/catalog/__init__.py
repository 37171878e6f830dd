"""Registered queries and their SQL twins."""

import importlib

FAMILIES = ["events", "temporal", "detection", "datasets", "evaluation", "learning", "streams", "jobs"]


def load():
    """All registered queries and twins, by name."""
    from palisade.catalog import registry

    for family in FAMILIES:
        importlib.import_module(f"palisade.catalog.{family}")
    return registry.QUERIES, registry.TWINS
