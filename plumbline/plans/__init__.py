"""Queries by family; importing a family registers its queries."""

from __future__ import annotations

import importlib

FAMILIES = ("rules", "relations", "sequences", "texts", "networks", "plans")


def load():
    """The registry with every family imported."""
    for name in FAMILIES:
        importlib.import_module(f"plumbline.plans.{name}")
    return importlib.import_module("plumbline.plans.registry")
