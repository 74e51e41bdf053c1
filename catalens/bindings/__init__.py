"""Operators bound to the test tables, each with an equivalent SQL text where there is one."""

from importlib import import_module

MODULES = ["catalog", "rules", "text", "notes", "survival"]


def registries():
    return [import_module(f"{__name__}.{m}").R for m in MODULES]
