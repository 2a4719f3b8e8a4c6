"""Imports every query module so that the registry is filled."""

from __future__ import annotations

import importlib

MODULES = ("history", "search", "logs", "evidence", "incidents", "stabilize", "extras", "flows")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"reliq.workload.{name}")
