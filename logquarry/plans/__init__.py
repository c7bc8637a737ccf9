"""Runnable queries over a data folder, each with an independent SQL statement where one can express it."""

from __future__ import annotations

import importlib

from logquarry.plans.base import PLANS, Plan

_MODULES = ["parsing", "searching", "joining", "files", "analysing", "streams"]


def load() -> dict[str, Plan]:
    for name in _MODULES:
        importlib.import_module(f"logquarry.plans.{name}")
    return PLANS
