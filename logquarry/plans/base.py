"""Registration of runnable queries: a key, a DataFrame over a data folder, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.bridge import Bridge


@dataclass(frozen=True)
class Plan:
    key: str
    run: Callable[[Bridge], DataFrame]
    sql: str | None = None


PLANS: dict[str, Plan] = {}


def plan(key: str, sql: str | None = None):
    """Register a function of a bridge under a key."""

    def register(run: Callable[[Bridge], DataFrame]):
        if key in PLANS:
            raise ValueError(f"{key} is registered twice")
        PLANS[key] = Plan(key, run, sql)
        return run

    return register


def us(column: str | Column) -> Column:
    """A time as microseconds: the same number in every engine."""
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# Reference times inside the data: the newest events are of late January 2024, the newest orders of 2001.
EVENTS_NOW = "2024-01-28 00:00:00"
ANALYSES_NOW = "2001-06-30 12:00:00"
