"""The four severity judgements. They differ on purpose and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import fixed
from logquarry.functions.text import any_of, is_blank, strip


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def line_pri(line: Column) -> Column:
    """Number in a leading ``<n>``, null when there is none."""
    return F.regexp_extract(line, fixed.PRI_AT_START, 1).try_cast("int")


def unalias(name: Column) -> Column:
    key = strip(F.lower(name))
    return F.coalesce(F.try_element_at(literal_map(fixed.SEVERITY_ALIASES), key), key)


def classify_severity(line: Column) -> Column:
    """PRI digit, else a JSON level, else a level word, else a failure phrase, else ``unknown``."""
    by_number = F.element_at(F.array(*[F.lit(s) for s in fixed.SEVERITY_BY_NUMBER]), line_pri(line) % 8 + 1)
    return (
        F.when(is_blank(line), "unknown")
        .when(line_pri(line).isNotNull(), by_number)
        .when(line.rlike(fixed.JSON_LEVEL), unalias(F.regexp_extract(line, fixed.JSON_LEVEL, 1)))
        .when(line.rlike(fixed.LEVEL_WORD), unalias(F.regexp_extract(line, fixed.LEVEL_WORD, 1)))
        .when(line.rlike(fixed.FAILURE_PHRASE), "error")
        .otherwise("unknown")
    )


def severity_rank(name: Column) -> Column:
    ranks = literal_map(fixed.SEVERITY_RANK)
    return F.coalesce(F.try_element_at(ranks, name), F.lit(fixed.SEVERITY_RANK["unknown"]))


def floor_rank(floor: str) -> int:
    name = fixed.SEVERITY_ALIASES.get(floor.lower().strip(), floor.lower().strip())
    if name not in fixed.SEVERITY_FLOORS:
        raise ValueError(f"severity floor must be one of {', '.join(fixed.SEVERITY_FLOORS)}")
    return fixed.SEVERITY_RANK[name]


def at_least(line: Column, floor: str | None) -> Column:
    return F.lit(True) if not floor else severity_rank(classify_severity(line)) >= floor_rank(floor)


def is_failure(line: Column) -> Column:
    """PRI severity 0-3, a failure level word, or a failure phrase."""
    urgent = F.coalesce(line_pri(line) % 8 <= 3, F.lit(False))
    words = line.rlike(fixed.FAILURE_LEVEL_WORD) | line.rlike(fixed.FAILURE_PHRASE)
    return ~is_blank(line) & (urgent | words)


def is_low_level(line: Column) -> Column:
    """Blank, info, debug or trace: not worth a model call."""
    quiet = F.coalesce(line_pri(line) % 8 >= 6, F.lit(False))
    return is_blank(line) | quiet | line.rlike(fixed.LOW_LEVEL_MARK)


def event_importance(action: Column, log_type: Column, message: Column, verdict: Column) -> Column:
    """Blocked action, threat log, words of the message, then the model's verdict."""
    text = F.lower(F.coalesce(message, F.lit("")))

    def has(words):
        return any_of([text.contains(w) for w in words])

    return (
        F.when(F.lower(action).isin(fixed.IMPORTANCE_BLOCKED), "error")
        .when(log_type == "THREAT", "critical")
        .when(has(fixed.IMPORTANCE_CRITICAL_WORDS), "critical")
        .when(has(fixed.IMPORTANCE_ERROR_WORDS), "error")
        .when(has(fixed.IMPORTANCE_WARNING_WORDS), "warning")
        .when(verdict.isin("critical", "high"), "error")
        .when(verdict == "medium", "warning")
        .otherwise("info")
    )


def importance_rank(name: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fixed.IMPORTANCE_RANK), name), F.lit(0))
