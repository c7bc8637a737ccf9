"""Text helpers: trimming, globs and boolean search expressions."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.fixed import ELLIPSIS

BLANKS = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.trim(col, F.lit(BLANKS))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def is_blank(col: Column) -> Column:
    return F.coalesce(F.length(strip(col)) == 0, F.lit(True))


def cut(col: Column, limit: int) -> Column:
    """The first ``limit`` characters; no limit when it is zero or less."""
    return col if limit <= 0 else F.substring(col, 1, limit)


def ellipsize(col: Column, limit: int) -> Column:
    """Shorten to ``limit`` characters with a closing ellipsis."""
    if limit <= 0:
        return col
    short = F.concat(F.substring(col, 1, limit - 1), F.lit(ELLIPSIS))
    return F.when(F.length(col) <= limit, col).otherwise(short)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def any_of(predicates: list[Column]) -> Column:
    result = F.lit(False)
    for predicate in predicates:
        result = result | predicate
    return result


def all_of(predicates: list[Column]) -> Column:
    result = F.lit(True)
    for predicate in predicates:
        result = result & predicate
    return result


def first_non_null(columns: list[Column]) -> Column:
    return F.coalesce(*columns) if columns else F.lit(None)


# --- globs -------------------------------------------------------------------------------------------------


def glob_pattern(glob: str | None) -> str:
    """A comma list of shell globs as one anchored regular expression."""
    branches = []
    for part in (glob or "*").split(","):
        part = part.strip()
        if part:
            branches.append(re.sub(r"\[!", "[^", "".join(_glob_token(t) for t in re.findall(r"\[!?[^\]]+\]|.", part))))
    return "^(?s:" + "|".join(branches) + ")$" if branches else "a^"


def _glob_token(token: str) -> str:
    if len(token) > 1:
        return token
    return {"*": ".*", "?": "."}.get(token, re.escape(token))


def glob_matches(name: Column, glob: str | None) -> Column:
    return name.rlike(glob_pattern(glob))


# --- boolean search ----------------------------------------------------------------------------------------

_TOKEN = re.compile(r""""(?P<dq>(?:\\.|[^"\\])*)"|'(?P<sq>(?:\\.|[^'\\])*)'|(?P<paren>[()])|(?P<word>[^\s()"'][^\s()]*)|(?P<bad>\S)""")
_FOLLOWS = {  # what may come after what, once implied ANDs are in place
    "start": "TN(",
    "A": "TN(",
    "O": "TN(",
    "N": "TN(",
    "(": "TN(",
    "T": "AO)e",
    ")": "AO)e",
}


class SearchSyntaxError(ValueError):
    """The boolean search text is malformed."""


def _tokens(query: str) -> list[tuple[str, str]]:
    found: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(query):
        if m["bad"] is not None:
            raise SearchSyntaxError("unclosed quote in search text")
        word = m["word"]
        if m["paren"]:
            kind, text = m["paren"], m["paren"]
        elif word is not None and word.upper() in ("AND", "OR", "NOT"):
            kind, text = word.upper()[0], word.upper()
        else:
            kind, text = "T", next(g for g in (m["dq"], m["sq"], word) if g is not None)
        if found and found[-1][0] in "T)" and kind in "TN(":
            found.append(("A", "AND"))
        found.append((kind, text))
    return found


def _check(tokens: list[tuple[str, str]]) -> None:
    depth, previous = 0, "start"
    for kind, text in [*tokens, ("e", "end of text")]:
        if kind not in _FOLLOWS[previous]:
            raise SearchSyntaxError(f"unexpected {text!r} in search text")
        depth += {"(": 1, ")": -1}.get(kind, 0)
        if depth < 0:
            raise SearchSyntaxError("unbalanced parenthesis in search text")
        previous = kind
    if depth:
        raise SearchSyntaxError("missing closing parenthesis in search text")


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def boolean_search(column: str, query: str, *, case_sensitive: bool = False) -> Column:
    """AND / OR / NOT, implied AND, parentheses and quoted phrases as one predicate.

    Terms become ``contains`` calls and the rest is handed to Spark's own expression parser, whose precedence
    (NOT over AND over OR) is the one of the search language.
    """
    tokens = _tokens(query)
    _check(tokens)
    subject = f"`{column}`" if case_sensitive else f"lower(`{column}`)"
    parts = []
    for kind, text in tokens:
        if kind == "T":
            term = text if case_sensitive else text.lower()
            parts.append(f"contains({subject}, {_sql_text(term)})")
        else:
            parts.append(text)
    return F.expr("(" + " ".join(parts) + ")")


def highlight_terms(query: str, *, case_sensitive: bool = False) -> list[str]:
    """The terms of a search text in order, without repeats."""
    seen: dict[str, str] = {}
    for kind, text in _tokens(query):
        if kind == "T" and text:
            seen.setdefault(text if case_sensitive else text.lower(), text)
    return list(seen.values())


def all_terms(column: Column, query: str) -> Column:
    """Every white-space separated term must occur; ``%`` and ``_`` in terms act as wildcards."""
    return all_of([F.lower(column).like(f"%{term}%") for term in query.lower().split()])


def jvm_pattern(pattern: str) -> str | None:
    """A user's pattern as the JVM reads it, None where either side refuses it.

    Named groups become plain ones with the same numbers, and back references to them go by number.
    """
    try:
        groups = re.compile(pattern).groupindex
    except re.error:
        return None
    plain = re.sub(r"\(\?P=(\w+)\)", lambda m: f"(?:\\{groups[m[1]]})", pattern)
    plain = re.sub(r"\(\?P<\w+>", "(", plain)
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(plain)
        except (Py4JJavaError, PySparkException):
            return None
    return plain


def valid_regex(pattern: str) -> bool:
    return jvm_pattern(pattern) is not None


def regex_search(column: Column, pattern: str) -> Column:
    """Case-insensitive match anywhere; a malformed pattern matches nothing and never fails the job."""
    plain = jvm_pattern(pattern)
    return F.lit(False) if plain is None else column.rlike("(?i)" + plain)


def query_predicate(column: str, query: str, mode: str) -> Column:
    """The predicate of an alert rule or saved search; malformed boolean text falls back to all terms."""
    if mode == "regex":
        return regex_search(F.col(column), query)
    try:
        return boolean_search(column, query)
    except SearchSyntaxError:
        words = query.lower().split()
        if not words:
            return F.lit(False)
        return all_of([F.lower(F.col(column)).contains(word) for word in words])
