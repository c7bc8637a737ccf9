"""Syslog framing, firewall CSV bodies and columnized lines as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import fixed
from logquarry.functions.text import any_of, blank_to_null, strip


@dataclass(frozen=True)
class FirewallMap:
    """0-based field numbers of a firewall CSV body."""

    log_type: int = 3
    subtype: int = 4
    src: int = 8
    dst: int = 9
    action: int = 13
    proto: int = 28
    sport: int = 29
    dport: int = 30
    time: int = 5

    @property
    def needed(self) -> int:
        return max(self.src, self.dst, self.log_type, self.subtype) + 1


def header_pri(raw: Column) -> Column:
    """The number of ``<n>…`` or ``<n>1 …`` at the start; more than three digits only in the second form."""
    short = F.regexp_extract(raw, r"^\s*<(\d{1,3})>", 1).try_cast("int")
    return F.coalesce(short, F.when(is_versioned(raw), F.regexp_extract(raw, r"^\s*<(\d+)>", 1).try_cast("int")))


def facility(pri: Column) -> Column:
    return F.floor(pri / 8).cast("int")


def is_versioned(raw: Column) -> Column:
    # blanks around the text do not count, so something must follow the version
    return raw.rlike(r"^\s*<(\d+)>\d+\s\s*\S")


def after_marker(text: Column) -> Column:
    """What follows the structured-data marker, null when there is none."""
    at = F.instr(text, fixed.STRUCTURED_MARKER)
    return F.when(at > 0, F.substr(text, at + len(fixed.STRUCTURED_MARKER)))


def bsd_message(raw: Column) -> Column:
    """Drop the PRI and the next two words; shorter texts stay whole."""
    body = F.regexp_replace(strip(raw), fixed.PRI_PREFIX, "")
    rest = F.regexp_extract(body, r"(?s)^\s*\S+\s+\S+\s+(\S.*)$", 1)
    return F.when(F.length(rest) > 0, strip(rest)).otherwise(body)


def structured_message(raw: Column) -> Column:
    return F.coalesce(strip(after_marker(raw)), bsd_message(raw))


def looks_like_firewall(text: Column) -> Column:
    """A firewall word and at least sixteen comma-separated parts."""
    words = any_of([text.contains(w) for w in fixed.FIREWALL_WORDS])
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    return words & (commas + 1 >= fixed.FIREWALL_MIN_PARTS)


# --- CSV ---------------------------------------------------------------------------------------------------


def csv_fields(body: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """Quote-aware fields of one CSV record as an array.

    ``from_csv`` needs a fixed number of columns; records here have as many as they like.
    """
    d, q = _in_class(delimiter), _in_class(quote)
    field = rf"\x{ord(delimiter):02x}(\x{ord(quote):02x}[^{q}]*(?:\x{ord(quote):02x}{{2}}[^{q}]*)*(?:\x{ord(quote):02x}[^{d}]*|$)|[^{d}]*)"
    parts = F.regexp_extract_all(F.concat(F.lit(delimiter), body), F.lit(field), F.lit(1))
    opened = rf"(?s)^\x{ord(quote):02x}(.*?)(?:\x{ord(quote):02x}([^{q}]*))?$"

    def unquote(f: Column) -> Column:
        inner = F.regexp_replace(f, opened, "$1$2")
        return F.when(f.startswith(quote), F.replace(inner, F.lit(quote * 2), F.lit(quote))).otherwise(f)

    plain = F.split(body, rf"\x{ord(delimiter):02x}")
    return F.when(body.contains(quote), F.transform(parts, unquote)).otherwise(plain)


def _in_class(char: str) -> str:
    return rf"\x{ord(char):02x}"


def field_at(fields: Column, index: int) -> Column:
    """A trimmed, non-empty field by 0-based number."""
    return blank_to_null(F.try_element_at(fields, F.lit(index + 1)))


def address_fields(fields: Column) -> Column:
    """The fields that look like IPv4 addresses, in order."""
    return F.filter(F.transform(fields, strip), lambda f: f.rlike(fixed.IPV4_SHAPE))


def action_after_protocol(fields: Column) -> Column:
    """The field after the first protocol name that has a successor."""
    heads = F.slice(fields, F.lit(1), F.greatest(F.size(fields) - 1, F.lit(0)))
    is_protocol = F.transform(heads, lambda f: F.lower(strip(f)).isin(fixed.PROTOCOLS))
    at = F.array_position(is_protocol, F.lit(True))
    return F.when(at > 0, F.lower(strip(F.try_element_at(fields, (at + 1).cast("int")))))


def firewall_time(field: Column) -> Column:
    text = F.substring(strip(field), 1, 32)
    shape = r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$"
    return F.when(text.rlike(shape), F.translate(text, "/", "-").try_cast("timestamp"))


def firewall_payload_fields(message: Column) -> Column:
    """Plain comma fields of a firewall message, found by the marker or by ``n,yyyy/mm/dd``; null when absent."""
    by_shape = F.regexp_extract(message, r"(?s)" + fixed.PAYLOAD_START + r".*$", 0)
    payload = F.coalesce(strip(after_marker(message)), strip(by_shape))
    fields = F.split(payload, ",")
    return F.when((F.length(payload) > 0) & (F.size(fields) >= 4), fields)


def payload_type(fields: Column) -> Column:
    return F.upper(strip(F.try_element_at(fields, F.lit(4))))


# --- columnized lines --------------------------------------------------------------------------------------

SYSLOG_FIELDS = ["timestamp", "host", "unit", "pid", "message"]


def syslog_columns(line: Column) -> Column:
    """timestamp, host, unit, pid and message of an ISO or BSD style line; otherwise the line as message."""
    iso, bsd = fixed.ISO_TIME + fixed.LINE_REST, fixed.BSD_TIME + fixed.LINE_REST

    def group(pattern: str, index: int) -> Column:
        return F.regexp_extract(line, pattern, index)

    bsd_time = F.concat_ws(" ", group(bsd, 1), group(bsd, 2), group(bsd, 3))
    by_iso = [group(iso, i) for i in range(1, 6)]
    by_bsd = [bsd_time] + [group(bsd, i) for i in range(4, 8)]
    neither = [F.lit("")] * 4 + [line]

    def struct(values):
        return F.struct(*[v.alias(n) for n, v in zip(SYSLOG_FIELDS, values, strict=True)])

    return F.when(line.rlike(iso), struct(by_iso)).when(line.rlike(bsd), struct(by_bsd)).otherwise(struct(neither))


def syslog_map(line: Column) -> Column:
    parsed = syslog_columns(line)
    return F.create_map(*[x for n in SYSLOG_FIELDS for x in (F.lit(n), parsed[n])])


def csv_map(line: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """col1 … colN of a delimited line."""
    fields = csv_fields(line, delimiter, quote)
    names = F.transform(F.sequence(F.lit(1), F.size(fields)), lambda i: F.concat(F.lit("col"), i.cast("string")))
    return F.map_from_arrays(names, fields)


def regex_map(line: Column, pattern: str) -> Column:
    """Named groups as fields; ``match`` when there are none; ``line`` when nothing matches."""
    from logquarry.functions.text import jvm_pattern
    from logquarry.functions.times import pattern_groups

    whole = F.create_map(F.lit("line"), line)
    jvm, groups = jvm_pattern(pattern), pattern_groups(pattern)
    if not pattern or jvm is None:
        return whole
    if groups:
        found = [x for name, i in groups.items() for x in (F.lit(name), F.regexp_extract(line, jvm, i))]
    else:
        found = [F.lit("match"), F.regexp_extract(line, jvm, 0)]
    return F.when(line.rlike(jvm), F.create_map(*found)).otherwise(whole)
