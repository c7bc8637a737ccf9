"""Parse and project jobs: raw messages and lines to typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import fixed, syslog
from logquarry.functions.syslog import FirewallMap
from logquarry.functions.text import any_of, basename, blank_to_null, cut, is_blank, strip
from logquarry.functions.times import line_timestamp
from logquarry.operators.running import computed_once


@dataclass(frozen=True)
class SourceRule:
    """One entry of the source registry; order in the registry matters."""

    id: str
    source_type: str
    contains: tuple[str, ...] = ()
    ingest: str = "syslog"
    enabled: bool = True
    default: bool = False
    extra: dict = field(default_factory=dict)


DEFAULT_REGISTRY = (
    SourceRule("palo_alto", "palo_alto", (",TRAFFIC,", ",THREAT,")),
    SourceRule("windows", "windows"),
    SourceRule("generic", "generic", default=True),
)


def parse_syslog_header(df: DataFrame, *, raw_limit: int = fixed.RAW_LIMIT, message: Column | None = None) -> DataFrame:
    """Add pri, facility, severity, message and the truncated raw text."""
    pri = syslog.header_pri(F.col("raw"))
    message = syslog.structured_message(F.col("raw")) if message is None else message
    return (
        df.withColumn("pri", pri)
        .withColumn("facility", syslog.facility(F.col("pri")))
        .withColumn("severity", (F.col("pri") % 8).cast("int"))
        .withColumn("message", message)
        .withColumn("raw", cut(F.col("raw"), raw_limit))
    )


def _firewall_columns(df: DataFrame, columns: FirewallMap) -> DataFrame:
    """Firewall columns (prefixed ``fw_``) of ``message``; ``fw_type`` is null when the body is not usable."""
    fields = F.col("_fields")
    body = F.when(syslog.looks_like_firewall(F.col("message")), syslog.csv_fields(F.col("message")))
    df = computed_once(df, "_fields", body)
    usable = F.size(fields) >= columns.needed
    src, dst = syslog.field_at(fields, columns.src), syslog.field_at(fields, columns.dst)
    mapped = src.isNotNull() & dst.isNotNull() & src.rlike(fixed.IPV4_SHAPE)
    addresses = syslog.address_fields(fields)
    after = F.nullif(syslog.action_after_protocol(fields), F.lit(""))
    return (
        df.withColumn("fw_type", F.when(usable, F.upper(syslog.field_at(fields, columns.log_type))))
        .withColumn("fw_src", F.when(mapped, src).otherwise(F.try_element_at(addresses, F.lit(1))))
        .withColumn("fw_dst", F.when(mapped, dst).otherwise(F.try_element_at(addresses, F.lit(2))))
        .withColumn("fw_sport", syslog.field_at(fields, columns.sport).try_cast("int"))
        .withColumn("fw_dport", syslog.field_at(fields, columns.dport).try_cast("int"))
        .withColumn("fw_proto", syslog.field_at(fields, columns.proto))
        .withColumn("fw_action", F.coalesce(after, F.lower(syslog.field_at(fields, columns.action))))
        .withColumn("fw_ts", syslog.firewall_time(F.try_element_at(fields, F.lit(columns.time + 1))))
        .drop("_fields")
    )


def parse_firewall_csv(df: DataFrame, columns: FirewallMap | None = None) -> DataFrame:
    """Firewall messages only, as event rows. A time that is no date falls back to the arrival time."""
    # a cheap test on the raw text first: most messages are not firewall logs and need no parsing at all
    likely = df.filter(any_of([F.col("raw").contains(w) for w in fixed.FIREWALL_WORDS]))
    header = parse_syslog_header(computed_once(likely, "_message", syslog.structured_message(F.col("raw"))), message=F.col("_message"))
    parsed = _firewall_columns(header, columns or FirewallMap()).filter(F.col("fw_type").isNotNull())
    return parsed.select(
        "id",
        "received_at",
        F.lit("palo_alto").alias("source_type"),
        "remote_ip",
        "transport",
        F.col("remote_ip").alias("syslog_host"),
        "facility",
        "severity",
        "raw",
        "message",
        F.lit("palo_alto").alias("parser"),
        F.col("fw_type").alias("log_type"),
        F.col("fw_src").alias("src_ip"),
        F.col("fw_dst").alias("dst_ip"),
        F.col("fw_sport").alias("src_port"),
        F.col("fw_dport").alias("dst_port"),
        F.col("fw_proto").alias("proto"),
        F.col("fw_action").alias("action"),
        F.coalesce("fw_ts", "received_at").alias("event_ts"),
    )


def address_tokens(message: Column) -> Column:
    """IPv4 tokens, then IPv6 tokens, without repeats."""
    v4 = F.regexp_extract_all(message, F.lit(fixed.IPV4_TOKEN), F.lit(0))
    v6 = F.regexp_extract_all(message, F.lit(fixed.IPV6_TOKEN), F.lit(0))
    return F.array_distinct(F.concat(v4, v6))


def generic_message(raw: Column) -> Column:
    return F.when(syslog.is_versioned(raw), syslog.structured_message(raw)).otherwise(syslog.bsd_message(raw))


def parse_generic_syslog(df: DataFrame, *, hint: Column | None = None) -> DataFrame:
    """Any message as an event row: addresses from the text, windows or generic by its framing."""
    versioned = syslog.is_versioned(F.col("raw"))
    windows = versioned if hint is None else versioned | F.coalesce(hint == "windows", F.lit(False))
    parsed = (
        computed_once(computed_once(df, "message", generic_message(F.col("raw"))), "_ips", address_tokens(F.col("message")))
        .withColumn("_pri", syslog.header_pri(F.col("raw")))
    )
    return parsed.select(
        "id",
        "received_at",
        F.when(windows, "windows").otherwise("generic").alias("source_type"),
        "remote_ip",
        "transport",
        F.col("remote_ip").alias("syslog_host"),
        syslog.facility(F.col("_pri")).alias("facility"),
        (F.col("_pri") % 8).cast("int").alias("severity"),
        cut(F.col("raw"), fixed.RAW_LIMIT).alias("raw"),
        "message",
        F.lit("generic").alias("parser"),
        F.try_element_at("_ips", F.lit(1)).alias("src_ip"),
        F.try_element_at("_ips", F.lit(2)).alias("dst_ip"),
        F.col("received_at").alias("event_ts"),
    )


def registry_type(raw: Column, registry: tuple[SourceRule, ...] = DEFAULT_REGISTRY) -> Column:
    """Source type of the first matching registry entry, null when none matches."""
    body = F.coalesce(syslog.after_marker(raw), raw)
    haystack = F.lower(F.concat(raw, F.lit("\n"), body))
    firewall = syslog.looks_like_firewall(body) | syslog.looks_like_firewall(raw)
    result = None
    for rule in registry:
        if not rule.enabled or rule.ingest != "syslog" or rule.default:
            continue
        hits = [haystack.contains(text.lower()) for text in rule.contains]
        if rule.source_type == "palo_alto":
            hits.append(firewall)
        if rule.source_type == "windows":
            hits.append(syslog.is_versioned(raw))
        if hits:
            result = F.when(any_of(hits), rule.source_type) if result is None else result.when(any_of(hits), rule.source_type)
    return F.lit(None).cast("string") if result is None else result


def classify_by_registry(df: DataFrame, registry: tuple[SourceRule, ...] = DEFAULT_REGISTRY) -> DataFrame:
    return df.withColumn("registry_type", registry_type(F.col("raw"), registry))


def classify_events(
    df: DataFrame, columns: FirewallMap | None = None, registry: tuple[SourceRule, ...] = DEFAULT_REGISTRY
) -> DataFrame:
    """Route every raw message to the firewall or the generic parser, in one pass over the input."""
    raw = F.col("raw")
    bodied = computed_once(df, "message", syslog.structured_message(raw))
    parsed = _firewall_columns(bodied, columns or FirewallMap())
    firewall = F.col("fw_type").isNotNull()
    plain = ~firewall & ~syslog.is_versioned(raw)  # only these frame their text differently
    parsed = computed_once(parsed, "_text", F.when(plain, syslog.bsd_message(raw)).otherwise(F.col("message")))
    parsed = computed_once(parsed, "_ips", F.when(~firewall, address_tokens(F.col("_text"))))
    parsed = (
        parsed.withColumn("_pri", syslog.header_pri(raw))
        .withColumn("message", F.col("_text"))
        .withColumn("_windows", syslog.is_versioned(raw) | F.coalesce(registry_type(raw, registry) == "windows", F.lit(False)))
    )
    source_type = F.when(firewall, "palo_alto").when(F.col("_windows"), "windows").otherwise("generic")
    return parsed.select(
        "id",
        "received_at",
        source_type.alias("source_type"),
        "remote_ip",
        "transport",
        F.col("remote_ip").alias("syslog_host"),
        syslog.facility(F.col("_pri")).alias("facility"),
        (F.col("_pri") % 8).cast("int").alias("severity"),
        cut(raw, fixed.RAW_LIMIT).alias("raw"),
        "message",
        F.when(firewall, "palo_alto").otherwise("generic").alias("parser"),
        F.col("fw_type").alias("log_type"),
        F.when(firewall, F.col("fw_src")).otherwise(F.try_element_at("_ips", F.lit(1))).alias("src_ip"),
        F.when(firewall, F.col("fw_dst")).otherwise(F.try_element_at("_ips", F.lit(2))).alias("dst_ip"),
        F.when(firewall, F.col("fw_sport")).alias("src_port"),
        F.when(firewall, F.col("fw_dport")).alias("dst_port"),
        F.when(firewall, F.col("fw_proto")).alias("proto"),
        F.when(firewall, F.col("fw_action")).alias("action"),
        F.when(firewall, F.coalesce("fw_ts", "received_at")).otherwise(F.col("received_at")).alias("event_ts"),
    )


# --- cloud events ------------------------------------------------------------------------------------------


def json_values(body: Column) -> Column:
    """Top-level values of a JSON object as texts: parsed once, however many keys are probed."""
    return F.from_json(body, "map<string,string>")


def first_text(values: Column, keys: list[str]) -> Column:
    """The first non-blank value of a key list, trimmed."""
    return F.coalesce(*[blank_to_null(F.try_element_at(values, F.lit(key))) for key in keys])


_SEPARATORS = r'((?:[^":,]++|"(?:[^"\\]++|\\.)*+")*+[:,])'  # up to a colon or comma outside strings


def cloud_key(body: Column, values: Column | None = None) -> Column:
    """Stable key: the first id-like value, else a hash of the event written with sorted keys.

    The id value stays as it is. The hashed text is ``{"a": 1, "b": {"c": "x"}}``: sorted keys, a blank after every
    colon and comma outside strings, nested objects and lists included.
    """
    values = json_values(body) if values is None else values
    ids = [F.try_element_at(values, F.lit(key)) for key in fixed.CLOUD_ID_KEYS]
    by_id = F.concat(F.lit("mist:"), F.coalesce(*[F.when(~is_blank(v), v) for v in ids]))
    typed = F.from_json(body, "map<string,variant>")
    pairs = F.transform(
        F.array_sort(F.map_keys(typed)), lambda k: F.concat(F.lit('"'), k, F.lit('": '), F.regexp_replace(F.to_json(F.element_at(typed, k)), F.lit(_SEPARATORS), F.lit("$1 ")))
    )
    text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return F.coalesce(by_id, F.concat(F.lit("mist:hash:"), F.left(F.sha2(text, 256), F.lit(32))))


def cloud_time(values: Column) -> Column:
    """Event time; values above 1e12 are milliseconds."""
    value = F.coalesce(*[F.try_element_at(values, F.lit(key)).try_cast("double") for key in fixed.CLOUD_TIME_KEYS])
    seconds = F.when(value > 1e12, value / 1000).otherwise(value)
    return F.timestamp_micros(F.round(seconds * 1000000).cast("long"))


def normalize_cloud_events(df: DataFrame, *, raw_limit: int = fixed.RAW_LIMIT) -> DataFrame:
    """JSON bodies as event rows (input columns other than ``body`` are kept)."""
    body, values, blank = F.col("body"), F.col("_values"), F.lit("")
    kept = [c for c in df.columns if c != "body"]
    parsed = (
        computed_once(df, "_values", json_values(body))
        .withColumn("_title", first_text(values, fixed.CLOUD_TITLE_KEYS))
        .withColumn("_text", first_text(values, fixed.CLOUD_BODY_KEYS))
    )
    return parsed.select(
        *kept,
        F.lit("mist").alias("source_type"),
        F.lit("mist").alias("source_id"),
        F.lit("mist.cloud").alias("remote_ip"),
        F.lit("mist_api").alias("transport"),
        F.coalesce(first_text(values, fixed.CLOUD_HOST_KEYS), blank).alias("syslog_host"),
        cut(body, raw_limit).alias("raw"),
        F.coalesce(F.concat("_title", F.lit(": "), "_text"), "_title", "_text", cut(body, 500)).alias("message"),
        cloud_key(body, values).alias("parser"),
        F.coalesce("_title", blank).alias("log_type"),
        F.coalesce(first_text(values, fixed.CLOUD_ACTION_KEYS), blank).alias("action"),
        cloud_time(values).alias("event_ts"),
    )


# --- lines -------------------------------------------------------------------------------------------------


def parse_line_timestamps(lines: DataFrame, *, year: int | None = None) -> DataFrame:
    """Add ``ts`` (leading timestamp) and ``sort_ts`` (ts, else the arrival time)."""
    with_ts = lines.withColumn("ts", line_timestamp(F.col("line"), year))
    return with_ts.withColumn("sort_ts", F.coalesce("ts", "received_at"))


def normalize_origins(
    events: DataFrame | None = None, lines: DataFrame | None = None, archive: DataFrame | None = None
) -> DataFrame:
    """Events, lines and archive rows in one search schema with their origin."""
    parts = []
    if events is not None:
        parts.append(events.withColumn("origin", F.lit("hub")))
    if lines is not None:
        shaped = lines.withColumn("message", F.col("line")).withColumn("origin", F.lit("files"))
        parts.append(shaped.withColumn("journal", F.col("source").startswith("journal://")).drop("line"))
    if archive is not None:
        parts.append(archive.withColumn("origin", F.lit("archive")))
    if not parts:
        raise ValueError("at least one origin is needed")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def windows_event_rows(
    records: DataFrame,
    *,
    providers: list[str] | None = None,
    event_ids: list[int] | None = None,
    levels: list[int] | None = None,
    started_at: Column | None = None,
    grace_minutes: int = 0,
) -> DataFrame:
    """Exported Windows records that pass the selection, with syslog severity and message text."""
    keep = F.lit(True)
    if providers:
        keep = keep & F.lower(F.coalesce("provider", F.lit(""))).isin([p.lower() for p in providers])
    if event_ids:
        keep = keep & F.col("event_id").isin(event_ids)
    if levels:
        keep = keep & F.coalesce(F.col("level"), F.lit(4)).isin(levels)
    if started_at is not None:
        keep = keep & (F.col("created_at") >= started_at - F.make_interval(mins=F.lit(max(0, grace_minutes))))
    from logquarry.functions.severity import literal_map

    fallback = F.concat(
        F.lit("EventId="), F.col("event_id").cast("string"), F.lit(" Provider="), F.coalesce("provider", F.lit(""))
    )
    severity = F.coalesce(F.try_element_at(literal_map(fixed.WINDOWS_LEVEL_TO_SEVERITY), F.col("level").cast("int")), F.lit(6))
    text = F.concat(F.lit("["), "log_name", F.lit("] "), F.coalesce("description", fallback))
    return (
        records.filter(keep)
        .withColumn("severity", severity)
        .withColumn("app_name", F.lit("WindowsEvents"))
        .withColumn("message", text)
    )


def app_name_of(path: Column) -> Column:
    """File name without a closing .log or .txt."""
    return F.regexp_replace(basename(path), r"(?i)\.(log|txt)$", "")


def encode_rfc5424(
    df: DataFrame,
    *,
    facility: Column,
    severity: Column,
    ts: Column,
    host: Column,
    app: Column,
    message: Column,
    zone: str = "+00:00",
) -> DataFrame:
    """Add ``encoded``: one framed message per row. Control characters become blanks, nothing becomes ``-``."""
    clean = F.regexp_replace(message, r"[\x00-\x1f]", " ")
    body = F.when(F.coalesce(F.length(message), F.lit(0)) == 0, "-").otherwise(clean)
    stamp = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(zone))
    pri = (facility * 8 + severity).cast("string")
    head = F.concat(F.lit("<"), pri, F.lit(">1 "), stamp, F.lit(" "), host, F.lit(" "), app, F.lit(" - - - "))
    return df.withColumn("encoded", F.concat(head, body))


def decode_payload(payload: Column) -> Column:
    """Received bytes as text without the closing carriage return."""
    return F.rtrim(payload.cast("string"), F.lit("\r\n"))


def strip_lines(text: Column) -> Column:
    """The non-empty lines of a received text."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.rtrim(s, F.lit("\r"))), lambda s: F.length(strip(s)) > 0)
