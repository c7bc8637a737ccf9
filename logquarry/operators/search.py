"""Filters, searches and line labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions import fixed, severity, syslog
from logquarry.functions.text import (
    all_terms,
    any_of,
    basename,
    boolean_search,
    glob_matches,
    highlight_terms,
    regex_search,
    valid_regex,
)
from logquarry.operators.parse import normalize_origins
from logquarry.operators.running import computed_once


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """As many rows as the caller asks for; all of them unless a limit is named."""
    return df if limit is None else df.limit(limit)


def newest(df: DataFrame, by: str, limit: int | None, *, tie: str | None = "id", ascending: bool = False) -> DataFrame:
    """Rows by time, newest first; ties are broken so that results repeat. With a limit it plans as a per-partition top-k."""
    order = F.asc if ascending else F.desc
    keys = [order(by)] + ([order(tie)] if tie and tie in df.columns else [])
    return first_rows(df.orderBy(*keys), limit)


def between(df: DataFrame, column: str, since: Column | None, until: Column | None = None) -> DataFrame:
    if since is not None:
        df = df.filter(F.col(column) >= since)
    if until is not None:
        df = df.filter(F.col(column) <= until)
    return df


def text_search(df: DataFrame, query: str, *, column: str = "line", case_sensitive: bool = False) -> DataFrame:
    """Rows that satisfy a boolean search text."""
    return df.filter(boolean_search(column, query, case_sensitive=case_sensitive))


def regex_filter(df: DataFrame, pattern: str, *, column: str = "line", strict: bool = False) -> DataFrame:
    """Rows matching a case-insensitive pattern. ``strict`` raises on a malformed one instead of matching nothing."""
    if strict and not valid_regex(pattern):
        raise ValueError(f"invalid pattern: {pattern}")
    return df.filter(regex_search(F.col(column), pattern))


def term_search(
    events: DataFrame, query: str, *, since: Column | None = None, source_type: str | None = None, limit: int | None = None
) -> DataFrame:
    """Newest events whose message has every term."""
    df = between(events, "received_at", since)
    if source_type:
        df = df.filter(F.col("source_type") == source_type)
    return newest(df.filter(all_terms(F.col("message"), query)), "received_at", limit)


def event_regex_search(
    events: DataFrame, pattern: str, *, since: Column | None = None, source_type: str | None = None, limit: int | None = None
) -> DataFrame:
    df = between(events, "received_at", since)
    if source_type:
        df = df.filter(F.col("source_type") == source_type)
    return newest(regex_filter(df, pattern, column="message"), "received_at", limit)


def phrase_search(archive: DataFrame, phrase: str, *, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Newest archive rows that contain the whole phrase (case-insensitive, wildcards active)."""
    text = phrase.strip().lower()
    if not text:
        return archive.limit(0)
    hits = between(archive, "received_at", since).filter(F.lower("message").like(f"%{text}%"))
    return newest(hits, "received_at", limit)


def list_events(
    events: DataFrame,
    *,
    since: Column | None = None,
    until: Column | None = None,
    source_type: str | None = None,
    log_type: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    ascending: bool = False,
) -> DataFrame:
    df = between(events, "received_at", since, until)
    if source_type:
        df = df.filter(F.col("source_type") == source_type)
    if log_type:
        df = df.filter(F.col("log_type") == log_type)
    order = F.asc if ascending else F.desc
    ordered = df.orderBy(order("received_at"), order("id"))
    return first_rows(ordered.offset(offset) if offset else ordered, limit)


def firewall_view(
    events: DataFrame, *, since: Column | None = None, log_type: str = "TRAFFIC", action: str | None = None
) -> DataFrame:
    """The newest 200 firewall events of a type and, if asked for, of one action."""
    if action:
        events = events.filter(F.lower("action") == action.lower())
    return list_events(events, since=since, source_type="palo_alto", log_type=log_type, limit=200)


def cloud_view(events: DataFrame, *, since: Column | None = None) -> DataFrame:
    """The newest 200 of the newest 500 cloud events, each with the size of the 500."""
    top = list_events(events, since=since, source_type="mist", limit=500)
    counted = top.withColumn("shown_of", F.count(F.lit(1)).over(Window.partitionBy()))  # at most 500 rows
    return newest(counted, "received_at", 200)


def severity_floor(df: DataFrame, floor: str, *, column: str = "line") -> DataFrame:
    return df.filter(severity.at_least(F.col(column), floor))


def failure_lines(df: DataFrame, *, column: str = "line") -> DataFrame:
    return df.filter(severity.is_failure(F.col(column)))


def drop_low_level(df: DataFrame, *, column: str = "line") -> DataFrame:
    return df.filter(~severity.is_low_level(F.col(column)))


def low_level_counts(df: DataFrame, *, column: str = "line", by: list[str] | None = None) -> DataFrame:
    """Kept and skipped rows."""
    low = severity.is_low_level(F.col(column))
    return df.groupBy(*(by or [])).agg(F.count_if(~low).alias("kept"), F.count_if(low).alias("skipped"))


# --- path scope --------------------------------------------------------------------------------------------


def under_root(source: Column, root: str) -> Column:
    return source.startswith(root.rstrip("/") + "/")


def relative_parts(source: Column, root: str) -> Column:
    return F.split(F.substr(source, F.lit(len(root.rstrip("/")) + 2)), "/")


def is_local(source: Column, root: str) -> Column:
    """A file at the root or below a well-known facility folder."""
    parts = relative_parts(source, root)
    facility = F.lower(F.get(parts, F.lit(0))).isin(fixed.LOCAL_FACILITY_DIRS)
    return under_root(source, root) & ((F.size(parts) < 2) | facility)


def path_scope(
    df: DataFrame,
    *,
    source: str | None = None,
    root: str | None = None,
    localhost_only: bool = False,
    glob: str | None = None,
) -> DataFrame:
    """Restrict lines to one source, a root, the local group of a root, or a file glob."""
    col = F.col("source")
    if source:
        df = df.filter(col == source)
    if root:
        df = df.filter(is_local(col, root) if localhost_only else under_root(col, root))
    if glob:
        df = df.filter(glob_matches(basename(col), glob))
    return df


def source_group(source: Column, root: str) -> Column:
    """``localhost`` or the first folder below the root; null outside it."""
    first = F.get(relative_parts(source, root), F.lit(0))
    return F.when(~under_root(source, root), None).when(is_local(source, root), fixed.LOCALHOST_GROUP).otherwise(first)


def group_sources(files: DataFrame, root: str, *, column: str = "path") -> DataFrame:
    """Distinct groups of a file list with the path that scopes each."""
    label = source_group(F.col(column), root)
    base = root.rstrip("/")
    path = F.when(F.col("label") == fixed.LOCALHOST_GROUP, F.lit(f"{base}#{fixed.LOCALHOST_GROUP}"))
    return (
        files.select(label.alias("label"))
        .filter(F.col("label").isNotNull())
        .distinct()
        .withColumn("path", path.otherwise(F.concat(F.lit(base + "/"), "label")))
        .orderBy(F.lower("label"))
    )


# --- firewall traffic --------------------------------------------------------------------------------------


def with_blocked(df: DataFrame, *, column: str = "message", out: str = "blocked") -> DataFrame:
    """Add whether the firewall denied the session itself."""
    message = F.col(column)
    fields = F.col("_fields")
    kind, action = syslog.payload_type(fields), syslog.action_after_protocol(fields)
    threat = F.coalesce(action.isin(fixed.THREAT_BLOCKED), F.lit(False)) | message.rlike(fixed.BLOCKED_KEY_VALUE)
    verdict = F.when(kind == "TRAFFIC", action.isin(fixed.TRAFFIC_BLOCKED)).when(kind == "THREAT", threat)
    marked = computed_once(df, "_fields", _payload_fields(message)).withColumn(out, F.coalesce(verdict, F.lit(False)))
    return marked.drop("_fields")


def _payload_fields(message: Column) -> Column:
    """Payload fields of messages that can be traffic or threat logs; others are not split."""
    likely = F.upper(message).contains("TRAFFIC") | F.upper(message).contains("THREAT")
    return F.when(likely, syslog.firewall_payload_fields(message))


def already_blocked(df: DataFrame, *, column: str = "message") -> DataFrame:
    return with_blocked(df, column=column, out="_blocked").filter("_blocked").drop("_blocked")


def allowed_flows(df: DataFrame, *, column: str = "message") -> DataFrame:
    """Allowed firewall traffic with its first two addresses as flow_src and flow_dst."""
    fields = F.col("_fields")
    return (
        computed_once(df, "_fields", _payload_fields(F.col(column)))
        .filter((syslog.payload_type(fields) == "TRAFFIC") & (syslog.action_after_protocol(fields) == "allow"))
        .withColumn("_ips", syslog.address_fields(fields))
        .filter(F.size("_ips") >= 2)
        .withColumn("flow_src", F.get("_ips", F.lit(0)))
        .withColumn("flow_dst", F.get("_ips", F.lit(1)))
        .drop("_fields", "_ips")
    )


# --- labelling ---------------------------------------------------------------------------------------------


def classify_lines(df: DataFrame, *, column: str = "line") -> DataFrame:
    return df.withColumn("severity", severity.classify_severity(F.col(column)))


def with_importance(events: DataFrame) -> DataFrame:
    verdict = F.col("llm_severity") if "llm_severity" in events.columns else F.lit(None).cast("string")
    label = severity.event_importance(F.col("action"), F.col("log_type"), F.col("message"), verdict)
    return events.withColumn("importance", label)


def feed_rows(events: DataFrame) -> DataFrame:
    """The live-feed projection."""
    return with_importance(events).select(
        "id",
        "received_at",
        "source_type",
        F.substring("message", 1, 500).alias("message"),
        "remote_ip",
        "log_type",
        "action",
        "importance",
    )


def important_enough(df: DataFrame, floor: str) -> DataFrame:
    label = F.coalesce("importance", F.lit("error"))
    return df.filter(severity.importance_rank(label) >= fixed.IMPORTANCE_RANK.get(floor, 0))


# --- cross-source search -----------------------------------------------------------------------------------


def search_lines(
    lines: DataFrame,
    query: str,
    *,
    mode: str = "text",
    floor: str | None = None,
    limit: int | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Matching lines at or above a severity, newest first (``sort_ts`` must be present)."""
    if mode == "regex":
        hits = regex_filter(lines, query, strict=True)
    else:
        hits = text_search(lines, query)
    hits = severity_floor(hits.filter(F.length("line") > 0), floor) if floor else hits.filter(F.length("line") > 0)
    order = F.asc if ascending else F.desc
    top = hits.orderBy(order("sort_ts"), order("source"), order("line_index"))
    return classify_lines(first_rows(top, limit))


def origin_matches(
    query: str,
    *,
    mode: str = "text",
    events: DataFrame | None = None,
    lines: DataFrame | None = None,
    archive: DataFrame | None = None,
    since: Column | None = None,
    source_type: str | None = None,
    floor: str | None = None,
    limit: int | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Each origin's matches, newest first and, if a limit is named, cut to an equal share of it, in one schema."""
    origins = sum(part is not None for part in (events, lines, archive)) or 1
    quota = None if limit is None else max(limit // origins, 1)
    found_events = found_lines = found_archive = None
    if events is not None:
        search = event_regex_search if mode == "regex" else term_search
        found_events = search(events, query, since=since, source_type=source_type, limit=quota)
    if lines is not None:
        top = search_lines(lines, query, mode=mode, floor=floor, limit=quota, ascending=ascending)
        found_lines = top.withColumn("received_at", F.col("sort_ts"))
    if archive is not None:
        found_archive = phrase_search(archive, query, since=since, limit=quota)
    return normalize_origins(found_events, found_lines, found_archive)


def unified_search(query: str, *, limit: int | None = None, ascending: bool = False, **options) -> DataFrame:
    """All origins' matches merged by time and, if a limit is named, cut to it."""
    merged = origin_matches(query, limit=limit, ascending=ascending, **options)
    order = F.asc if ascending else F.desc
    return first_rows(merged.orderBy(order("received_at"), "origin", "id"), limit)


def search_report(query: str, *, mode: str = "text", limit: int | None = None, ascending: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """A search's matches (``unified_search``) and one row about them: query, mode, count, counts_by_origin (0 for an asked
    origin without any), highlight_terms (of a text search) and errors by origin.

    A malformed pattern is an error of the files, where patterns are checked; other origins are searched all the same.
    """
    errors = {}
    others = any(options.get(part) is not None for part in ("events", "archive"))
    if mode == "regex" and others and options.get("lines") is not None and not valid_regex(query):
        errors["files"] = f"invalid pattern: {query}"
        options = options | {"lines": None}
    try:
        terms = highlight_terms(query) if mode == "text" else []
    except ValueError:  # nothing to mark in a text that is no search
        terms = []
    results = unified_search(query, mode=mode, limit=limit, ascending=ascending, **options)
    counts = counts_by_origin(query, mode=mode, limit=limit, **options)  # a row for each origin
    total = F.sum("matches")
    count = total if limit is None else F.least(total, F.lit(limit))
    about = counts.agg(count.cast("long").alias("count"), F.map_from_entries(F.collect_list(F.struct("origin", "matches"))).alias("counts_by_origin"))
    literal = F.array(*(F.lit(t) for t in terms)).cast("array<string>")
    told = F.create_map(*(F.lit(x) for pair in errors.items() for x in pair)).cast("map<string,string>")
    return results, about.select(F.lit(query).alias("query"), F.lit(mode).alias("mode"), "count", "counts_by_origin", literal.alias("highlight_terms"), told.alias("errors"))


def counts_by_origin(query: str, **options) -> DataFrame:
    """Matches per origin before the final cut; 0 for an asked origin without any."""
    names = [name for name, part in (("hub", "events"), ("files", "lines"), ("archive", "archive")) if options.get(part) is not None]
    found = origin_matches(query, **options).groupBy("origin").count()
    asked = found.sparkSession.createDataFrame([(n,) for n in names], "origin string")
    return asked.join(found, "origin", "left").select("origin", F.coalesce("count", F.lit(0)).cast("long").alias("matches"))


def filter_sort_columns(
    df: DataFrame, contains: dict[str, str], sort_key: str | None = None, *, descending: bool = False
) -> DataFrame:
    """Contains-filters on columnized fields, then a case-insensitive sort by one of them."""

    def value(key: str) -> Column:
        return F.lower(F.coalesce(F.try_element_at("columns", F.lit(key)), F.lit("")))

    needles = {k: v.strip().lower() for k, v in contains.items() if v.strip()}
    out = df.filter(~any_of([~value(k).contains(v) for k, v in needles.items()]) | F.col("columns").isNull())
    if sort_key:
        key = value(sort_key)
        out = out.orderBy(key.desc() if descending else key.asc())
    return out
