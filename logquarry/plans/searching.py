"""Queries over searches, filters and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.bridge import Bridge, with_views
from logquarry.functions import fixed
from logquarry.operators import parse, search
from logquarry.operators.running import running_rank
from logquarry.plans.base import EVENTS_NOW, at, big, plan, us
from logquarry.plans.parsing import LINE_VIEW
from logquarry.sources.tables import scan_archive_logs

B1 = with_views("b1")
B2 = with_views("b1", "b2")
EVENT_COLUMNS = ["id", "source_type", "remote_ip", "message", "log_type", "action"]
_EVENTS = "id, source_type, remote_ip, message, log_type, action, epoch_us(received_at) as received_us"


def event_rows(df):
    return df.select(*EVENT_COLUMNS, us("received_at").alias("received_us"))


def line_rows(df):
    return df.select("source", "line_index", "line")


# --- boolean, term, regex and phrase search ----------------------------------------------------------------

BOOLEAN_QUERY = '(denied OR "connection reset") user1 AND NOT (purchase or host)'


@plan(
    "text_search",
    LINE_VIEW
    + """select source, line_index, line from b3 where (contains(lower(line), 'denied') or contains(lower(line), 'connection reset'))
 and contains(lower(line), 'user1') and not (contains(lower(line), 'purchase') or contains(lower(line), 'host'))""",
)
def text_search(b: Bridge):
    return line_rows(search.text_search(b.lines, BOOLEAN_QUERY))


@plan(
    "text_search_documents",
    """select doc_id, i - 1 as line_index from (select doc_id, string_split(text, chr(10)) as parts,
 unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents) x
 where (contains(lower(parts[i]), 'the') or contains(lower(parts[i]), 'license')) and not contains(lower(parts[i]), 'and')""",
)
def text_search_documents(b: Bridge):
    """Boolean search over the lines of long texts."""
    lines = b.texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    return search.text_search(lines, '(the OR license) NOT "and"').select("doc_id", big("line_index").alias("line_index"))


@plan("term_search", B1 + f"select {_EVENTS} from b1 where lower(message) like '%log_n%' and lower(message) like '%from%' order by received_at desc, id desc limit 200")
def term_search(b: Bridge):
    return event_rows(search.term_search(b.events, "LOG_N from", limit=200))


@plan(
    "regex_search",
    B1
    + rf"select {_EVENTS} from b1 where regexp_matches(message, 'user\d+ (critical|error)', 'i') and received_at >= timestamp '2024-01-02' order by received_at desc, id desc limit 200",
)
def regex_search(b: Bridge):
    return event_rows(search.event_regex_search(b.events, r"user\d+ (critical|error)", since=at("2024-01-02"), limit=200))


@plan(
    "regex_search_named",
    B1
    + rf"""select {_EVENTS} from b1 where regexp_matches(message, 'user(\d+) (critical|error)', 'i')
 and received_at >= timestamp '2024-01-02' order by received_at desc, id desc limit 300""",
)
def regex_search_named(b: Bridge):
    """A pattern with named groups."""
    return event_rows(search.event_regex_search(b.events, r"user(?P<who>\d+) (?P<level>critical|error)", since=at("2024-01-02"), limit=300))


@plan("regex_search_lines", LINE_VIEW + r"select source, line_index, line from b3 where regexp_matches(line, 'unit[12]\[\d+5\]', 'i')")
def regex_search_lines(b: Bridge):
    return line_rows(search.regex_filter(b.lines, r"UNIT[12]\[\d+5\]", strict=True))


@plan("phrase_search", B1 + f"select {_EVENTS} from b1 where lower(message) like '%authentication failure%' order by received_at desc, id desc limit 200")
def phrase_search(b: Bridge):
    return event_rows(search.phrase_search(b.events, " Authentication failure ", limit=200))


@plan(
    "list_events",
    B1
    + f"""select {_EVENTS} from b1 where received_at >= timestamp '2024-01-03' and received_at <= timestamp '2024-01-27'
 and source_type = 'palo_alto' and log_type = 'THREAT' order by received_at desc, id desc limit 150 offset 20""",
)
def list_events(b: Bridge):
    out = search.list_events(
        b.events, since=at("2024-01-03"), until=at("2024-01-27"), source_type="palo_alto", log_type="THREAT", limit=150, offset=20
    )
    return event_rows(out)


@plan(
    "firewall_view",
    B1
    + f"""select {_EVENTS} from b1 where source_type = 'palo_alto' and log_type = 'TRAFFIC'
 and lower(action) = 'deny' order by received_at desc, id desc limit 200""",
)
def firewall_view(b: Bridge):
    return event_rows(search.firewall_view(b.events, action="DENY"))


@plan(
    "cloud_view",
    B1
    + f"""select {_EVENTS}, n as shown_of from (select *, count(*) over () as n from (select * from b1 where source_type = 'mist'
 order by received_at desc, id desc limit 500) y) x order by received_at desc, id desc limit 200""",
)
def cloud_view(b: Bridge):
    out = search.cloud_view(b.events)
    return out.select(*EVENT_COLUMNS, us("received_at").alias("received_us"), "shown_of")


# --- severity filters --------------------------------------------------------------------------------------

_WORD = r"\b(emerg(?:ency)?|alert|crit(?:ical)?|err(?:or)?|warn(?:ing)?|notice|info|debug)\b"
_PHRASE = (
    r"\b(fail(?:ed|ure)?|denied|timeout|refused|unreachable|segfault|oom|authentication failure|permission denied|"
    r"connection reset|i/o error|kernel panic)\b"
)
_JSON = r"""["'']level["'']\s*:\s*["''](\w+)["'']"""
_NAMES = "['emergency','alert','critical','error','warning','notice','info','debug']"


def severity_sql(text: str) -> str:
    """The class of a text, in SQL."""

    def alias(found: str) -> str:
        pairs = " ".join(f"when '{k}' then '{v}'" for k, v in fixed.SEVERITY_ALIASES.items())
        return f"case {found} {pairs} else {found} end"

    word = alias(rf"lower(regexp_extract({text}, '{_WORD}', 1, 'i'))")
    level = alias(rf"lower(regexp_extract({text}, '{_JSON}', 1, 'i'))")
    return rf"""case when trim({text}) = '' then 'unknown'
 when regexp_matches({text}, '^<\d{{1,3}}>') then ({_NAMES})[cast(regexp_extract({text}, '^<(\d{{1,3}})>', 1) as int) % 8 + 1]
 when regexp_matches({text}, '{_JSON}', 'i') then {level}
 when regexp_matches({text}, '{_WORD}', 'i') then {word}
 when regexp_matches({text}, '{_PHRASE}', 'i') then 'error' else 'unknown' end"""


def rank_sql(name: str) -> str:
    pairs = " ".join(f"when '{k}' then {v}" for k, v in fixed.SEVERITY_RANK.items())
    return f"case {name} {pairs} else 1 end"


def failure_sql(text: str) -> str:
    words = r"\b(err(?:or)?|crit(?:ical)?|alert|emerg(?:ency)?|fatal|panic)\b"
    return rf"""(trim({text}) <> '' and (coalesce(try_cast(regexp_extract({text}, '^<(\d{{1,3}})>', 1) as int) % 8 <= 3, false)
 or regexp_matches({text}, '{words}', 'i') or regexp_matches({text}, '{_PHRASE}', 'i')))"""


_LOW = (
    r"\[(debug|info|trace)\]|\b(debug|trace)\b|\binfo\b|\binformational\b|level=(debug|info|trace)\b|"
    r"severity=(debug|info|trace)\b|\.(debug|info|trace)\b|:\s*(debug|info|trace)\s*[-:]"
)


def low_sql(text: str) -> str:
    return rf"""(trim({text}) = '' or coalesce(try_cast(regexp_extract({text}, '^<(\d{{1,3}})>', 1) as int) % 8 >= 6, false)
 or regexp_matches({text}, '{_LOW}', 'i'))"""


@plan("classify_severity", LINE_VIEW + f"select source, line_index, {severity_sql('line')} as severity from b3")
def classify_severity(b: Bridge):
    return search.classify_lines(b.lines).select("source", "line_index", "severity")


@plan("classify_severity_raw", B2 + f"select id, {severity_sql('raw')} as severity from b2")
def classify_severity_raw(b: Bridge):
    """Framed messages: the PRI decides alone."""
    return search.classify_lines(b.raw, column="raw").select("id", "severity")


@plan("severity_floor", LINE_VIEW + f"select source, line_index, line from b3 where {rank_sql(severity_sql('line'))} >= 4")
def severity_floor(b: Bridge):
    return line_rows(search.severity_floor(b.lines, "error"))


@plan("failure_lines", LINE_VIEW + f"select source, line_index, line from b3 where {failure_sql('line')}")
def failure_lines(b: Bridge):
    return line_rows(search.failure_lines(b.lines))


@plan("failure_lines_raw", B2 + f"select id, raw from b2 where {failure_sql('raw')}")
def failure_lines_raw(b: Bridge):
    return search.failure_lines(b.raw, column="raw").select("id", "raw")


@plan("drop_low_level", LINE_VIEW + f"select source, line_index, line from b3 where not {low_sql('line')}")
def drop_low_level(b: Bridge):
    return line_rows(search.drop_low_level(b.lines))


@plan(
    "low_level_counts",
    LINE_VIEW + f"select source, count(*) filter (where not {low_sql('line')}) as kept, count(*) filter (where {low_sql('line')}) as skipped from b3 group by source",
)
def low_level_counts(b: Bridge):
    return search.low_level_counts(b.line_rows, by=["source"])


@plan(
    "event_importance",
    B1
    + """select id, case when lower(action) in ('deny', 'drop', 'block', 'reset-both', 'reset-client', 'reset-server') then 'error'
 when log_type = 'THREAT' then 'critical' when regexp_matches(lower(message), 'critical|fatal|emerg') then 'critical'
 when regexp_matches(lower(message), 'error|fail|denied|blocked') then 'error'
 when contains(lower(message), 'warn') then 'warning'
 when id % 7 in (0, 1) then 'error' when id % 7 = 2 then 'warning' else 'info' end as importance from b1""",
)
def event_importance(b: Bridge):
    verdict = F.when(F.col("id") % 7 == 0, "high").when(F.col("id") % 7 == 1, "critical").when(F.col("id") % 7 == 2, "medium")
    return search.with_importance(b.events.withColumn("llm_severity", verdict)).select("id", "importance")


# --- scope, groups, firewall traffic -----------------------------------------------------------------------


@plan(
    "path_scope",
    LINE_VIEW
    + r"""select source, line_index, line from b3 where (source like '/var/log/nginx/%' or not source like '/var/log/%/%')
 and regexp_matches(source, '/app[01]\.log$')""",
)
def path_scope(b: Bridge):
    return line_rows(search.path_scope(b.lines, root="/var/log", localhost_only=True, glob="app[01].log,none*"))


@plan(
    "group_sources",
    with_views("b10")
    + """select distinct case when not path like '/var/log/%/%' or path like '/var/log/nginx/%' then 'localhost'
 else split_part(path, '/', 4) end as label,
 case when not path like '/var/log/%/%' or path like '/var/log/nginx/%' then '/var/log#localhost'
 else concat('/var/log/', split_part(path, '/', 4)) end as path from b10""",
)
def group_sources(b: Bridge):
    return search.group_sources(b.files, "/var/log")


_TRAFFIC = "source_type = 'palo_alto' and log_type = 'TRAFFIC'"


@plan(
    "allowed_flows",
    B1
    + f"""select id, coalesce(src_ip, '198.51.100.1') as flow_src, coalesce(dst_ip, '203.0.113.9') as flow_dst from b1
 where {_TRAFFIC} and action = 'allow'""",
)
def allowed_flows(b: Bridge):
    return search.allowed_flows(b.raw, column="raw").select("id", "flow_src", "flow_dst")


@plan("already_blocked", B1 + "select id, action from b1 where source_type = 'palo_alto' and action in ('deny', 'drop', 'reset-both')")
def already_blocked(b: Bridge):
    blocked = search.already_blocked(b.raw, column="raw")
    return blocked.select("id", F.regexp_extract("raw", ",tcp,([a-z-]+),", 1).alias("action"))


# --- search over lines and over all origins ----------------------------------------------------------------

_SORT = "case when b3.id % 13 <> 0 and b3.id % 10 <> 0 then date_trunc('second', received_at) else received_at end"


@plan(
    "search_lines",
    LINE_VIEW
    + f"""select source, line_index, line, severity, epoch_us(sort_ts) as sort_us from (select *, {_SORT} as sort_ts,
 {severity_sql("line")} as severity from b3) x where (contains(lower(line), 'from') and contains(lower(line), 'error')
 or contains(lower(line), 'timeout')) and {rank_sql("severity")} >= 4
 order by sort_ts desc, source desc, line_index desc limit 5000""",
)
def search_lines(b: Bridge):
    lines = parse.parse_line_timestamps(b.lines)
    out = search.search_lines(lines, "from error OR timeout", floor="error", limit=5000)
    return out.select("source", "line_index", "line", "severity", us("sort_ts").alias("sort_us"))


_ORIGINS = (
    LINE_VIEW
    + f""", hub as (select 'hub' as origin, id, message, received_at from b1 where lower(message) like '%failure%'
  and received_at >= timestamp '2024-01-02' and source_type = 'windows' order by received_at desc, id desc limit 100),
 files as (select 'files' as origin, id, line as message, sort_ts as received_at from (select *, {_SORT} as sort_ts from b3) x
  where contains(lower(line), 'failure') order by sort_ts desc, source desc, line_index desc limit 100),
 archive as (select 'archive' as origin, -id as id, message, received_at from b1 where lower(message) like '%failure%'
  and received_at >= timestamp '2024-01-02' order by received_at desc, -id desc limit 100),
 merged as (select * from hub union all select * from files union all select * from archive)
"""
)


def _origin_inputs(b: Bridge):
    return {
        "events": b.events,
        "lines": parse.parse_line_timestamps(b.lines),
        "archive": scan_archive_logs(b.events, since_id=-1, limit=None),
        "since": at("2024-01-02"),
        "source_type": "windows",
        "limit": 300,
    }


@plan("unified_search", _ORIGINS + "select origin, id, message, epoch_us(received_at) as received_us from merged order by received_at desc, origin, id limit 300")
def unified_search(b: Bridge):
    return search.unified_search("failure", **_origin_inputs(b)).select("origin", "id", "message", us("received_at").alias("received_us"))


@plan("counts_by_origin", _ORIGINS + "select origin, count(*) as matches from merged group by origin")
def counts_by_origin(b: Bridge):
    return search.counts_by_origin("failure", **_origin_inputs(b))


@plan(
    "search_report",
    _ORIGINS
    + """select 'failure' as query, least(300, (select count(*) from merged)) as count, (select count(*) from hub) as hub,
 (select count(*) from files) as files, (select count(*) from archive) as archive, 'failure' as terms, 0 as errors""",
)
def search_report(b: Bridge):
    """What a search tells beside its matches."""
    about = search.search_report("failure", **_origin_inputs(b))[1]
    return about.select(
        "query", "count", *(F.col("counts_by_origin")[o].alias(o) for o in ("hub", "files", "archive")),
        F.array_join("highlight_terms", ",").alias("terms"), F.size("errors").alias("errors"),
    )


@plan(
    "counts_by_origin_zero",
    B1
    + """select o as origin, case o when 'hub' then least(300, (select count(*) from b1 where lower(message) like '%failure%'
 and received_at >= timestamp '2024-01-02' and source_type = 'mist')) else 0 end as matches from (values ('hub'), ('archive')) t(o)""",
)
def counts_by_origin_zero(b: Bridge):
    """An origin without any match has a row too."""
    inputs = {**_origin_inputs(b), "source_type": "mist", "limit": 600, "archive": b.events.filter(F.col("message").isNull())}
    del inputs["lines"]
    return search.counts_by_origin("failure", **inputs)


@plan(
    "live_feed",
    B1
    + """select id, left(message, 500) as message, importance from (select *, case
 when lower(action) in ('deny', 'drop', 'block', 'reset-both', 'reset-client', 'reset-server') then 'error'
 when log_type = 'THREAT' then 'critical' when regexp_matches(lower(message), 'critical|fatal|emerg') then 'critical'
 when regexp_matches(lower(message), 'error|fail|denied|blocked') then 'error'
 when contains(lower(message), 'warn') then 'warning' else 'info' end as importance
 from b1) x where importance in ('error', 'critical') order by received_at desc, id desc limit 500""",
)
def live_feed(b: Bridge):
    from logquarry.operators.ranking import live_feed as feed

    return feed(b.events, floor="error").select("id", "message", "importance")


@plan("live_failure_lines", LINE_VIEW + f"""select source, line_index, line from (select *, {_SORT} as sort_ts from b3) x where {failure_sql("line")}
 order by sort_ts desc, source desc, line_index desc limit 2000""")
def live_failure_lines(b: Bridge):
    """The newest 2 000 failure lines of all files."""
    lines = parse.parse_line_timestamps(search.failure_lines(b.lines))
    return line_rows(lines.orderBy(F.desc("sort_ts"), F.desc("source"), F.desc("line_index")).limit(2000))


@plan("scan_journal_export", B1 + f"""select id, message as line, epoch_us(received_at) as ts_us from b1 where id % 5 = 2 and id % 8 <= 4
 and regexp_matches(message, 'login|timeout', 'i') and received_at >= timestamp '2024-01-03' and received_at <= timestamp '{EVENTS_NOW}'
 order by received_at desc, id desc limit 400""")
def scan_journal_export(b: Bridge):
    from logquarry.sources.tables import scan_journal_export as scan

    out = scan(journal(b), "journal://unit/unit2", priority=4, patterns=["login|timeout"], since=at("2024-01-03"), until=at(EVENTS_NOW), limit=400)
    return out.select("id", "line", us("ts").alias("ts_us"))


def journal(b: Bridge):
    """Journal entries derived from the events."""
    return b.events.select(
        "id",
        F.col("received_at").alias("ts"),
        F.concat(F.lit("unit"), (F.col("id") % 5).cast("string")).alias("unit"),
        F.concat(F.lit("boot"), (F.col("id") % 3).cast("string")).alias("boot_id"),
        (F.col("id") % 8).cast("int").alias("priority"),
        F.col("message").alias("line"),
    )


@plan("scan_archive_logs", B1 + "select -id as id, remote_ip, transport, message, 'imported' as source_type from b1 where b1.id > 100 order by b1.id limit 2000")
def scan_archive_logs_plan(b: Bridge):
    out = scan_archive_logs(b.events, since_id=100, limit=2000)
    return out.select("id", "remote_ip", "transport", "message", "source_type")


@plan(
    "scan_cloud_events",
    with_views("b8") + "select seq, body from b8",
)
def scan_cloud_events(b: Bridge):
    """Landed API pages: single events, lists and wrapped lists of up to five events, unwrapped again."""
    from logquarry.sources.tables import scan_cloud_events as scan

    ranked = running_rank(b.cloud, [], "seq", out="n").withColumn("page_no", F.expr("(n - 1) div 5"))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda r: r["body"])
    listed = F.concat(F.lit("["), F.array_join(bodies, ","), F.lit("]"))
    keys = F.array(*[F.lit(k) for k in fixed.CLOUD_PAGE_KEYS])
    key = F.element_at(keys, (F.col("page_no") % len(fixed.CLOUD_PAGE_KEYS) + 1).cast("int"))
    wrapped = F.concat(F.lit('{"total":5,"'), key, F.lit('":'), F.col("listed"), F.lit("}"))
    many = ranked.filter("page_no % 3 <> 0").groupBy("page_no").agg(listed.alias("listed"))
    many = many.select(F.when(F.col("page_no") % 3 == 1, F.col("listed")).otherwise(wrapped).alias("page"))
    single = ranked.filter("page_no % 3 = 0").select(F.col("body").alias("page"))
    found = scan(single.unionByName(many))
    stamp = F.get_json_object("body", "$.timestamp").cast("long")
    seq = F.when(stamp > 10**12, F.expr("cast(get_json_object(body, '$.timestamp') as long) div 1000")).otherwise(stamp) - 1700000000
    return found.select(seq.alias("seq"), "body")
