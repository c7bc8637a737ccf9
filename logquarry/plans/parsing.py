"""Queries over the parse and project jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.bridge import Bridge, with_views
from logquarry.functions.syslog import FirewallMap, csv_map, regex_map, syslog_columns, syslog_map
from logquarry.operators import parse, rules, search
from logquarry.plans.base import big, plan, us

RAW_MAP = FirewallMap(sport=24, dport=25, proto=26, action=27)

# what each raw message must parse to, written from the values it was built of
_EXPECTED = (
    with_views("b1", "b2")
    + """, e as (
 select b1.*, b2.raw,
  case when source_type in ('palo_alto', 'windows') then 8 + b1.id % 8 else 128 + b1.id % 8 end as pri,
  case source_type when 'palo_alto' then substr(b2.raw, strpos(b2.raw, ' - - - - ') + 9)
   when 'windows' then concat('host', cast(b1.id % 5 as string), ' WindowsEvents - - - ', message)
   else concat('00:00:00 host', cast(b1.id % 5 as string), ' app[', cast(b1.id % 99 as string), ']: ', message) end as msg,
  substr(message, strpos(message, '198.51.'), strpos(message, ' client') - strpos(message, '198.51.')) as text_ip,
  substr(message, strpos(message, 'aa:bb:')) as mac,
  coalesce(src_ip, '198.51.100.1') as fw_src, coalesce(dst_ip, '203.0.113.9') as fw_dst
 from b1 join b2 on b1.id = b2.id)
"""
)


@plan("parse_syslog_header", _EXPECTED + "select id, pri, pri // 8 as facility, pri % 8 as severity, msg as message from e")
def parse_syslog_header(b: Bridge):
    out = parse.parse_syslog_header(b.raw)
    return out.select("id", big("pri").alias("pri"), big("facility").alias("facility"), big("severity").alias("severity"), "message")


@plan(
    "parse_firewall_csv",
    _EXPECTED
    + """select id, log_type, fw_src as src_ip, fw_dst as dst_ip, 1024 + id % 5000 as src_port, id % 1000 as dst_port,
 'tcp' as proto, action, epoch_us(timestamp '2024-01-02 03:04:00') + (id % 10) * 1000000 as event_us
 from e where source_type = 'palo_alto'""",
)
def parse_firewall_csv(b: Bridge):
    out = parse.parse_firewall_csv(b.raw, RAW_MAP)
    ports = [big(c).alias(c) for c in ("src_port", "dst_port")]
    return out.select("id", "log_type", "src_ip", "dst_ip", *ports, "proto", "action", us("event_ts").alias("event_us"))


@plan(
    "parse_generic_syslog",
    _EXPECTED
    + """select id, msg as message, case when source_type in ('palo_alto', 'windows') then 'windows' else 'generic' end as source_type,
 case when source_type = 'palo_alto' then fw_src else text_ip end as src_ip,
 case source_type when 'palo_alto' then fw_dst when 'windows' then mac else '00:00:00' end as dst_ip from e""",
)
def parse_generic_syslog(b: Bridge):
    return parse.parse_generic_syslog(b.raw).select("id", "message", "source_type", "src_ip", "dst_ip")


@plan(
    "classify_events",
    _EXPECTED
    + """select id, case when source_type in ('palo_alto', 'windows') then source_type else 'generic' end as source_type,
 case when source_type = 'palo_alto' then 'palo_alto' else 'generic' end as parser, msg as message, log_type,
 pri // 8 as facility, pri % 8 as severity, remote_ip as syslog_host,
 case when source_type = 'palo_alto' then fw_src else text_ip end as src_ip,
 case source_type when 'palo_alto' then fw_dst when 'windows' then mac else '00:00:00' end as dst_ip,
 action,
 case when source_type = 'palo_alto' then epoch_us(timestamp '2024-01-02 03:04:00') + (id % 10) * 1000000
  else epoch_us(received_at) end as event_us from e""",
)
def classify_events(b: Bridge):
    out = parse.classify_events(b.raw, RAW_MAP)
    return out.select(
        "id", "source_type", "parser", "message", "log_type", big("facility").alias("facility"), big("severity").alias("severity"),
        "syslog_host", "src_ip", "dst_ip", "action", us("event_ts").alias("event_us"),
    )


@plan(
    "classify_by_registry",
    with_views("b1") + "select id, case when source_type in ('palo_alto', 'windows') then source_type end as registry_type from b1",
)
def classify_by_registry(b: Bridge):
    return parse.classify_by_registry(b.raw).select("id", "registry_type")


_CLOUD_KEY = """case event_id % 3 when 2 then concat('mist:hash:', left(sha256(concat('{"message": "m', user_id, '", "other": "e',
 event_id % 400, '", "site_name": "s', user_id % 5, '", "timestamp": ',
 case when event_id % 2 = 0 then 1700000000 + event_id else (1700000000 + event_id) * 1000 end, ', "type": "',
 upper(event_type), '"}')), 32)) else concat('mist:e', event_id % 400) end"""


@plan("cloud_event_key", f"select event_id as seq, {_CLOUD_KEY} as key from events")
def cloud_event_key(b: Bridge):
    return b.cloud.select("seq", parse.cloud_key(F.col("body")).alias("key"))


@plan(
    "normalize_cloud_events",
    f"""select event_id as seq, concat(upper(event_type), ': m', user_id) as message, concat('s', user_id % 5) as syslog_host,
 upper(event_type) as log_type, '' as action, {_CLOUD_KEY} as parser, (1700000000 + event_id) * 1000000 as event_us from events""",
)
def normalize_cloud_events(b: Bridge):
    out = parse.normalize_cloud_events(b.cloud)
    return out.select("seq", "message", "syslog_host", "log_type", "action", "parser", us("event_ts").alias("event_us"))


# --- lines -------------------------------------------------------------------------------------------------

LINE_VIEW = with_views("b1", "b3")
_HAS_TIME = "b3.id % 13 <> 0 and b3.id % 10 <> 0"


@plan(
    "parse_line_timestamps",
    LINE_VIEW
    + f"""select source, line_index, case when {_HAS_TIME} then epoch_us(date_trunc('second', received_at)) end as ts_us,
 case when {_HAS_TIME} then epoch_us(date_trunc('second', received_at)) else epoch_us(received_at) end as sort_us from b3""",
)
def parse_line_timestamps(b: Bridge):
    out = parse.parse_line_timestamps(b.lines)
    return out.select("source", "line_index", us("ts").alias("ts_us"), us("sort_ts").alias("sort_us"))


TIMESTAMP_RULES = [
    {"id": "t1", "type": "regex", "file_glob": "app1.log,other*.log", "priority": 15, "enabled": True,
     "config": {"pattern": r"^(?P<event_date>\d{4}-\d{2}-\d{2})", "time_default": "12:00:00"}},
    {"id": "t2", "type": "regex", "file_glob": "app*.log", "priority": 5, "enabled": False,
     "config": {"pattern": r"(?P<event_date>\d{4}-\d{2}-\d{2})"}},
    {"id": "t3", "type": "bracketed", "file_glob": "*", "priority": 1, "enabled": True, "config": {}},
]


@plan(
    "parse_custom_timestamps",
    LINE_VIEW
    + f"""select source, line_index, case when {_HAS_TIME} then case when source like '%/app1.log'
  then epoch_us(date_trunc('day', received_at) + interval 12 hour) else epoch_us(date_trunc('second', received_at)) end end as ts_us
 from b3""",
)
def parse_custom_timestamps(b: Bridge):
    out = rules.parse_custom_timestamps(b.lines, TIMESTAMP_RULES)
    return out.select("source", "line_index", us("ts").alias("ts_us"))


_SYSLOG_COLUMNS = f"""
 case when {_HAS_TIME} then left(cast(b3.received_at as string), 19) else '' end as "timestamp",
 case when {_HAS_TIME} then concat('h', user_id % 6) else '' end as host,
 case when {_HAS_TIME} then concat('unit', b3.id % 4) else '' end as unit,
 case when {_HAS_TIME} then cast(b3.id % 500 as string) else '' end as pid,
 case when b3.id % 13 = 0 then '' else b1.message end as message"""
_SYSLOG_FROM = " from b3 join b1 on b1.id = b3.id join events on event_id = b3.id"


@plan("columnize_syslog", LINE_VIEW + f"select b3.source, b3.line_index, {_SYSLOG_COLUMNS} {_SYSLOG_FROM}")
def columnize_syslog(b: Bridge):
    out = b.lines.withColumn("c", syslog_columns(F.col("line")))
    return out.select("source", "line_index", "c.*")


@plan(
    "columnize_csv",
    with_views("b1")
    + """select id, 32::bigint as fields, '1' as col1, log_type as col4, coalesce(src_ip, '198.51.100.1') as col9, 'rule, a' as col13,
 '' as col14, action as col28 from b1 where source_type = 'palo_alto'""",
)
def columnize_csv(b: Bridge):
    firewall = parse.parse_firewall_csv(b.raw, RAW_MAP).withColumn("c", csv_map(F.col("message")))
    picked = [F.try_element_at("c", F.lit(n)).alias(n) for n in ("col1", "col4", "col9", "col13", "col14", "col28")]
    return firewall.select("id", big(F.size("c")).alias("fields"), *picked)


_USER_PATTERN = r"user(?P<user>\d+) (?P<rest>.*)$"


@plan(
    "columnize_regex",
    LINE_VIEW
    + r"""select source, line_index, nullif(regexp_extract(line, 'user(\d+) (.*)$', 1), '') as "user",
 nullif(regexp_extract(line, 'user(\d+) (.*)$', 2), '') as rest,
 case when not regexp_matches(line, 'user(\d+) (.*)$') then line end as line from b3""",
)
def columnize_regex(b: Bridge):
    out = b.lines.withColumn("c", regex_map(F.col("line"), _USER_PATTERN))
    return out.select("source", "line_index", *[F.try_element_at("c", F.lit(n)).alias(n) for n in ("user", "rest", "line")])


COLUMNIZERS = [
    {"id": "c1", "type": "syslog", "file_glob": "app0.log", "priority": 10, "enabled": True},
    {"id": "c2", "type": "csv", "file_glob": "app1.log", "priority": 10, "enabled": True, "config": {"delimiter": " "}},
    {"id": "c3", "type": "regex", "file_glob": "app?.log", "priority": 1, "enabled": True, "config": {"pattern": _USER_PATTERN}},
    {"id": "c4", "type": "raw", "file_glob": "*", "priority": 99, "enabled": False},
]

_COLUMNS_TEXT = r"""case when source like '%/app0.log' then concat('host=', host, '|message=', message, '|pid=', pid, '|timestamp=',
  "timestamp", '|unit=', unit)
 when source like '%/app1.log' then array_to_string(list_sort(list_transform(range(1, len(string_split(line, ' ')) + 1),
  lambda i: concat('col', i, '=', string_split(line, ' ')[i]))), '|')
 when regexp_matches(line, 'user(\d+) (.*)$') then concat('rest=', regexp_extract(line, 'user(\d+) (.*)$', 2), '|user=',
  regexp_extract(line, 'user(\d+) (.*)$', 1))
 else concat('line=', line) end"""


def columns_text():
    pairs = F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), "|")


@plan(
    "apply_columnizers",
    LINE_VIEW
    + f"""select source, line_index, {_COLUMNS_TEXT} as columns_text
 from (select b3.source, b3.line_index, b3.line, {_SYSLOG_COLUMNS} {_SYSLOG_FROM}) x""",
)
def apply_columnizers(b: Bridge):
    out = rules.apply_columnizers(b.lines, COLUMNIZERS)
    return out.select("source", "line_index", columns_text().alias("columns_text"))


@plan(
    "filter_sort_columns",
    LINE_VIEW
    + f"""select source, line_index, message from (select b3.source, b3.line_index, {_SYSLOG_COLUMNS} {_SYSLOG_FROM}) x
 where contains(lower(host), 'h3') and contains(lower(message), 'denied') order by lower(message)""",
)
def filter_sort_columns(b: Bridge):
    lines = b.lines.withColumn("columns", syslog_map(F.col("line")))
    out = search.filter_sort_columns(lines, {"host": "H3", "message": "denied"}, "message")
    return out.select("source", "line_index", F.col("columns")["message"].alias("message"))


# --- origins, Windows records, framing ---------------------------------------------------------------------


@plan(
    "normalize_origins",
    LINE_VIEW
    + """select 'hub' as origin, id, message, epoch_us(received_at) as received_us, cast(null as string) as source from b1
 union all select 'files', id, line, epoch_us(received_at), source from b3""",
)
def normalize_origins(b: Bridge):
    out = parse.normalize_origins(b.events, b.lines)
    return out.select("origin", "id", "message", us("received_at").alias("received_us"), "source")


@plan(
    "union_origins",
    LINE_VIEW
    + """select 'hub' as origin, id, message, source_type from b1 union all select 'files', id, line, null from b3
 union all select 'archive', -id, message, 'imported' from b1""",
)
def union_origins(b: Bridge):
    from logquarry.sources.tables import scan_archive_logs

    archive = scan_archive_logs(b.events, since_id=-1, limit=None)
    return parse.normalize_origins(b.events, b.lines, archive).select("origin", "id", "message", "source_type")


def windows_records(b: Bridge):
    """Exported Windows records derived from the events."""
    return b.table("events").select(
        F.col("event_id").alias("record_id"),
        F.concat(F.lit("Provider-"), (F.col("user_id") % 4).cast("string")).alias("provider"),
        (F.col("event_id") % 7).alias("event_id"),
        F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 6).alias("level"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("description"),
        F.lit("System").alias("log_name"),
        F.col("ts").alias("created_at"),
    )


@plan(
    "windows_event_rows",
    """select event_id as record_id, (case event_id % 6 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 5 else 6 end)::bigint as severity,
 concat('[System] ', case when event_id % 2 = 0 then event_type
  else concat('EventId=', event_id % 7, ' Provider=Provider-', user_id % 4) end) as message
 from events where user_id % 4 in (0, 2) and event_id % 7 in (1, 2, 4, 5)
  and (case when event_id % 6 > 0 then event_id % 6 else 4 end) in (1, 2, 4)
  and ts >= timestamp '2024-01-05 00:00:00' - interval 10 minute""",
)
def windows_event_rows(b: Bridge):
    out = parse.windows_event_rows(
        windows_records(b),
        providers=["PROVIDER-0", "provider-2"],
        event_ids=[1, 2, 4, 5],
        levels=[1, 2, 4],
        started_at=F.lit("2024-01-05 00:00:00").cast("timestamp"),
        grace_minutes=10,
    )
    return out.select("record_id", big("severity").alias("severity"), "message")


@plan(
    "encode_rfc5424",
    LINE_VIEW
    + r"""select id, concat('<', 8 + id % 8, '>1 ', strftime(received_at, '%Y-%m-%dT%H:%M:%S.%g'), '+00:00 collector ',
 regexp_replace(split_part(source, '/', -1), '\.log$', ''), ' - - - ', case when line = '' then '-' else line end) as encoded from b3""",
)
def encode_rfc5424(b: Bridge):
    out = parse.encode_rfc5424(
        b.lines,
        facility=F.lit(1),
        severity=F.col("id") % 8,
        ts=F.col("received_at"),
        host=F.lit("collector"),
        app=parse.app_name_of(F.col("source")),
        message=F.col("line"),
    )
    return out.select("id", "encoded")


