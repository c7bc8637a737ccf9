"""Queries over joins, rules, aggregates, rankings and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.bridge import Bridge, spread, with_views
from logquarry.operators import aggregates, gate, joins, parse, ranking, rules
from logquarry.plans.base import ANALYSES_NOW, EVENTS_NOW, at, big, plan, us
from logquarry.plans.parsing import LINE_VIEW
from logquarry.plans.searching import B1, EVENT_COLUMNS, event_rows, failure_sql
from logquarry.sources import sinks
from logquarry.sources.tables import scan_archive_analyses as archive_analyses
from logquarry.sources.tables import typed_anomalies

B4 = with_views("b4")
B5 = with_views("b5")
_EVENTS = ", ".join(EVENT_COLUMNS) + ", epoch_us(received_at) as received_us"

# --- geography ---------------------------------------------------------------------------------------------

_IP = "split_part({0}, '.', 1)::bigint * 16777216 + split_part({0}, '.', 2)::bigint * 65536 + split_part({0}, '.', 3)::bigint * 256 + split_part({0}, '.', 4)::bigint"


def ip_sql(column: str) -> str:
    return "(" + _IP.format(column) + ")"


@plan(
    "geo_enrich",
    with_views("b5", "b6")
    + f"""select src_ip, dst_ip, bytes, cast(null as double) as src_lat, cast(null as string) as src_country, g.lat as dst_lat,
 g.lon as dst_lon, g.country as dst_country from b5 left join b6 g on {ip_sql("dst_ip")} between g.ip_lo and g.ip_hi""",
)
def geo_enrich(b: Bridge):
    out = joins.geo_enrich(spread(b.flows).drop("src_lat", "src_lon", "dst_lat", "dst_lon"), b.ranges)
    return out.select("src_ip", "dst_ip", "bytes", "src_lat", "src_country", "dst_lat", "dst_lon", "dst_country")


@plan(
    "geo_enrich_distinct",
    with_views("b5", "b6")
    + f"""select dst_country, count(*) as flows, sum(bytes)::bigint as bytes from (select b5.bytes, g.country as dst_country
 from b5 left join b6 g on {ip_sql("dst_ip")} between g.ip_lo and g.ip_hi) x group by dst_country""",
)
def geo_enrich_distinct(b: Bridge):
    """The path for ranges too large to send everywhere: distinct addresses meet the ranges."""
    out = joins.geo_enrich(b.flows, b.ranges, addresses={"dst_ip": "dst_"}, broadcast_ranges=False)
    return out.groupBy("dst_country").agg(F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"))


@plan(
    "geo_enrich_ipv6",
    with_views("b6")
    + f""", f as (select l_orderkey as id, l_linenumber as form, l_partkey % 3 = 0 as hot, l_partkey % 30 as net, l_suppkey % 40 as host,
  concat('203.0.', l_partkey % 40, '.', l_partkey % 25) as four, l_quantity::bigint as bytes from lineitem),
 p as (select *, case when form <> 7 and hot then 3 when form in (1, 2) then net end as n, case when hot then 5 else host end as h from f)
select id, form, bytes, coalesce(x.n_name, g.country) as dst_country, coalesce(x.n_nationkey::double, g.lat) as dst_lat
from p left join nation x on x.n_nationkey = p.n and case n_nationkey % 3 when 0 then true when 1 then h <= 15 else h between 3 and 17 end
left join b6 g on p.form in (3, 4) and not p.hot and {ip_sql("four")} between g.ip_lo and g.ip_hi""",
)
def geo_enrich_ipv6(b: Bridge):
    """Long, short, mapped and malformed addresses over ranges of very different widths, beside the IPv4 ranges."""
    out = joins.geo_enrich(spread(b.flows_6), b.ranges, addresses={"dst_ip": "dst_"}, ranges_6=b.ranges_6)
    return out.select("id", "form", "bytes", "dst_country", "dst_lat")


@plan(
    "geo_enrich_asn",
    with_views("b5", "b6")
    + f"""select dst_ip, case when g.lat is null then '' else concat('AS', cast(64500 + cast(g.lat as bigint) as string), case when cast(g.lat as bigint) % 2 = 0
 then concat(' ', g.country) else '' end) end as asn, count(*) as flows
 from b5 left join b6 g on {ip_sql("dst_ip")} between g.ip_lo and g.ip_hi group by 1, 2""",
)
def geo_enrich_asn(b: Bridge):
    """A second range table with network labels, after aggregation."""
    org = F.when(F.col("lat") % 2 == 0, F.col("country"))
    asn = joins.with_asn_label(b.ranges.withColumn("asn_number", 64500 + F.col("lat").cast("long")).withColumn("asn_org", org))
    counts = b.flows.groupBy("dst_ip").agg(F.count(F.lit(1)).alias("flows"))
    out = joins.geo_enrich(counts, asn, addresses={"dst_ip": ""}, values=["asn"])
    return out.select("dst_ip", F.coalesce("asn", F.lit("")).alias("asn"), "flows")


# --- rules -------------------------------------------------------------------------------------------------


@plan(
    "match_alert_rules",
    B1
    + """, hits as (select id as event_id, 'r1' as rule_id, source_type, remote_ip, message as line from b1
  where contains(lower(message), 'denied') or contains(lower(message), 'authentication failure')
 union all select id, 'r2', source_type, remote_ip, message from b1 where source_type = 'palo_alto' and contains(lower(message), 'reset')
 union all select id, 'r3', source_type, remote_ip, message from b1 where regexp_matches(message, 'critical|fatal|raid', 'i'))
 select event_id, rule_id, concat(source_type, ':', remote_ip) as source, line from hits""",
)
def match_alert_rules(b: Bridge):
    return rules.match_alert_rules(b.events, rules.active_rules(b.rules)).select("event_id", "rule_id", "source", "line")


@plan(
    "match_line_rules",
    LINE_VIEW
    + f"""select id as event_id, 'r1' as rule_id, source from b3 where contains(lower(line), 'denied') or contains(lower(line), 'authentication failure')
 union all select id, 'r2', source from b3 where contains(lower(line), 'reset')
 union all select id, 'r3', source from b3 where regexp_matches(line, 'critical|fatal|raid', 'i')
 union all select id, 'r4', source from b3 where source like '/var/log/nginx%' and regexp_matches(source, '/app[^/]*[.]log$')
  and contains(lower(line), 'error') and {failure_sql("line")}""",
)
def match_line_rules(b: Bridge):
    return rules.match_line_rules(b.line_rows, rules.active_rules(b.rules)).select("event_id", "rule_id", "source")


@plan(
    "saved_search_hits",
    LINE_VIEW
    + """select id as event_id, 'r1' as search_id, source from b3 where contains(lower(line), 'denied') or contains(lower(line), 'authentication failure')
 union all select id, 'r2', source from b3 where contains(lower(line), 'reset')
 union all select id, 'r3', source from b3 where regexp_matches(line, 'critical|fatal|raid', 'i')
 union all select id, 'r4', source from b3 where source like '/var/log/nginx/%' and contains(lower(line), 'error')""",
)
def saved_search_hits(b: Bridge):
    return rules.saved_search_hits(b.line_rows, rules.active_rules(b.rules)).select("event_id", "search_id", "source")


FILE_RULES = [
    {"id": "a", "file_glob": "app*.log", "priority": 1, "enabled": True},
    {"id": "b", "file_glob": "app[01].log, none*", "priority": 7, "enabled": True},
    {"id": "c", "file_glob": "app1.log", "priority": 7, "enabled": True},
    {"id": "d", "file_glob": "*", "priority": 99, "enabled": False},
]


@plan("resolve_file_rules", LINE_VIEW + r"select distinct source, case when regexp_matches(source, '/app[01]\.log$') then 'b' else 'a' end as rule_id from b3")
def resolve_file_rules(b: Bridge):
    return rules.resolve_file_rules(b.line_rows, FILE_RULES)


# a change wins over the stored row whatever its version; the newest change over the others
_RULE_VERSIONS = """select concat('rule', o_custkey % 200) as id, o_orderkey as updated_at, o_orderpriority as name, o_orderstatus as query,
 (o_orderkey % 5 <> 0)::int as enabled, o_orderkey % 3 = 0 as change from orders"""


def _won(value: str) -> str:
    return f"coalesce(arg_max({value}, updated_at) filter (change), arg_max({value}, updated_at))"


def _rule_versions(b: Bridge):
    key = F.col("o_orderkey")
    return b.table("orders").select(
        F.concat(F.lit("rule"), (F.col("o_custkey") % 200).cast("string")).alias("id"),
        key.alias("updated_at"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("query"),
        (key % 5 != 0).alias("enabled"),
    )


def _upserted(b: Bridge):
    versions = _rule_versions(b)
    return rules.upsert_by_key(versions.filter("updated_at % 3 <> 0"), versions.filter("updated_at % 3 = 0"), "id", "updated_at")


_UPSERTED = f"""with v as ({_RULE_VERSIONS}), u as (select id, {_won("name")} as name, {_won("query")} as query,
 {_won("enabled")} as enabled, {_won("updated_at")} as updated_at from v group by id) """


@plan("upsert_by_key", _UPSERTED + "select * from u")
def upsert_by_key(b: Bridge):
    out = _upserted(b)
    return out.select("id", "name", "query", F.col("enabled").cast("int").alias("enabled"), "updated_at")


@plan("delete_and_list_by_key", _UPSERTED + "select id, name, query from u where id not in ('rule7', 'rule11', 'rule150') and enabled = 1")
def delete_and_list_by_key(b: Bridge):
    """What is listed after three keys were deleted."""
    left = rules.delete_by_key(_upserted(b), "id", ["rule7", "rule11", "rule150"])
    return left.filter("enabled").select("id", "name", "query")


@plan(
    "upsert_schedules",
    """select file_path, coalesce(max(o_orderkey) filter (o_orderkey % 2 = 1), max(o_orderkey)) as version,
 coalesce(arg_max(o_orderpriority, o_orderkey) filter (o_orderkey % 2 = 1), arg_max(o_orderpriority, o_orderkey)) as min_severity,
 coalesce(min(o_orderkey) filter (o_orderkey % 2 = 0), min(o_orderkey)) as created
 from (select *, concat('/var/log/app', o_custkey % 500, '.log') as file_path from orders) x group by file_path""",
)
def upsert_schedules(b: Bridge):
    """Schedules keyed by file: the newest change wins, the first creation stays."""
    changes = b.table("orders").select(
        F.concat(F.lit("/var/log/app"), (F.col("o_custkey") % 500).cast("string"), F.lit(".log")).alias("file_path"),
        F.col("o_orderkey").alias("version"),
        F.col("o_orderpriority").alias("min_severity"),
        F.col("o_orderkey").alias("created"),
    )
    old, new = changes.filter("version % 2 = 0"), changes.filter("version % 2 = 1")
    return rules.upsert_by_key(old, new, "file_path", "version", keep=["created"])


# --- set checks --------------------------------------------------------------------------------------------


def _parsed_cloud(b: Bridge):
    return parse.normalize_cloud_events(b.cloud)


@plan(
    "dedup_new_events",
    """with k as (select event_id as seq, concat(case event_id % 3 when 2 then 'hash' else 'e' end,
  case event_id % 3 when 2 then cast(event_id as string) else cast(event_id % 400 as string) end) as key from events)
 select min(seq) as seq from k where key not in (select key from k where seq < 150) group by key""",
)
def dedup_new_events(b: Bridge):
    parsed = _parsed_cloud(b)
    stored = parsed.filter("seq < 150").select("parser")
    return joins.dedup_new_events(parsed, stored).select("seq")


@plan(
    "merge_archive_flows",
    B5
    + """, live as (select src_ip, dst_ip, count(*) as cnt, max(src_lat) as a, max(dst_lat) as z from b5 where ts >= timestamp '1999-01-01'
  group by 1, 2 having max(src_lat) is not null and max(dst_lat) is not null),
 arch as (select src_ip, dst_ip, count(*) as cnt, max(src_lat) as a, max(dst_lat) as z from b5
  group by 1, 2 having max(src_lat) is not null and max(dst_lat) is not null),
 m as (select src_ip, dst_ip, cnt, 0 as archived from live union all
  select src_ip, dst_ip, cnt, 1 from arch where not exists (select 1 from live l where l.src_ip = arch.src_ip and l.dst_ip = arch.dst_ip))
 select * from m order by archived, cnt desc, src_ip, dst_ip limit 100000""",
)
def merge_archive_flows(b: Bridge):
    live = aggregates.flow_aggregates(b.flows.withColumn("event_ts", F.col("ts")), since=at("1999-01-01"), limit=None)
    archive = aggregates.archive_flow_aggregates(b.flows, limit=None)
    return joins.merge_archive_flows(live, archive, limit=100000).select("src_ip", "dst_ip", "cnt", "archived")


@plan("new_and_gone_sources", with_views("b10") + """select path, case when size_bytes % 4 = 0 then 'gone' else 'new' end as change from b10
 where (size_bytes % 4 = 0) <> (size_bytes % 3 = 0) and (size_bytes % 4 = 0 or size_bytes % 3 = 0)""")
def new_and_gone_sources(b: Bridge):
    return joins.new_and_gone_sources(b.files.filter("size_bytes % 4 = 0"), b.files.filter("size_bytes % 3 = 0"))


@plan("events_by_ids", B1 + "select id, message from b1 where id in (select o_orderkey from orders where o_orderstatus = 'F')")
def events_by_ids(b: Bridge):
    wanted = b.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return joins.events_by_ids(b.events, wanted).select("id", "message")


@plan("cloud_events_by_window", B1 + f"select {_EVENTS} from b1 where source_type = 'mist' and received_at >= timestamp '2024-01-10' order by received_at desc, id desc limit 200")
def cloud_events_by_window(b: Bridge):
    """The cloud variant: the newest ids of a window, then their events."""
    ids = joins.newest_cloud_ids(b.events, since=at("2024-01-10"), limit=200)
    return event_rows(joins.events_by_ids(b.events, ids))


@plan(
    "related_events",
    B1
    + f"""select {_EVENTS} from b1, (select remote_ip as r, src_ip as s, dst_ip as d, substr(message, strpos(message, 'aa:bb:')) as mac
  from b1 where id = 421) t where id <> 421 and (remote_ip = r or contains(message, r) or coalesce(src_ip = s or dst_ip = s or contains(message, s), false)
  or coalesce(src_ip = d or dst_ip = d or contains(message, d), false) or contains(message, mac)) order by received_at desc, id desc limit 30""",
)
def related_events(b: Bridge):
    return event_rows(joins.related_events(b.events, 421))


@plan(
    "mark_analyzed",
    with_views("b1", "b4")
    + """, v as (select log_id, arg_max(severity, aid) as severity, arg_max(summary, aid) as summary, max(aid) as aid from
 (select b4.id as aid, severity, left(summary, 500) as summary, unnest([b4.id // 2, b4.id // 2 + 1, b4.id // 2 + 7]) as log_id
  from b4 where error is null) x group by log_id)
 select b1.id, v.severity as llm_severity, v.summary as llm_summary, v.aid as analysis_id from b1 left join v on v.log_id = b1.id""",
)
def mark_analyzed(b: Bridge):
    first = F.expr("id div 2")
    analyses = b.analyses.withColumn("log_ids", F.array(first, first + 1, first + 7))
    return joins.mark_analyzed(b.events, analyses).select("id", "llm_severity", "llm_summary", "analysis_id")


_JOB_STATUS = "case id % 5 when 0 then 'done' when 1 then 'error' when 2 then 'failed' when 3 then 'cancelled' else 'running' end"


def jobs(b: Bridge):
    """File analysis jobs derived from the analyses."""
    result = F.to_json(F.struct("severity", F.concat(F.lit("  "), "summary").alias("summary")))
    return b.analyses.select(
        "id",
        F.concat(F.lit("/var/log/app"), (F.col("id") % 100).cast("string"), F.lit(".log")).alias("file_path"),
        F.expr(_JOB_STATUS).alias("status"),
        "created_at",
        F.when(F.col("id") % 3 > 0, F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"),
        F.when(F.col("error").isNull(), result).alias("result_json"),
        "error",
    )


def schedules(b: Bridge):
    """Schedules derived from the analyses."""
    return b.analyses.select(
        "id",
        (F.col("id") % 3 > 0).alias("enabled"),
        F.when(F.col("id") % 7 > 0, F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("next_run_at"),
        F.element_at(F.array(F.lit(1), F.lit(2), F.lit(7)), (F.col("id") % 3 + 1).cast("int")).alias("interval_days"),
        (F.col("id") % 26).alias("run_at_hour"),
        F.element_at(F.array(*[F.lit(x) for x in ("warning", "error", "critical", "medium", "low", "odd")]), (F.col("id") % 6 + 1).cast("int")).alias("min_severity"),
        (F.col("id") % 2 == 0).alias("alert_on_anomalies"),
        F.col("id").alias("last_job_id"),
        F.lit("running").alias("last_status"),
        F.lit("").alias("last_error"),
    )


@plan(
    "schedule_job_status",
    B4
    + """select id, case id % 5 when 0 then 'done' when 3 then 'cancelled' when 4 then 'running' else 'error' end as last_status,
 case id % 5 when 0 then '' when 3 then 'cancelled' when 4 then '' else coalesce(error, 'analysis failed') end as last_error from b4""",
)
def schedule_job_status(b: Bridge):
    finished = jobs(b).select(F.col("id").alias("job_id"), "status", "error")
    return joins.schedule_job_status(schedules(b), finished).select("id", "last_status", "last_error")


@plan(
    "schedule_alert_decision",
    B4
    + """select id, cast((id % 2 = 0 and json_array_length(anomalies_json) > 0)
 or (case severity when 'critical' then 5 else 1 end) >= (case id % 6 when 1 then 4 when 2 then 5 else 3 end) as int) as should_alert from b4""",
)
def schedule_alert_decision(b: Bridge):
    results = typed_anomalies(b.analyses).join(schedules(b).select("id", "min_severity", "alert_on_anomalies"), "id")
    return joins.schedule_alert_decision(results).select("id", F.col("should_alert").cast("int").alias("should_alert"))


@plan(
    "due_schedules",
    B4
    + f"""select id, epoch_us(case when c <= n then c + interval 1 day else c end) as following_us from (
 select id, timestamp '{ANALYSES_NOW}' as n, date_trunc('day', timestamp '{ANALYSES_NOW}') + to_days(cast([1, 2, 7][id % 3 + 1] as int))
  + to_hours(least(id % 26, 23)) as c, created_at from b4 where id % 3 > 0 and id % 7 > 0) x
 where created_at + interval 1 day <= n""",
)
def due_schedules(b: Bridge):
    return ranking.due_schedules(schedules(b), at(ANALYSES_NOW)).select("id", us("following_run_at").alias("following_us"))


# --- aggregates --------------------------------------------------------------------------------------------


@plan(
    "flow_aggregates",
    B5
    + """select src_ip, dst_ip, count(*) as cnt, max(src_lat) as src_lat, max(dst_lon) as dst_lon from b5 group by 1, 2
 having max(src_lat) is not null and max(dst_lat) is not null order by cnt desc, src_ip, dst_ip limit 2000""",
)
def flow_aggregates(b: Bridge):
    events = b.flows.withColumn("event_ts", F.col("ts"))
    return aggregates.flow_aggregates(events, limit=2000).select("src_ip", "dst_ip", "cnt", "src_lat", "dst_lon")


@plan(
    "archive_flow_aggregates",
    B5
    + """select src_ip, dst_ip, count(*) as cnt, sum(coalesce(bytes, 0))::bigint as sum_bytes, max(src_lon) as src_lon from b5
 where ts >= timestamp '1996-01-01' group by 1, 2
 having max(src_lat) is not null and max(dst_lat) is not null order by cnt desc, src_ip, dst_ip limit 2000""",
)
def archive_flow_aggregates(b: Bridge):
    out = aggregates.archive_flow_aggregates(b.flows, since=at("1996-01-01"), limit=2000)
    return out.select("src_ip", "dst_ip", "cnt", "sum_bytes", "src_lon")


@plan(
    "flow_map_points",
    with_views("b1", "b6")
    + f"""select dst_ip, flows, g.lat, g.lon, g.country from (select coalesce(dst_ip, '203.0.113.9') as dst_ip, count(*) as flows from b1
  where source_type = 'palo_alto' and log_type = 'TRAFFIC' and action = 'allow' group by 1) f
 join b6 g on {ip_sql("f.dst_ip")} between g.ip_lo and g.ip_hi where f.dst_ip <> '203.0.113.9'""",
)
def flow_map_points(b: Bridge):
    """Raw messages to allowed flows per destination, placed on the map."""
    raw = b.raw.withColumnRenamed("raw", "message")
    return aggregates.flow_map_points(raw, b.ranges).select("dst_ip", "flows", "lat", "lon", "country")


@plan(
    "count_events",
    B1
    + """select source_type, count(*) as events, count(*) filter (where received_at >= timestamp '2024-01-15') as recent
 from b1 group by source_type union all select null, count(*), count(*) filter (where received_at >= timestamp '2024-01-15') from b1""",
)
def count_events(b: Bridge):
    return aggregates.count_events(b.events, since=at("2024-01-15"))


@plan(
    "window_counts",
    with_views("b1", "b4")
    + """select (select count(*) from b1 where received_at between timestamp '2024-01-05' and timestamp '2024-01-20') as raw_in_window,
 (select count(*) from b1 where id % 3 = 0 and received_at between timestamp '2024-01-05' and timestamp '2024-01-20') as pending_in_window,
 (select count(*) from b4 where created_at + interval 9000 day between timestamp '2024-01-05' and timestamp '2024-01-20') as analyses_in_window""",
)
def window_counts(b: Bridge):
    events = b.events.withColumn("analyzed_at", F.when(F.col("id") % 3 > 0, F.col("received_at")))
    analyses = b.analyses.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 9000 DAY"))
    return aggregates.window_counts(events, analyses, at("2024-01-05"), at("2024-01-20"))


@plan(
    "analysis_coverage",
    B4
    + """select count(distinct cast(created_at as date)) as distinct_days, strftime(min(created_at), '%Y-%m-%d') as oldest_day,
 strftime(max(created_at), '%Y-%m-%d') as newest_day from b4 where error is null""",
)
def analysis_coverage(b: Bridge):
    return aggregates.analysis_coverage(b.analyses)


_SUMS = """count(*) as analyses_total, count(*) filter (where error is null) as ok_total, count(*) filter (where error is not null) as err_total,
 {0} count(*) filter (where error is null and severity in ('high', 'critical')) as elevated_total,
 coalesce(sum(json_array_length(anomalies_json)) filter (where error is null), 0)::bigint as anomalies_total"""
_BOTH = "count(*) filter (where error is null and severity = 'high') as sev_high, count(*) filter (where error is null and severity = 'critical') as sev_critical,"


@plan("analysis_window_stats", B4 + f"select {_SUMS.format(_BOTH)} from b4 where created_at between timestamp '1996-01-01' and timestamp '{ANALYSES_NOW}'")
def analysis_window_stats(b: Bridge):
    return aggregates.analysis_window_stats(b.analyses, at("1996-01-01"), at(ANALYSES_NOW))


_TODAY = "2001-06-30"
_DAILY = (
    B4
    + f""", daily as (select strftime(created_at, '%Y-%m-%d') as "day", {_SUMS.format("")} from b4
 where created_at >= date '{_TODAY}' - 400 group by 1)
"""
)


def _daily(b: Bridge):
    return aggregates.daily_trend(b.analyses, F.lit(_TODAY).cast("date"), lookback_days=400)


@plan("daily_trend", _DAILY + "select * from daily")
def daily_trend(b: Bridge):
    return _daily(b)


@plan("daily_trend_typed", _DAILY + "select * from daily")
def daily_trend_typed(b: Bridge):
    """The same over typed anomaly arrays."""
    return aggregates.daily_trend(typed_anomalies(b.analyses), F.lit(_TODAY).cast("date"), lookback_days=400)


_WEEKLY = """select isoyear(cast("day" as date)) as iso_year, weekofyear(cast("day" as date)) as iso_week,
 strftime(date_trunc('week', cast("day" as date)), '%Y-%m-%d') as week_start,
 printf('%d-W%02d', isoyear(cast("day" as date)), weekofyear(cast("day" as date))) as week_label,
 sum(analyses_total)::bigint as analyses_total, sum(ok_total)::bigint as ok_total, sum(err_total)::bigint as err_total,
 sum(elevated_total)::bigint as elevated_total, sum(anomalies_total)::bigint as anomalies_total from daily group by 1, 2, 3, 4"""


@plan("weekly_trend", _DAILY + _WEEKLY)
def weekly_trend(b: Bridge):
    out = aggregates.weekly_trend(_daily(b))
    return out.withColumn("iso_year", big("iso_year")).withColumn("iso_week", big("iso_week"))


@plan(
    "dense_days",
    _DAILY
    + f"""select strftime(d, '%Y-%m-%d') as "day", coalesce(analyses_total, 0) as analyses_total, coalesce(ok_total, 0) as ok_total,
 coalesce(err_total, 0) as err_total, coalesce(elevated_total, 0) as elevated_total, coalesce(anomalies_total, 0) as anomalies_total
 from (select unnest(generate_series(date '{_TODAY}' - 199, date '{_TODAY}', interval 1 day)) as d) c left join daily on "day" = strftime(d, '%Y-%m-%d')""",
)
def dense_days(b: Bridge):
    return aggregates.dense_days(_daily(b), F.lit(_TODAY).cast("date"), lookback_days=200)


@plan(
    "trend_delta",
    _DAILY
    + """, w as (select *, row_number() over (order by week_start desc) as n from ("""
    + _WEEKLY
    + """) y where analyses_total > 0),
 d as (select a.week_start as previous, z.week_start as latest, z.ok_total - a.ok_total as o, z.elevated_total - a.elevated_total as e,
  z.anomalies_total - a.anomalies_total as m from w z join w a on z.n = 1 and a.n = 2)
 select previous, latest, o as ok_total_delta, e as elevated_total_delta, m as anomalies_total_delta,
 case when o = 0 and e = 0 and m = 0 then 'Last week looks similar to the prior one (same ballpark of analyses and flags).'
 else concat('Versus the prior week: ', array_to_string(list_filter([case when o <> 0 then printf('completed analyses %+d', o) end,
  case when e <> 0 then printf('high/critical bucket %+d', e) end, case when m <> 0 then printf('reported anomalies %+d', m) end],
  lambda x: x is not null), ', '), '.') end as sentence from d""",
)
def trend_delta(b: Bridge):
    return aggregates.trend_delta(aggregates.weekly_trend(_daily(b)), "week_start", "week")


@plan("trend_scale", _DAILY + "select greatest(1, max(analyses_total), max(ok_total + err_total), max(elevated_total), max(anomalies_total // 3)) as scale from daily")
def trend_scale(b: Bridge):
    return aggregates.trend_scale(_daily(b))


@plan(
    "baseline_level",
    B4
    + """select *, case when distinct_days <= 0 then 'empty' when distinct_days < 3 then 'seed' when distinct_days < 7 then 'young'
 when distinct_days < 14 then 'warming' else 'steady' end as level from (select count(distinct cast(created_at as date)) as distinct_days,
 strftime(min(created_at), '%Y-%m-%d') as oldest_day, strftime(max(created_at), '%Y-%m-%d') as newest_day from b4 where error is null) x""",
)
def baseline_level(b: Bridge):
    return aggregates.baseline_level(aggregates.analysis_coverage(b.analyses))


def summaries(b: Bridge):
    """Period summaries derived from the analyses."""
    return b.analyses.select(
        "id",
        F.when(F.col("id") % 4 == 0, "weekly").otherwise("daily").alias("granularity"),
        F.concat(F.lit("label "), F.col("id").cast("string")).alias("period_label"),
        F.when(F.col("severity") == "high", "high").otherwise("low").alias("confidence"),
        F.col("summary").alias("headline"),
        "error",
        "created_at",
    )


_SUMMARIES = B4 + ", s as (select *, case when id % 4 = 0 then 'weekly' else 'daily' end as granularity from b4)\n"


@plan(
    "summary_attempts",
    _SUMMARIES + "select granularity, max(epoch_us(created_at)) filter (where error is null) as ok_us, max(epoch_us(created_at)) as any_us from s group by granularity",
)
def summary_attempts(b: Bridge):
    out = aggregates.summary_attempts(summaries(b))
    return out.select("granularity", us("last_ok").alias("ok_us"), us("last_any").alias("any_us"))


@plan(
    "ingest_counters",
    B1
    + """select 'transport' as dimension, transport as value, count(*) as total from b1 group by 2
 union all select 'source_type', source_type, count(*) from b1 group by 2
 union all select 'log_type', log_type, count(*) from b1 group by 2""",
)
def ingest_counters(b: Bridge):
    return aggregates.ingest_counters(b.events, ["transport", "source_type", "log_type"])


@plan(
    "data_presence",
    B1
    + """select exists(select 1 from b1 where source_type = 'palo_alto' and received_at < timestamp '2024-01-20')::int as firewall,
 exists(select 1 from b1 where src_ip is not null and dst_ip is not null and received_at < timestamp '2024-01-20')::int as flows,
 exists(select 1 from b1 where source_type = 'mist' and received_at >= timestamp '2030-01-01')::int as cloud,
 exists(select 1 from orders where o_orderdate >= timestamp '2030-01-01')::int as analyses, 1 as summaries""",
)
def data_presence(b: Bridge):
    """Cloud events and analyses are asked for beyond the data, so two flags are false."""
    early, late = at("2024-01-20"), at("2030-01-01")
    events = b.events.filter(F.when(F.col("source_type") == "mist", F.col("received_at") >= late).otherwise(F.col("received_at") < early))
    out = aggregates.data_presence(events, b.analyses.filter(F.col("created_at") >= late), summaries(b))
    return out.select(*[F.col(c).cast("int").alias(c) for c in out.columns])


@plan("oldest_line_ts", LINE_VIEW + "select source, min(epoch_us(date_trunc('second', received_at))) as oldest_us from b3 where id % 13 <> 0 and id % 10 <> 0 group by source")
def oldest_line_ts(b: Bridge):
    return aggregates.oldest_line_ts(parse.parse_line_timestamps(b.line_rows)).select("source", us("oldest_ts").alias("oldest_us"))


@plan(
    "ingest_rate_5m",
    B1
    + """select epoch_us(time_bucket(interval 5 minute, received_at)) as window_us, transport, source_type, count(*) as events
 from b1 group by 1, 2, 3""",
)
def ingest_rate_5m(b: Bridge):
    out = aggregates.ingest_rate(b.events, ["transport", "source_type"])
    return out.select(us("window_start").alias("window_us"), "transport", "source_type", "events")


@plan(
    "ingest_rate_sliding",
    B1
    + """select epoch_us(time_bucket(interval 1 minute, received_at) - to_minutes(k)) as window_us, transport, count(*) as events
 from b1, (select unnest(range(0, 5)) as k) s group by 1, 2""",
)
def ingest_rate_sliding(b: Bridge):
    out = aggregates.ingest_rate(b.events, ["transport"], slide="1 minute")
    return out.select(us("window_start").alias("window_us"), "transport", "events")


# --- newest first and retention ----------------------------------------------------------------------------


@plan("recent_analyses", B4 + f"select id, severity, summary, error from b4 where created_at between timestamp '1997-01-01' and timestamp '{ANALYSES_NOW}' order by created_at desc, id desc limit 50")
def recent_analyses(b: Bridge):
    out = ranking.recent_analyses(b.analyses, since=at("1997-01-01"), until=at(ANALYSES_NOW))
    return out.select("id", "severity", "summary", "error")


@plan("recent_summaries", _SUMMARIES + "select id, granularity, summary as headline from s where granularity = 'daily' and error is null order by created_at desc, id desc limit 8")
def recent_summaries(b: Bridge):
    return ranking.recent_summaries(summaries(b), "daily", 8).select("id", "granularity", "headline")


@plan("window_analyses", B4 + f"select id, summary from b4 where created_at between timestamp '1997-01-01' and timestamp '{ANALYSES_NOW}' and model <> '(auto-skip)' order by id limit 9999")
def window_analyses(b: Bridge):
    return ranking.window_analyses(b.analyses, at("1997-01-01"), at(ANALYSES_NOW), 9999).select("id", "summary")


@plan(
    "recent_jobs",
    B4
    + """select id, concat('app', id % 100, '.log') as file_name, case when error is null then severity else '' end as severity,
 case when error is null then summary else '' end as summary from b4 where id % 5 in (0, 1, 2)
 order by created_at + case when id % 3 > 0 then interval 1 hour else interval 0 hour end desc, id desc limit 25""",
)
def recent_jobs(b: Bridge):
    return ranking.recent_jobs(jobs(b), 25).select("id", "file_name", "severity", "summary")


@plan(
    "keep_newest_jobs",
    B4
    + """select id from b4 where id % 5 in (3, 4) union all select * from (select id from b4 where id % 5 in (0, 1, 2)
 order by created_at + case when id % 3 > 0 then interval 1 hour else interval 0 hour end desc, id desc limit 99) x""",
)
def keep_newest_jobs(b: Bridge):
    return ranking.keep_newest_jobs(jobs(b), 99).select("id")


@plan("keep_newest", B4 + "select id, severity from b4 order by id desc limit 5000")
def keep_newest(b: Bridge):
    return ranking.keep_newest(b.analyses, "id", 5000).select("id", "severity")


@plan("prune_by_age", B1 + f"select id, source_type from b1 where received_at >= timestamp '{EVENTS_NOW}' - interval 14 day")
def prune_by_age(b: Bridge):
    return ranking.prune_by_age(b.events, at(EVENTS_NOW) - F.expr("INTERVAL 14 DAY")).select("id", "source_type")


@plan(
    "prune_by_cap",
    B1
    + """, r as (select id, source_type, row_number() over (partition by source_type order by id desc) as n, count(*) over () as total from b1),
 d as (select id, row_number() over (order by id) as k, total from r where not (source_type = 'mist' and n <= 120 or source_type = 'palo_alto' and n <= 60))
 select id, source_type from r where id not in (select id from d where k <= total - 400)""",
)
def prune_by_cap(b: Bridge):
    return ranking.prune_by_cap(b.events, 400, {"mist": 120, "palo_alto": 60}).select("id", "source_type")


# --- alert table -------------------------------------------------------------------------------------------


def hits(b: Bridge):
    """Event hits with delivery targets."""
    found = rules.match_alert_rules(b.events, rules.active_rules(b.rules))
    hook = F.when(F.col("rule_id") == "r1", "https://discord.com/api/webhooks/1/x").when(F.col("rule_id") == "r2", "https://hooks.example.org/y")
    mail = F.when(F.col("rule_id") == "r2", "ops@example.org")
    return found.withColumn("webhook_url", hook).withColumn("email_to", mail)


_HITS = (
    B1
    + """, hits as (select id as event_id, 'r1' as rule_id, 300 as cooldown, 'auth failures v2' as rule_name, received_at as ts, source_type, remote_ip, message as line from b1
  where contains(lower(message), 'denied') or contains(lower(message), 'authentication failure')
 union all select id, 'r2', 60, 'blocked flows', received_at, source_type, remote_ip, message from b1 where source_type = 'palo_alto' and contains(lower(message), 'reset')
 union all select id, 'r3', 600, 'crit regex', received_at, source_type, remote_ip, message from b1 where regexp_matches(message, 'critical|fatal|raid', 'i'))
"""
)


@plan(
    "alert_payloads",
    _HITS
    + """select event_id, rule_id, left(concat('**log-alerts**', chr(10), 'Rule: ', rule_name, chr(10), 'Source: ', source_type, ':', remote_ip,
 chr(10), '```', chr(10), left(line, 1800), chr(10), '```'), 2000) as chat_text, cast(rule_id = 'r1' as int) as chat from hits""",
)
def alert_payloads(b: Bridge):
    found = hits(b)
    out = sinks.alert_payloads(found, url=F.col("webhook_url"))
    chat = F.get_json_object("request_body", "$.content").isNotNull().cast("int")
    return out.select("event_id", "rule_id", "chat_text", chat.alias("chat"))


@plan(
    "recent_alert_events",
    _HITS + "select event_id, rule_id, line from hits order by ts desc, event_id desc limit 100",
)
def recent_alert_events(b: Bridge):
    return ranking.recent_alert_events(hits(b)).select("event_id", "rule_id", "line")


# one row per (rule, source) and fire: the next fire is the first hit at least a cooldown later
_FIRES = """, h as (select event_id, rule_id, concat(source_type, ':', remote_ip) as source, epoch_us(ts) as t, cooldown * 1000000 as wait from hits),
 fires as (select rule_id, source, min(t) as t from h group by 1, 2
  union all select f.rule_id, f.source, (select min(h.t) from h where h.rule_id = f.rule_id and h.source = f.source and h.t >= f.t + h.wait)
  from fires f where exists (select 1 from h where h.rule_id = f.rule_id and h.source = f.source and h.t >= f.t + h.wait))
"""
_COOLDOWN = _HITS.replace("with ", "with recursive ", 1) + _FIRES


@plan(
    "ingest_counters_all",
    _COOLDOWN
    + """, s as (select * from b1 where id % 17 <> 3 and id % 19 <> 4)
 select 'transport' as dimension, transport as value, count(*) as total from s group by 2
 union all select 'drop_reason', case when id % 17 = 3 then 'unparseable' else 'exception' end, count(*) from b1 where id % 17 = 3 or id % 19 = 4 group by 2
 union all select 'alert_origin', 'hub', (select count(*) from fires where t % 2000000 < 1000000)
 union all select 'stored', null, (select count(*) from s)""",
)
def ingest_counters_all(b: Bridge):
    """Counts by transport, drop reason and alert origin, and how many events are stored."""
    raw = b.events.select("id", F.when(F.col("id") % 17 == 3, "  ").otherwise(F.col("message")).alias("raw"))
    stored = b.events.filter("id % 17 <> 3 and id % 19 <> 4")
    records = gate.alert_records(gate.alert_gate(hits(b).withColumn("webhook_url", F.lit("https://hooks.example.org/x")), cap=0))
    tried = records.filter("status = 'pending'").filter(F.expr("unix_micros(ts) % 2000000 < 1000000"))
    outcomes = tried.select("event_id", "rule_id", "source", "channel", F.lit(True).alias("delivered"), F.lit(None).cast("string").alias("error"))
    sent = gate.record_deliveries(records, outcomes).filter("channel = 'webhook' or channel = 'suppressed'")
    return aggregates.ingest_counters(stored, ["transport"], dropped=aggregates.drop_reasons(raw, stored), alerts=sent)


@plan(
    "alert_gate_cooldown",
    _COOLDOWN
    + """select h.event_id, h.rule_id, case when f.t is null then 'cooldown' else 'fired' end as status
 from h left join fires f on f.rule_id = h.rule_id and f.source = h.source and f.t = h.t""",
)
def alert_gate_cooldown(b: Bridge):
    """The gate without a cap."""
    return gate.alert_gate(hits(b), cap=0).select("event_id", "rule_id", "status")


# hit after hit: the state is the last fires of the ten minutes that any rule waits, and the fires of the last minute
_GATE = """, o as (select event_id, rule_id, concat(source_type, ':', remote_ip) as source, epoch_us(ts) // 400 as t, cooldown * 1000000 as wait,
  row_number() over (order by epoch_us(ts) // 400, rule_name, event_id, rule_id) as n from hits),
 step as (select 0::bigint as n, ''::varchar as status, []::struct(own varchar, t bigint)[] as last, []::bigint[] as recent
  union all
  select n, verdict, case verdict when 'fired' then list_append(held, struct_pack(own := own, t := t)) else held end,
   case verdict when 'fired' then list_append(live, t) else live end
  from (select *, case when len(list_filter(held, lambda e: e.own = x.own and x.t - e.t < x.wait)) > 0 then 'cooldown'
    when len(live) >= 30 then 'rate_limit' else 'fired' end as verdict
   from (select o.n, o.t, o.wait, concat(o.rule_id, ' ', o.source) as own, list_filter(step.last, lambda e: o.t - e.t < 600000000) as held,
    list_filter(step.recent, lambda x: x >= o.t - 60000000) as live from step join o on o.n = step.n + 1) x) y)
 select o.event_id, o.rule_id, o.source, step.status from o join step using (n)"""


@plan("alert_gate_batch", _HITS.replace("with ", "with recursive ", 1) + _GATE)
def alert_gate_batch(b: Bridge):
    """The gate with the default cap, over hits moved together in time (one day in under four minutes) so that it binds."""
    dense = hits(b).withColumn("ts", F.expr("timestamp_micros(unix_micros(ts) div 400)"))
    return gate.alert_gate(dense, cap=30).select("event_id", "rule_id", "source", "status")


@plan(
    "record_alert_events",
    _COOLDOWN
    + """select h.event_id, h.rule_id, 'suppressed' as channel, 'suppressed' as status, 'cooldown' as error
 from h left join fires f on f.rule_id = h.rule_id and f.source = h.source and f.t = h.t where f.t is null
 union all select h.event_id, h.rule_id, c, 'pending', null from h join fires f on f.rule_id = h.rule_id and f.source = h.source and f.t = h.t
 join (values ('r1', 'webhook'), ('r2', 'webhook'), ('r2', 'email')) as ch(r, c) on ch.r = h.rule_id""",
)
def record_alert_events(b: Bridge):
    records = gate.alert_records(gate.alert_gate(hits(b), cap=0))
    return records.select("event_id", "rule_id", "channel", "status", "error")


@plan(
    "received_alert_records",
    """select concat('r', event_id % 5) as rule_id, 'files' as origin, event_type as line, 'sent' as status,
 epoch_us(ts) // 1000000 as ts_s from events""",
)
def received_alert_records(b: Bridge):
    """Alert records sent by others, normalised into the same table."""
    seconds = F.expr("unix_micros(ts) div 1000000")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string")).alias("rule_id"), F.col("event_type").alias("line"), seconds.alias("ts")
        )
    )
    out = gate.received_alert_records(b.table("events").select(body.alias("body")))
    return out.select("rule_id", "origin", "line", "status", F.expr("unix_micros(ts) div 1000000").alias("ts_s"))


@plan(
    "scheduled_reports",
    B4
    + """select id, concat('Scheduled analysis: /var/log/app', id % 100, '.log', chr(10), 'Severity: ', severity, chr(10), 'Summary: ', summary, chr(10),
 'Anomalies: ', json_array_length(anomalies_json), chr(10), 'View full report: https://logs.example.org/analysis/', id,
 case id % 4 when 1 then concat(chr(10), '  - a: d') when 2 then concat(chr(10), '  - a: d', chr(10), '  - b: e') else '' end) as report from b4""",
)
def scheduled_reports(b: Bridge):
    path = F.concat(F.lit("/var/log/app"), (F.col("id") % 100).cast("string"), F.lit(".log"))
    results = typed_anomalies(b.analyses).withColumn("file_path", path).withColumn("job_id", F.col("id"))
    return sinks.report_text(results, base_url="https://logs.example.org/").select("id", "report")


@plan("scan_archive_analyses", B4 + "select id, severity, summary, json_array_length(anomalies_json)::bigint as anomalies from b4 where created_at > timestamp '1996-06-01' and error is null order by created_at desc, id desc limit 50")
def scan_archive_analyses(b: Bridge):
    out = archive_analyses(b.analyses, since=at("1996-06-01"))
    return out.select("id", "severity", "summary", big(F.size("anomalies")).alias("anomalies"))


@plan("file_inventory", with_views("b10") + """select path, split_part(path, '/', -1) as name, size_bytes, cast(path like '%.gz' as int) as compressed,
 case when not path like '/var/log/%/%' or path like '/var/log/nginx/%' then 'localhost' else split_part(path, '/', 4) end as group_label from b10""")
def file_inventory(b: Bridge):
    from logquarry.sources.files import describe_files

    out = describe_files(b.files, "/var/log")
    return out.select("path", "name", "size_bytes", F.col("compressed").cast("int").alias("compressed"), "group_label")


@plan("group_sizes", with_views("b10") + """select case when not path like '/var/log/%/%' or path like '/var/log/nginx/%' then 'localhost'
 else split_part(path, '/', 4) end as label, count(*) as files, sum(size_bytes)::bigint as bytes from b10 group by 1""")
def group_sizes(b: Bridge):
    return aggregates.group_sizes(b.files, "/var/log")
