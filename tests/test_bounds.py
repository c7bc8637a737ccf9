"""Values beyond earlier bounds, user patterns, and rows that used to be lost."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from logquarry.functions.text import jvm_pattern, regex_search
from logquarry.functions.times import pattern_timestamp
from logquarry.operators import analysis, joins, parse, ranking, rules, search
from logquarry.sources import files, sinks
from logquarry.streaming import jobs


@pytest.mark.parametrize("depth", [1, 4, 5, 6, 12, 30])
@pytest.mark.parametrize("frame", ["%s", "Here it is: %s done.", "```json\n%s\n```", '{"severity": "low"} then %s'])
def test_replies_nest_to_any_depth(spark, depth, frame):
    inner = '{"severity": "low"}'
    for _ in range(depth):
        inner = '{"x": %s, "text": "a } brace"}' % inner
    reply = '{"severity": "high", "summary": "s", "x": %s}' % inner
    row = analysis.clean_replies(spark.createDataFrame([(1, frame % reply)], "id int, raw_response string")).first()
    assert (row["severity"], row["summary"]) == ("high", "s")


def test_an_open_brace_hides_nothing():
    assert analysis.embedded_object('set {a, then {"b": {"c": 1}} end') == '{"b": {"c": 1}}'
    assert analysis.embedded_object("no object {here}") is None


def test_quotes_in_the_prose_hide_nothing(spark):
    texts = {
        '5" wide. Draft: {"severity":"low"} Final: {"severity":"high"}': '{"severity":"high"}',
        'it\'s "fine {"severity":"low", "summary":"a \\" } b"} 6"': '{"severity":"low", "summary":"a \\" } b"}',
        '{"severity":"high"} and then 3" more': '{"severity":"high"}',
        'a " b {"x": {"y": "}"}} c " d': '{"x": {"y": "}"}}',
        'open { never " closed': None,
        '"{" * 3 {"a": "unterminated}': None,
    }
    assert {t: analysis.embedded_object(t) for t in texts} == texts
    assert analysis.balanced_objects("{" * 50_000 + '"' * 50_001) == []
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, raw_response string")
    assert [r["severity"] for r in analysis.clean_replies(frame).orderBy("id").collect()[:3]] == ["high", "low", "high"]


@pytest.mark.parametrize("pattern,hits", [(r"(?P<n>a+)b(?P=n)", ["aba"]), (r"(?P<x>zz", []), ("[", []), (r"a(?#c)b|(?<=x", [])])
def test_patterns_never_stop_a_job(spark, pattern, hits):
    df = spark.createDataFrame([("aba",), ("abb",)], "line string")
    assert [r[0] for r in df.filter(regex_search(F.col("line"), pattern)).collect()] == hits


def test_a_pattern_only_python_knows_matches_nothing(spark):
    assert jvm_pattern(r"(a)?(?(1)b|c)") is None


def test_invalid_timestamp_patterns_give_no_time(spark):
    df = spark.createDataFrame([("2024-01-02 x",)], "line string")
    assert df.select(pattern_timestamp(F.col("line"), r"(?P<event_date>")).first()[0] is None
    assert df.select(pattern_timestamp(F.col("line"), r"(?P<event_date>\d+-\d+-\d+)")).first()[0] is not None


def _events(spark, n, **extra):
    base = spark.range(n).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("received_at"))
    columns = {"source_type": "palo_alto", "log_type": "TRAFFIC", "action": "allow", "message": "ok", "remote_ip": "192.0.2.1"} | extra
    return base.withColumns({k: v if not isinstance(v, str) else F.lit(v) for k, v in columns.items()})


def test_views_filter_before_they_cut(spark):
    events = _events(spark, 900, action=F.when(F.col("id") < 50, "deny").otherwise("allow"), log_type="TRAFFIC")
    assert search.firewall_view(events, action="DENY").count() == 50
    assert ranking.live_feed(events, floor="error").count() == 50


def test_asked_limits_are_kept(spark):
    analyses = spark.range(700).selectExpr("id", "timestamp_seconds(id) created_at", "'m' model")
    assert ranking.window_analyses(analyses, F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(9_999)), 650).count() == 650
    jobs_ = spark.range(90).selectExpr("id", "'done' status", "timestamp_seconds(id) finished_at", "timestamp_seconds(id) created_at")
    assert ranking.keep_newest_jobs(jobs_, 80).count() == 80
    lines = spark.range(12_000).selectExpr("timestamp_seconds(id) sort_ts", "'s' source", "id line_index", "'x' line")
    assert sinks.export_rows(lines).count() == 12_000


def test_ranges_without_a_place_tell_nothing_on_either_path(spark):
    rows = spark.createDataFrame([("8.8.8.8",), ("8.8.9.9",), (None,)], "ip string")
    base = (8 << 24) + (8 << 16)
    ranges = spark.createDataFrame(
        [(base + (8 << 8), base + (8 << 8) + 255, None, 1.0, "AA"), (base + (9 << 8), base + (9 << 8) + 255, 2.0, 3.0, None)],
        "ip_lo long, ip_hi long, lat double, lon double, country string",
    )
    found = [sorted(map(str, joins.geo_enrich(rows, ranges, addresses={"ip": "s_"}, broadcast_ranges=b).collect())) for b in (True, False)]
    assert found[0] == found[1]
    assert "AA" not in str(found)
    labels = spark.createDataFrame([(base, base + 65_535, None)], "ip_lo long, ip_hi long, asn string")
    found = [sorted(map(str, joins.geo_enrich(rows, labels, addresses={"ip": "s_"}, values=["asn"], broadcast_ranges=b).collect())) for b in (True, False)]
    assert found[0] == found[1]


def test_rules_look_at_raw_when_the_message_is_empty_and_scan_once(spark):
    events = _events(spark, 2, message=F.when(F.col("id") == 0, "").otherwise("fine"), raw="raw failure")
    many = [Row(id=str(i), name=str(i), query="failure", mode="text", source_type=None, cooldown_sec=1) for i in range(450)]
    hits = rules.match_alert_rules(events, many)
    assert hits.count() == 450
    assert hits._jdf.queryExecution().executedPlan().toString().count("Generate ") == 1


def test_a_change_wins_over_a_newer_row(spark):
    old = spark.createDataFrame([("a", 5, "old"), ("b", 5, "old")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 5, "new"), ("b", 1, "new"), ("c", 1, "new")], "k string, v int, x string")
    assert {r["k"]: r["x"] for r in rules.upsert_by_key(old, new, "k", "v").collect()} == {"a": "new", "b": "new", "c": "new"}


def test_cloud_keys_keep_the_value_and_write_nested_blanks(spark):
    import hashlib

    bodies = ['{"id": " a "}', '{"b": {"d": [1, 2], "c": "x, y: z"}, "a": 1}']
    keys = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "body string").select(parse.cloud_key(F.col("body"))).collect()]
    text = '{"a": 1, "b": {"c": "x, y: z", "d": [1, 2]}}'
    assert keys == ["mist: a ", "mist:hash:" + hashlib.sha256(text.encode()).hexdigest()[:32]]


def test_event_ids_of_wide_batches_never_meet(spark):
    ids = [spark.range(0, 4200, numPartitions=2100).select(jobs.event_id(batch).alias("id")) for batch in (0, 1)]
    both = ids[0].unionByName(ids[1])
    assert both.distinct().count() == 8400
    assert ids[0].agg(F.max("id")).first()[0] < ids[1].agg(F.min("id")).first()[0]


def test_tails_drop_blocks_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(files.running_sum, "__kwdefaults__", {**files.running_sum.__kwdefaults__, "block_bits": 6})
    lines = spark.range(4000).selectExpr("'s' source", "id line_index", "concat('line ', id) line")
    tail = files.tail_bytes(lines, 300)
    tail.collect()
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    window = plan[plan.index("Window") :]
    assert window.index("Exchange hashpartitioning") < window.index("BroadcastHashJoin")  # the join stands below the exchange
    assert [r["line_index"] for r in tail.orderBy("line_index").collect()] == list(range(4000 - tail.count(), 4000))


def test_the_nth_smallest_of_sparse_ids(spark):
    ids = spark.range(3000).selectExpr("id * 777777 as id")
    assert [ranking.nth_smallest(ids, "id", n) for n in (1, 1500, 3000, 9999)] == [0, 1499 * 777777, 2999 * 777777, 2999 * 777777]
    assert ranking.nth_smallest(ids.limit(0), "id", 5) is None


def test_windows_are_whole_and_cuts_are_told(spark):
    lines = spark.range(2000).selectExpr("'s' source", "id line_index", "concat('line ', id) line", "timestamp_seconds(id) ts")
    assert files.tail_since(lines, F.timestamp_seconds(F.lit(500))).count() == 1500
    cut = files.tail_since(lines, F.timestamp_seconds(F.lit(500)), 200)
    assert 0 < cut.count() < 30 and cut.filter("not window_cut").isEmpty()


def test_nothing_is_cut_unless_a_limit_is_named(spark):
    from logquarry.operators import aggregates
    from logquarry.sources import tables

    n = 6_000
    events = _events(spark, n, message=F.lit("failure here"), source_type=F.lit("mist"))
    assert search.term_search(events, "failure").count() == n == search.event_regex_search(events, "fail").count()
    assert search.phrase_search(events, "failure here").count() == n == search.list_events(events).count()
    assert search.unified_search("failure", events=events).count() == n == joins.newest_cloud_ids(events).count()
    assert search.list_events(events, offset=10, limit=50).count() == 50 and search.list_events(events, offset=10).count() == n - 10
    assert tables.scan_archive_logs(spark.range(n).selectExpr("id", "now() received_at", "'' remote_ip", "'' transport", "'m' message"), since_id=-1).count() == n
    flows = spark.range(n).selectExpr("cast(id as string) src_ip", "'b' dst_ip", "now() ts", "now() received_at", "1L bytes", "1d src_lat", "1d src_lon", "1d dst_lat", "1d dst_lon")
    live, archive = aggregates.flow_aggregates(flows), aggregates.archive_flow_aggregates(flows.withColumn("dst_ip", F.lit("c")))
    assert live.count() == n == archive.count() and joins.merge_archive_flows(live, archive).count() == 2 * n
    assert joins.merge_archive_flows(live, archive, limit=7).count() == 7


def test_a_search_report(spark):
    from logquarry.operators import parse

    events = _events(spark, 5, message=F.lit("disk failure"), source_type=F.lit("mist"))
    lines = spark.createDataFrame([("/a.log", 0, "disk failure [x"), ("/a.log", 1, "fine")], "source string, line_index long, line string")
    lines = parse.parse_line_timestamps(lines.withColumn("received_at", F.timestamp_seconds(F.lit(1_700_000_000))))
    results, about = search.search_report("disk failure", events=events, lines=lines, limit=4)
    row = about.first()
    assert results.count() == 3 == row["count"] and row["counts_by_origin"] == {"hub": 2, "files": 1}
    assert row["highlight_terms"] == ["disk", "failure"] and row["errors"] == {}
    results, about = search.search_report("[x", mode="regex", events=events, lines=lines)
    row = about.first()
    assert row["errors"] == {"files": "invalid pattern: [x"} and row["highlight_terms"] == [] and row["counts_by_origin"] == {"hub": 0}


def test_a_path_is_decoded_once_and_lines_stay_where_they_are(spark, tmp_path):
    from logquarry.sources import files

    (tmp_path / "a b+c.log").write_text("one\ntwo\n")
    (tmp_path / "x.log").write_bytes(b"\0\1\n\0")
    (tmp_path / "y.log.bz2").write_text("no\n")
    lines = files.scan_log_lines(spark, [str(tmp_path)])
    out = files.drop_binary_files(lines, files.file_inventory(spark, [str(tmp_path)])).select("source", "line")
    assert sorted(map(tuple, out.collect())) == [(f"{tmp_path}/a b+c.log", "one"), (f"{tmp_path}/a b+c.log", "two")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("urlcodec") == 1 and "strategy=broadcast" in plan
