"""Parsers on hand-made messages, with the edge cases that are easy to get wrong."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logquarry.functions import severity
from logquarry.functions.net import ipv4_to_long, is_public
from logquarry.functions.syslog import csv_fields, regex_map, syslog_columns
from logquarry.functions.text import SearchSyntaxError, boolean_search, glob_matches, highlight_terms, query_predicate
from logquarry.functions.times import line_timestamp, next_run, window_seconds
from logquarry.operators import parse, rules

UTC = timezone.utc
ARRIVED = datetime(2026, 4, 12, 10, 0, 0)


def raw_frame(spark, *messages):
    rows = [(i, ARRIVED, "10.0.0.9", "udp", m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "id long, received_at timestamp, remote_ip string, transport string, raw string")


def one(spark, value, expression):
    """An expression of ``x`` over one text."""
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("v")).first()["v"]


def firewall_body(**fields):
    parts = ["f%d" % i for i in range(60)]
    parts[3] = "TRAFFIC"
    for index, value in fields.items():
        parts[int(index[1:])] = value
    return ",".join(parts)


def test_firewall_with_default_map(spark):
    body = firewall_body(_5="2305", _8="192.168.7.7", _9="203.0.113.77", _26="tcp", _27="deny", _28="443", _29="443", _30="0")
    row = parse.classify_events(raw_frame(spark, f"<14>1 2026-04-12T10:15:01Z fw - - - - {body}")).first()
    assert (row["source_type"], row["log_type"], row["action"]) == ("palo_alto", "TRAFFIC", "deny")
    assert (row["src_ip"], row["dst_ip"]) == ("192.168.7.7", "203.0.113.77")
    assert (row["proto"], row["src_port"], row["dst_port"]) == ("443", 443, 0)
    assert (row["facility"], row["severity"]) == (1, 6)
    assert row["event_ts"] == ARRIVED  # field 5 is no date


def test_firewall_heuristics(spark):
    no_map = firewall_body(_8="name", _20="10.1.1.1", _21="10.2.2.2", _13="Drop")
    lonely = firewall_body(_8="name", _20="10.1.1.1")
    short = ",".join(["x"] * 3 + ["TRAFFIC"] + ["y"] * 5)
    dated = firewall_body(_5="2026/04/12 10:15:01.250", _8="10.1.1.1", _9="10.2.2.2", _59="tcp")
    messages = [f"<14>1 t fw - - - - {b}" for b in (no_map, lonely, short, dated)]
    rows = {r["id"]: r for r in parse.classify_events(raw_frame(spark, *messages)).collect()}
    assert (rows[0]["src_ip"], rows[0]["dst_ip"], rows[0]["action"]) == ("10.1.1.1", "10.2.2.2", "drop")
    assert (rows[1]["src_ip"], rows[1]["dst_ip"]) == ("10.1.1.1", None)
    assert rows[2]["source_type"] == "windows" and rows[2]["log_type"] is None
    assert rows[3]["event_ts"] == datetime(2026, 4, 12, 10, 15, 1, 250000)
    assert rows[3]["action"] == "f13"  # a protocol in the last field has no successor


def test_generic_message(spark):
    row = parse.classify_events(
        raw_frame(spark, "<134>Jan  1 00:00:00 host sshd[9]: Failed password from 203.0.113.8 and 203.0.113.8 via fe80:1:2::9 port 22")
    ).first()
    assert row["source_type"] == "generic" and row["src_ip"] == "203.0.113.8"
    assert row["message"].startswith("00:00:00 host sshd[9]")
    assert row["dst_ip"] == "00:00:00"  # the loose IPv6 shape also takes clock times
    assert (row["facility"], row["severity"]) == (16, 6)


def test_registry_order_and_custom_type(spark):
    registry = (
        parse.SourceRule("off", "off", ("MARK",), enabled=False),
        parse.SourceRule("custom", "custom_type", ("Special_Mark",)),
        parse.SourceRule("windows", "windows"),
    )
    df = raw_frame(spark, "<13>Jan 1 a b special_mark here", "<13>1 t host app - - - x", "<13>Jan 1 a b MARK")
    found = [r["registry_type"] for r in parse.classify_by_registry(df, registry).orderBy("id").collect()]
    assert found == ["custom_type", "windows", None]
    # a custom hint does not survive the generic parser
    assert parse.classify_events(df, registry=registry).filter("id = 0").first()["source_type"] == "generic"


def test_raw_is_truncated_and_pri_read_after_blanks(spark):
    df = raw_frame(spark, "  <165>1 x y z " + "a" * 5000)
    row = parse.parse_syslog_header(df, raw_limit=100).first()
    assert len(row["raw"]) == 100 and (row["facility"], row["severity"]) == (20, 5)


@pytest.mark.parametrize(
    "text, fields",
    [
        ("a,b,,d", ["a", "b", "", "d"]),
        (",x", ["", "x"]),
        ('"rule, a",b', ["rule, a", "b"]),
        ('"say ""hi""",b,"c"', ['say "hi"', "b", "c"]),
        ('"x"y,z', ["xy", "z"]),
        ('"open, end', ["open, end"]),
        ("", [""]),
    ],
)
def test_csv_fields(spark, text, fields):
    assert one(spark, text, csv_fields(F.col("x"))) == fields


def test_cloud_events(spark):
    bodies = [
        '{"id":"e1","type":"AP_DOWN","message":"down","timestamp":1700000000,"site_name":"hq"}',
        '{"id":" ","event_id":7,"event":"x","ts":1700000000000}',
        '{"b":1,"a":"z"}',
        '{"text":"only body","severity":"major"}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "seq long, body string")
    rows = parse.normalize_cloud_events(df).orderBy("seq").collect()
    when = datetime(2023, 11, 14, 22, 13, 20)
    assert (rows[0]["message"], rows[0]["parser"], rows[0]["event_ts"], rows[0]["syslog_host"]) == ("AP_DOWN: down", "mist:e1", when, "hq")
    assert (rows[1]["message"], rows[1]["parser"], rows[1]["event_ts"]) == ("x", "mist:7", when)
    import hashlib

    assert rows[2]["parser"] == "mist:hash:" + hashlib.sha256(b'{"a": "z", "b": 1}').hexdigest()[:32]
    assert (rows[3]["message"], rows[3]["action"], rows[3]["log_type"]) == ("only body", "major", "")


@pytest.mark.parametrize(
    "line, expected",
    [
        ("<11>1 info", "error"),
        ("<14>error words do not matter", "info"),
        ('{"level": "WARN", "m": "error"}', "warning"),
        ("x ERR y", "error"),
        ("operation timeout", "error"),
        ("emergency stop", "emergency"),
        ("all fine", "unknown"),
        ("   ", "unknown"),
        ("terror is no level", "unknown"),
    ],
)
def test_classify_severity(spark, line, expected):
    assert one(spark, line, severity.classify_severity(F.col("x"))) == expected


def test_the_other_judgements(spark):
    failure, low = (lambda s: one(spark, s, severity.is_failure(F.col("x")))), (lambda s: one(spark, s, severity.is_low_level(F.col("x"))))
    assert failure("<11>ok") and failure("<14>kernel panic") and not failure("<14>ok") and not failure(" ")
    assert low("") and low("<15>x") and low("[INFO] x") and low("a: debug - b") and not low("<11>error")


@pytest.mark.parametrize(
    "query, hits",
    [
        ("alpha", ["alpha beta", "ALPHA gamma"]),
        ("alpha beta", ["alpha beta"]),
        ("alpha OR delta", ["alpha beta", "ALPHA gamma", "delta's end"]),
        ("alpha AND NOT beta", ["ALPHA gamma"]),
        ("NOT alpha", ["delta's end"]),
        ("(alpha OR delta) NOT beta", ["ALPHA gamma", "delta's end"]),
        ('"alpha beta" or "delta\'s"', ["alpha beta", "delta's end"]),
        ("not not alpha", ["alpha beta", "ALPHA gamma"]),
        ("gamma or beta alpha", ["alpha beta", "ALPHA gamma"]),
    ],
)
def test_boolean_search(spark, query, hits):
    df = spark.createDataFrame([("alpha beta",), ("ALPHA gamma",), ("delta's end",)], "line string")
    assert sorted(r["line"] for r in df.filter(boolean_search("line", query)).collect()) == sorted(hits)


@pytest.mark.parametrize("query", ["", "a OR", "AND a", "(a", "a)", '"open', "()", "NOT", "a OR OR b"])
def test_malformed_search(query):
    with pytest.raises(SearchSyntaxError):
        boolean_search("line", query)


def test_highlight_terms_and_fallback(spark):
    assert highlight_terms('Err "big disk" NOT err x') == ["Err", "big disk", "x"]
    assert one(spark, "a OR", query_predicate("x", "a OR", "text")) is True  # falls back to all words
    assert one(spark, "abc", query_predicate("x", "([", "regex")) is False


def test_globs(spark):
    test = lambda name, glob: one(spark, name, glob_matches(F.col("x"), glob))
    assert test("app1.log", "app?.log") and test("b.txt", "a*, *.txt") and not test("app12.log", "app?.log")
    assert test("a1", "[ab]1") and not test("c1", "[!c]1") and test("x.log", None)


def test_line_timestamps(spark):
    at = lambda s: one(spark, s, line_timestamp(F.col("x"), 2025))
    assert at("2024-05-14T10:15:32.5Z rest") == datetime(2024, 5, 14, 10, 15, 32, 500000)
    assert at("2024-05-14 10:15:32+02:00 rest") == datetime(2024, 5, 14, 8, 15, 32)
    assert at("May  4 10:15:32 host") == datetime(2025, 5, 4, 10, 15, 32)
    assert at("Xyz 14 10:15:32 host") is None and at("Feb 30 10:15:32 host") is None and at("none") is None
    assert (window_seconds("15m"), window_seconds("7D"), window_seconds("all")) == (900, 604800, None)


def test_custom_timestamp_rules(spark):
    rule = {
        "id": "p", "type": "regex", "file_glob": "Pri.log,ComLink*.log", "priority": 15, "enabled": True,
        "config": {"pattern": r"\[(?P<event_date>\d{4}-\d{2}-\d{2})\](?: (?P<event_time>[\d:.]+))?", "time_default": "06:00:00"},
    }
    line = "x [2024-02-03] 11:12:13.999 y"
    sources = ["/a/Pri.log", "/a/ComLinkApp1.log", "/a/other.log", "/a/Pri.log"]
    lines = [line, line, line, "z [2024-02-03]"]
    df = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(zip(sources, lines, strict=True))], "i int, source string, line string")
    got = [r["ts"] for r in rules.parse_custom_timestamps(df, [rule]).orderBy("i").collect()]
    exact = datetime(2024, 2, 3, 11, 12, 13)
    assert got == [exact, exact, None, datetime(2024, 2, 3, 6, 0, 0)]
    bracketed = {"id": "b", "type": "bracketed", "enabled": True, "config": {}}
    df = spark.createDataFrame([("/s", "[sms.2024-02-03] - 11:12:13.5 [x"), ("/s", "[sms.2024-02-03] no time")], "source string, line string")
    got = [r["ts"] for r in rules.parse_custom_timestamps(df, [bracketed]).collect()]
    assert got == [exact, datetime(2024, 2, 3)]


def test_columnizers(spark):
    iso = one(spark, "2024-01-02T03:04:05Z web nginx[77]: GET /x", syslog_columns(F.col("x")))
    assert tuple(iso) == ("2024-01-02T03:04:05Z", "web", "nginx", "77", "GET /x")
    bsd = one(spark, "Jan  2 03:04:05 web cron: run", syslog_columns(F.col("x")))
    assert tuple(bsd) == ("Jan 2 03:04:05", "web", "cron", "", "run")
    assert tuple(one(spark, "free text", syslog_columns(F.col("x")))) == ("", "", "", "", "free text")
    assert one(spark, "k=v", regex_map(F.col("x"), r"(\w)=")) == {"match": "k="}
    assert one(spark, "k=v", regex_map(F.col("x"), "([")) == {"line": "k=v"}


def test_addresses(spark):
    number = lambda ip: one(spark, ip, ipv4_to_long(F.col("x")))
    assert number("203.0.114.1") == 3405804033 and number("1.2.3") is None and number("1.2.3.999") is None and number("a.b.c.d") is None
    public = lambda ip: one(spark, ip, is_public(ipv4_to_long(F.col("x"))))
    assert public("8.8.8.8") and public("192.0.0.9")
    for ip in ("10.0.0.1", "127.0.0.1", "169.254.1.1", "172.20.0.1", "192.0.2.5", "198.19.0.1", "203.0.113.5", "224.0.0.1", "255.255.255.255", "x"):
        assert not public(ip)


def test_next_run(spark):
    def run(after, days, hour):
        df = spark.createDataFrame([(after, days, hour)], "a timestamp, d int, h int")
        return df.select(next_run(F.col("a"), F.col("d"), F.col("h"))).first()[0]

    assert run(datetime(2024, 1, 31, 5, 6, 7), 1, 2) == datetime(2024, 2, 1, 2)
    assert run(datetime(2024, 1, 31, 5, 6, 7), 0, 99) == datetime(2024, 2, 1, 23)
