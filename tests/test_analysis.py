"""Reply cleaning, chunking, budgets and lookups on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logquarry.operators import analysis, joins
from logquarry.sources import files, sinks, tables
from logquarry.functions import fixed


def cleaned(spark, reply, clean=analysis.clean_replies):
    return clean(spark.createDataFrame([(reply,)], "raw_response string")).first()


@pytest.mark.parametrize(
    "reply, severity, summary",
    [
        ('{"severity":"HIGH","summary":" s "}', "high", "s"),
        ('```json\n{"severity":"low","summary":"a"}\n```', "low", "a"),
        ('draft {"severity":"low","summary":"a"} final {"severity":"critical","summary":"b {x}"}', "critical", "b {x}"),
        ('{"severity":"weird"}', "low", "(no summary)"),
        ("{}", "info", "(no summary)"),
        ("nothing", "low", fixed.NON_JSON_SUMMARY),
        ("[1,2]", "low", fixed.NON_JSON_SUMMARY),
        (None, "low", fixed.NON_JSON_SUMMARY),
    ],
)
def test_clean_replies(spark, reply, severity, summary):
    row = cleaned(spark, reply)
    assert (row["severity"], row["summary"], row["anomalies"]) == (severity, summary, [])


def test_anomalies_are_capped_and_typed(spark):
    items = ",".join(
        ['{"title":"%s","detail":"%s","related_log_indexes":[1,"2",2.7,true,"x"]}' % ("t" * 99, "d" * 200), "5", '{"title":" "}', "{}", '{"title":"five"}']
    )
    row = cleaned(spark, '{"severity":"low","summary":"s","anomalies":[%s]}' % items)
    assert [a["title"] for a in row["anomalies"]] == ["t" * 56, "Note", "Note"]
    assert len(row["anomalies"][0]["detail"]) == 130 and row["anomalies"][0]["related_log_indexes"] == [1, 2, 2]
    assert cleaned(spark, '{"anomalies":"no list"}')["anomalies"] == []


def test_explanations_and_summaries(spark):
    row = cleaned(spark, '{"summary":"s","actions":["a",""," b "]}', analysis.clean_explanations)
    assert (row["severity"], row["explanation"], row["actions"]) == ("info", "s", ["a", "b"])
    row = cleaned(spark, '{"headline":"h","confidence":"High","anomalies":[{"title":"","detail":"d"}]}', analysis.clean_summaries)
    assert (row["headline"], row["summary"], row["confidence"]) == ("h", "(no summary)", "high")
    assert [tuple(f) for f in row["findings"]] == [("Finding", "d")]


def numbered(spark, texts, source="/s"):
    return spark.createDataFrame([(source, i, t) for i, t in enumerate(texts)], "source string, line_index long, line string")


def loop_chunks(lines, size, overlap, limit):
    step, out, i = max(1, size - max(0, min(overlap, size - 1))), {}, 0
    while i < len(lines):
        block = [x if len(x) <= limit else x[: limit - 1] + "…" for x in lines[i : i + size]]
        block = [x for x in block if x.strip()]
        if block:
            out[i] = "\n".join(block)
        i += step
    return out


@pytest.mark.parametrize("size, overlap", [(4, 1), (5, 4), (3, 9), (4, 0)])
def test_chunks_equal_loop(spark, size, overlap):
    lines = [("" if i % 7 == 3 else f"line {i} " + "x" * (i % 20)) for i in range(41)] + [""] * 9
    out = analysis.chunk_lines(numbered(spark, lines), size=size, overlap=overlap, line_limit=15).collect()
    assert {r["start_line"]: r["text"] for r in out} == loop_chunks(lines, size, overlap, 15)


def test_newest_chunk_options(spark):
    lines = [f"l{i}" for i in range(20)]
    out = analysis.chunk_lines(numbered(spark, lines), size=4, overlap=1, newest_lines=10, newest_chunks=2).collect()
    want = dict(sorted(loop_chunks(lines[-10:], 4, 1, 99).items())[-2:])
    assert {r["start_line"]: r["text"] for r in out} == want


def test_tail_budget_keeps_one_line(spark):
    df = numbered(spark, ["aaa", "bb", "c" * 50])
    assert [r["line_index"] for r in analysis.tail_budget(df, 10).collect()] == [2]
    assert sorted(r["line_index"] for r in analysis.tail_budget(df, 54).collect()) == [1, 2]


def test_tail_bytes_cut_on_a_line_start(spark):
    df = numbered(spark, ["aaaa", "bbbb", "cccc"])  # 15 bytes
    tail = lambda n, d=df: sorted(r["line_index"] for r in files.tail_bytes(d, n).collect())
    assert tail(15) == [0, 1, 2] and tail(10) == [2] and tail(11) == [1, 2] and tail(3) == []
    packed = numbered(spark, ["aaaa", "", "cccc"], "/s.gz")
    assert tail(10, packed) == [0, 2] and tail(5, packed) == [2]


def test_pages(spark):
    df = numbered(spark, [f"l{i}" for i in range(10)])
    page = files.page_lines(df, "/s", direction="newer", line=6, limit=9).collect()
    assert [r["line_index"] for r in page] == [7, 8, 9] and page[0]["has_older"] and not page[0]["has_newer"]
    page = files.page_lines(df, "/s", direction="tail", limit=3).collect()
    assert [r["line_index"] for r in page] == [7, 8, 9]


def test_binary_heads():
    assert files.looks_binary(b"a\x00b") and files.looks_binary(b"\xff" * 20) and not files.looks_binary(b"text\n") and not files.looks_binary(b"")
    assert files.looks_binary_lenient(b"\x01" * 2 + b"a" * 8) and not files.looks_binary_lenient(b"\xff\xfea\x00")


def test_scan_real_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a+b %.log").write_text("one\n\nthree\n")
    (tmp_path / "sub" / "c.log").write_text("four\n")
    (tmp_path / "wtmp").write_text("skip\n")
    (tmp_path / "d.log").write_bytes(b"bin\x00ary\n")
    import gzip

    (tmp_path / "e.log.gz").write_bytes(gzip.compress(b"five\n"))
    scanned = files.scan_log_lines(spark, [str(tmp_path)], glob="*.log")
    inventory = files.file_inventory(spark, [str(tmp_path)])
    lines = files.number_lines(files.drop_binary_files(scanned, inventory)).filter("line <> ''")
    got = sorted((r["source"].rsplit("/", 1)[1], r["line_index"], r["line"]) for r in lines.collect())
    assert got == [("a+b %.log", 0, "one"), ("a+b %.log", 2, "three"), ("c.log", 0, "four")]
    packed = files.scan_log_lines(spark, [str(tmp_path)], glob="*.gz", read_compressed=True)
    assert [r["line"] for r in packed.collect()] == ["five"]
    flat = files.scan_log_lines(spark, [str(tmp_path)], glob="*.log", recursive=False)
    assert "four" not in [r["line"] for r in flat.collect()]


def test_many_splits_are_numbered(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(5000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = files.number_lines(files.scan_log_lines(spark, [str(tmp_path)])).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted((r["line_index"], r["line"]) for r in out) == sorted((i, f"line {i}") for i in range(5000))


def test_journal_and_cloud_pages(spark):
    assert tables.journal_scope("journal://unit/ssh.service") == ("unit", "ssh.service")
    for bad in ("journal://x", "/var/log"):
        with pytest.raises(ValueError):
            tables.journal_scope(bad)
    pages = ['[{"a":1},5]', '{"data":[{"b":2}],"n":1}', '{"c":3}', '{"items":7,"d":4}', '"x"']
    out = tables.scan_cloud_events(spark.createDataFrame([(p,) for p in pages], "page string"))
    assert sorted(r["body"] for r in out.collect()) == ['{"a":1}', '{"b":2}', '{"c":3}', '{"items":7,"d":4}']


def test_related_events_by_mac_and_by_time(spark):
    t = datetime(2024, 1, 1, 12)
    rows = [
        (1, t, "mist", "cloud", None, None, "client AA:bb:cc:dd:ee:01 down"),
        (2, t, "mist", "other", None, None, "seen aa:bb:cc:dd:ee:01"),
        (3, t, "mist", "third", None, None, "nothing"),
        (4, datetime(2024, 1, 1, 12, 30), "mist", "", None, None, "quiet"),
        (5, t, "generic", "", None, None, "quiet too"),
    ]
    events = spark.createDataFrame(rows, "id long, received_at timestamp, source_type string, remote_ip string, src_ip string, dst_ip string, message string")
    assert [r["id"] for r in joins.related_events(events, 1).collect()] == [2]
    assert sorted(r["id"] for r in joins.related_events(events, 4).collect()) == [1, 2, 3, 4]
    assert joins.related_events(events, 99).count() == 0


def test_both_geo_paths_agree(spark):
    ranges = spark.createDataFrame([(134744064, 134744319, 1.0, 2.0, "AA"), (134744320, 135000000, 3.0, 4.0, "BB")], "ip_lo long, ip_hi long, lat double, lon double, country string")
    rows = [("8.8.8.8", "10.0.0.1"), ("8.8.9.9", "8.9.1.1"), (None, "x")]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string")
    direct = joins.geo_enrich(df, ranges, broadcast_ranges=True)
    distinct = joins.geo_enrich(df, ranges, broadcast_ranges=False).select(direct.columns)
    assert sorted(map(str, direct.collect())) == sorted(map(str, distinct.collect()))
    assert {r["src_ip"]: r["src_country"] for r in direct.collect()} == {"8.8.8.8": "AA", "8.8.9.9": "BB", None: None}


def test_failed_model_calls_mark_their_row_only(spark):
    def model(prompts):
        if "bad" in prompts[0]:
            raise RuntimeError("no")
        return ["{}"]

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "batch long, prompt string")
    rows = {r["batch"]: r for r in analysis.run_model(df, model).collect()}
    assert (rows[1]["status"], rows[2]["status"], rows[2]["error"]) == ("ok", "failed", "no")


def test_received_alert_and_chat_hook(spark):
    urls = ["https://discord.com/api/webhooks/1", "https://evil.org/discord.com/api/webhooks/1", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(sinks.is_chat_hook(F.col("u"))).collect()] == [True, False, None]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_reach_the_embedder_in_small_batches(spark):
    """Texts are not copied into pandas, Arrow batches are small, and calls keep their size over the border of a part."""

    def embed(texts):
        assert len(texts) <= 24
        return [[float(len(t)), float(len(texts))] for t in texts]

    rows = [(i, "x" * (i % 7), i if i % 3 else None) for i in range(200)]
    out = analysis.embed_chunks(spark.createDataFrame(rows, "start_line long, text string, n long").coalesce(1), embed, batch=24)
    assert "MapInArrow" in plan_of(out) and "MapInPandas" not in plan_of(out)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
    found = sorted(out.collect())
    assert [tuple(r)[:3] for r in found] == rows
    assert [r["embedding"] for r in found] == [[float(i % 7), 24.0 if i < 192 else 8.0] for i in range(200)]


def test_prompts_reach_the_model_in_small_batches(spark):
    """What goes with a prompt stays in Arrow, arrays and times too; a failing call marks its own row in every part."""

    def model(prompts):
        if prompts[0].endswith("9"):
            raise RuntimeError(f"no {prompts[0]}")
        return [prompts[0].upper()]

    rows = [(i, [i, None] if i % 2 else None, f"p{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "batch long, log_ids array<long>, prompt string").coalesce(1)
    out = analysis.run_model(df, model, name="m")
    assert "MapInArrow" in plan_of(out) and "MapInPandas" not in plan_of(out)
    found = sorted(out.select("batch", "log_ids", "prompt", "model", "raw_response", "status", "error").collect())
    bad = {i for i in range(150) if i % 10 == 9}
    assert [tuple(r) for r in found] == [
        (i, ids, p, "m", None if i in bad else p.upper(), "failed" if i in bad else "ok", f"no {p}" if i in bad else None) for i, ids, p in rows
    ]
