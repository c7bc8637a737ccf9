"""Stream pieces that the registered queries do not show."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from check import rows as rows_of
from logquarry.bridge import Bridge
from logquarry.plans import load
from logquarry.streaming import feeds, jobs


def land(spark, path, rows):
    df = spark.createDataFrame(rows, feeds.FEED_SCHEMA)
    df.write.mode("append").parquet(path)


def test_framing_bad_bytes_and_counters(spark, tmp_path):
    t = datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    land(spark, path, [(b"one\r\ntwo\n\n", "h1", "tcp", t), (b"bad \xff byte", "h2", "udp", t), (b"x" * 3000, "h2", "udp", t), (b"", "h3", "udp", t)])
    seen = []
    stream = feeds.observe_ingest(feeds.stream_syslog_feed(spark, path), ["tcp", "udp"])
    query = jobs.run_available(stream, lambda df, i: seen.extend(r["raw"] for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(seen) == ["bad � byte", "one", "two", "x" * 3000]
    counts = query.lastProgress["observedMetrics"]["ingest"]
    assert (counts["received"], counts["truncated"], counts["transport_tcp"], counts["transport_udp"]) == (4, 1, 2, 2)


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    jobs.put_batch(df, path, 0, ["k"])
    jobs.put_batch(df, path, 1, ["k"])
    jobs.put_batch(df.filter("id < 4"), path, 1, ["k"])
    assert spark.read.parquet(path).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 4)]


def test_dedup_across_batches(spark, tmp_path):
    handle = jobs.dedup_batch(str(tmp_path))
    frame = lambda rows: spark.createDataFrame(rows, "seq long, parser string")
    handle(frame([(1, "a"), (2, "a"), (3, "b")]), 0)
    handle(frame([(4, "b"), (5, "c"), (6, "c")]), 1)
    handle(frame([(4, "b"), (5, "c"), (6, "c")]), 1)  # replay
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/events").collect()) == [1, 3, 5]


def test_watermarked_dedup_and_live_feed(spark, tmp_path):
    t = datetime(2024, 1, 1)
    path = str(tmp_path / "in")
    spark.createDataFrame([("k1", t), ("k1", t), ("k2", t)], "parser string, event_ts timestamp").write.parquet(path)
    stream = feeds.watermarked_dedup(feeds.landed(spark, path, "parser string, event_ts timestamp"))
    out = jobs.write_available(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r["parser"] for r in out.collect()) == ["k1", "k2"]


def _hits(spark, rows):
    frame = spark.createDataFrame(rows, "event_id long, rule_id string, rule_name string, source string, cooldown_sec int, seconds long")
    return frame.withColumn("ts", F.timestamp_seconds("seconds")).drop("seconds")


def _stored(spark, path, *columns):
    return sorted(map(tuple, spark.read.parquet(str(path)).select(*columns).collect()))


def test_late_hits_land_apart_and_change_nothing(spark, tmp_path):
    handle = jobs.gate_stream_batch(str(tmp_path), cap=2)
    handle(_hits(spark, [(1, "r", "r", "s", 60, 100), (2, "r", "r", "s", 60, 130)]), 0)
    handle(_hits(spark, [(3, "r", "r", "s", 60, 90), (4, "r", "r", "s", 60, 165), (5, "q", "q", "s", 0, 129), (6, "q", "q", "t", 0, 130)]), 1)
    before = _stored(spark, tmp_path / "gated", "batch", "event_id", "status")
    assert before == [(0, 1, "fired"), (0, 2, "cooldown"), (1, 4, "fired"), (1, 6, "fired")]
    assert _stored(spark, tmp_path / "late", "batch", "event_id") == [(1, 3), (1, 5)]
    # a replay of the newest batch gives the same rows, a later batch goes on from there
    handle(_hits(spark, [(3, "r", "r", "s", 60, 90), (4, "r", "r", "s", 60, 165), (5, "q", "q", "s", 0, 129), (6, "q", "q", "t", 0, 130)]), 1)
    assert _stored(spark, tmp_path / "gated", "batch", "event_id", "status") == before
    handle(_hits(spark, [(7, "r", "r", "s", 60, 170), (8, "q", "q", "s", 0, 180), (9, "p", "p", "s", 0, 226)]), 2)
    assert _stored(spark, tmp_path / "gated", "event_id", "status")[4:] == [(7, "cooldown"), (8, "rate_limit"), (9, "fired")]
    handle(_hits(spark, []), 3)
    handle(_hits(spark, [(10, "r", "r", "s", 60, 224), (11, "r", "r", "s", 60, 226)]), 4)
    assert _stored(spark, tmp_path / "late", "event_id") == [(3,), (5,), (10,)]
    assert _stored(spark, tmp_path / "gated", "event_id", "status")[-1] == (11, "fired")
    assert {p.name for p in (tmp_path / "gate").iterdir() if p.is_dir()} <= {"batch=3", "batch=4"}  # the memory doesn't pile up


def test_old_fires_are_forgotten(spark, tmp_path):
    path = str(tmp_path)
    from datetime import timedelta

    jobs.gate_batch(_hits(spark, [(1, "r", "r", "s", 60, 100)]), 0, path, horizon=timedelta(hours=1))
    jobs.gate_batch(_hits(spark, [(2, "q", "q", "s", 60, 8000)]), 1, path, horizon=timedelta(hours=1))
    held = spark.read.parquet(f"{path}/gate").filter("batch = 1")
    assert sorted((r["rule_id"], r["t"]) for r in held.filter("rule_id is not null").collect()) == [("q", 8_000_000_000)]


def test_catalog_days_are_dropped(spark, tmp_path):
    days = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")], "id long, event_date string")
    name = f"swept_{tmp_path.name.replace('-', '_')}"
    days.write.option("path", str(tmp_path / "t")).partitionBy("event_date").saveAsTable(name)
    assert jobs.sweep_partitions(spark, name, "2024-01-03") == 2
    assert [r["id"] for r in spark.table(name).collect()] == [3]
    spark.sql(f"drop table {name}")


def test_event_ids_never_meet(spark):
    ids = spark.range(0, 100, 1, 7)
    both = [r[0] for k in (0, 1, 5) for r in ids.select(jobs.event_id(k)).collect()]
    assert len(set(both)) == 300 and min(both) >= 0


def _cloud(spark, keys, start=0):
    return spark.createDataFrame([(start + i, k) for i, k in enumerate(keys)], "seq long, parser string")


def test_dedup_reads_only_folders_that_may_hold_a_key(spark, tmp_path):
    read = {}
    handle = jobs.dedup_batch(str(tmp_path), on_read=lambda batch, folders: read.update({batch: folders}))
    for batch in range(6):
        handle(_cloud(spark, [f"b{batch}-{i}" for i in range(50)], 100 * batch), batch)
    handle(_cloud(spark, [f"b2-{i}" for i in range(10)] + ["new", "new", None, None], 900), 6)
    assert 2 in read[6] and len(read[6]) <= 2 and sum(map(len, read.values())) <= 5  # a filter errs in about 1 % of keys
    stored = [r["parser"] for r in spark.read.parquet(f"{tmp_path}/events").filter("batch = 6").collect()]
    assert sorted(stored, key=str) == [None, "new"]
    assert spark.read.parquet(f"{tmp_path}/events").filter("batch < 6").count() == 300


def test_old_key_folders_are_merged_and_forgotten(spark, tmp_path):
    read = []
    handle = jobs.dedup_batch(str(tmp_path / "all"), folders=4, on_read=lambda batch, folders: read.append(folders))
    for batch in range(9):
        handle(_cloud(spark, [f"k{batch * 3 + i}" for i in range(5)], 100 * batch), batch)  # two keys of each are the next one's
    stored = sorted(r["parser"] for r in spark.read.parquet(f"{tmp_path}/all/events").collect())
    assert stored == sorted(f"k{i}" for i in range(29))
    assert len(jobs._batches(spark, f"{tmp_path}/all/keys")) <= 5
    handle(_cloud(spark, [f"k{i}" for i in range(29)], 2000), 9)
    assert spark.read.parquet(f"{tmp_path}/all/events").count() == 29
    short = jobs.dedup_batch(str(tmp_path / "short"), horizon=2)
    for batch in range(5):
        short(_cloud(spark, ["same", f"own{batch}"], 10 * batch), batch)
    assert jobs._batches(spark, f"{tmp_path}/short/keys") == [2, 3, 4]


def test_filters_have_no_false_negatives(spark):
    from logquarry.operators import bloom

    keys = spark.range(3000).selectExpr("concat('k', id) k", "id % 3 part")
    parts = [bloom.filter_of(keys.filter(f"part = {p}"), "k", bloom.bits_for(1000 << p)).withColumn("folder", F.lit(p)) for p in range(3)]
    filters = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert all(p in bloom.folders_that_may_hold(keys.filter(f"id = {i}"), "k", filters, "folder") for i, p in ((0, 0), (1000, 1), (2999, 2)))
    strange = [bloom.folders_that_may_hold(spark.range(1).selectExpr(f"'z{i}' k"), "k", filters, "folder") for i in range(12)]
    assert sum(map(len, strange)) <= 3
    assert bloom.bits_for(1) == 1024 and bloom.bits_for(1000) == 16384 and bloom.folders_that_may_hold(keys, "k", filters.limit(0), "folder") == []


def test_observed_counts_become_a_table(spark, tmp_path):
    import time

    from logquarry.streaming import metrics

    t = datetime(2024, 1, 1)
    path, table = str(tmp_path / "in"), str(tmp_path / "counters")
    counters = metrics.Counters(spark)
    try:
        for batch in range(2):
            land(spark, path, [(b"one\ntwo", "h1", "tcp", t)] * (batch + 1) + [(b"x" * 3000, "h2", "udp", t)])
            stream = feeds.observe_ingest(feeds.stream_syslog_feed(spark, path), ["tcp", "udp"], name="counted")
            jobs.write_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
            for _ in range(100):  # progress is reported shortly after a batch
                if any(r[1] == batch for r in counters.rows):
                    break
                time.sleep(0.1)
            assert counters.store(table) >= 4 and counters.store(table) == 0
    finally:
        counters.close()
    again = spark.read.parquet(table).filter("batch = 1").withColumn("at", F.col("at") + F.expr("interval 1 second"))
    again.withColumn("value", F.col("value") + 100).write.mode("append").parquet(table)  # batch 1 counted again, later
    got = {r["counter"]: r["total"] for r in metrics.totals(spark, table).filter("observation = 'counted'").collect()}
    assert got == {"received": 3 + 105, "truncated": 1 + 101, "transport_tcp": 2 + 104, "transport_udp": 1 + 101}


@pytest.mark.parametrize("key, files, least", [("ingest_rate_with_alerts", 2, 300), ("ingest_rate_stream", 2, 300), ("stream_alert_gate", 10, 1)])
def test_files_of_a_delivery_make_no_row_late(spark, tmp_path, key, files, least):
    """Files that all span all times, which also start again with higher ids."""
    folder = tmp_path / "events.parquet"
    rows = spark.range(1200).selectExpr("id event_id", "timestamp_seconds(1704067200 + id % 800 * 60) ts", "id % 40 user_id", "'view' event_type", "1.5D value", "'' props")
    for rest in range(files):
        rows.filter(F.col("event_id") % files == rest).coalesce(1).write.mode("append").parquet(str(folder))
    con = duckdb.connect()
    con.sql(f"create view events as select * replace (ts::timestamp as ts) from '{folder}/*.parquet'")
    result = con.sql(load()[key].sql)
    want = rows_of(result.columns, result.fetchall())
    got = load()[key].run(Bridge(spark, str(tmp_path)))
    assert len(want) > least and rows_of(got.columns, got.collect()) == want


def test_a_small_state_has_few_partitions(spark, tmp_path):
    path, usual = str(tmp_path / "in"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 2),)], "at timestamp").write.parquet(path)
    counted = feeds.landed(spark, path, "at timestamp").withWatermark("at", "1 minute").groupBy(F.window("at", "1 minute")).count()
    for _ in range(2):
        out = jobs.write_available(counted, str(tmp_path / "o"), str(tmp_path / "c"), state_partitions=3)
        assert out.count() == 1 and sorted(p.name for p in (tmp_path / "c/state/0").iterdir() if p.name.isdigit()) == ["0", "1", "2"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == usual
