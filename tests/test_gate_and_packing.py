"""The blocked and sliced operators against plain sequential Python."""

import random
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logquarry.operators import gate, packing
from logquarry.operators.gate import alert_gate, alert_records
from logquarry.operators.packing import pack_token_budget
from logquarry.operators.ranking import prune_by_cap
from logquarry.operators.running import running_rank, running_sum

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def sequential_gate(hits, cap):
    last, recent, out = {}, deque(), {}
    for h in sorted(hits, key=lambda h: (h["t"], h["rule_name"], h["event_id"], h["rule_id"])):
        key = (h["rule_id"], h["source"])
        mark = (h["event_id"], h["rule_id"], h["source"])
        if key in last and h["t"] - last[key] < h["cooldown_sec"]:
            out[mark] = "cooldown"
            continue
        if cap > 0:
            while recent and recent[0] < h["t"] - 60:
                recent.popleft()
            if len(recent) >= cap:
                out[mark] = "rate_limit"
                continue
        last[key] = h["t"]
        recent.append(h["t"])
        out[mark] = "fired"
    return out


def random_hits(n, seconds, sources, seed, hot=0.4):
    rng = random.Random(seed)
    cooldowns = {"a": 30, "b": 120, "c": 0}
    hits = []
    for i in range(n):
        rule = "a" if rng.random() < hot else rng.choice("abc")
        source = "s0" if rng.random() < hot else f"s{rng.randrange(sources)}"
        hits.append({"event_id": i, "rule_id": rule, "rule_name": "n" + rule, "source": source, "cooldown_sec": cooldowns[rule], "t": rng.randrange(seconds)})
    return hits


def hits_frame(spark, hits):
    rows = [
        (h["event_id"], h["rule_id"], h["rule_name"], h["source"], h["cooldown_sec"], START + timedelta(seconds=h["t"]), "line", "hub", "http://x", None)
        for h in hits
    ]
    return spark.createDataFrame(
        rows,
        "event_id long, rule_id string, rule_name string, source string, cooldown_sec int, ts timestamp, line string, origin string, "
        "webhook_url string, email_to string",
    )


@pytest.mark.parametrize("cap, seed", [(0, 1), (4, 2), (30, 3)])
def test_gate_equals_sequential_run(spark, cap, seed):
    hits = random_hits(1500, 3000, 12, seed)
    out = alert_gate(hits_frame(spark, hits), cap=cap, rows_per_slice=60).collect()
    assert {(r["event_id"], r["rule_id"], r["source"]): r["status"] for r in out} == sequential_gate(hits, cap)


def test_gate_remembers_carried_fires(spark):
    hits = random_hits(400, 600, 4, 5)
    early, late = [h for h in hits if h["t"] < 300], [h for h in hits if h["t"] >= 300]
    first = alert_gate(hits_frame(spark, early), cap=5)
    fires = first.filter("status = 'fired'").select("rule_id", "source", F.unix_micros("ts").alias("t"))
    second = alert_gate(hits_frame(spark, late), cap=5, carried=fires, rows_per_slice=50)
    both = first.unionByName(second).collect()
    assert {(r["event_id"], r["rule_id"], r["source"]): r["status"] for r in both} == sequential_gate(hits, 5)


def _rounds(monkeypatch):
    settled = []
    settle = gate._settle
    monkeypatch.setattr(gate, "_settle", lambda df, name: settled.append(name) or settle(df, name))
    return settled


@pytest.mark.parametrize("slices", [20, 40, 200])
def test_rounds_do_not_grow_with_slices_under_a_cap_that_always_binds(spark, monkeypatch, slices):
    settled = _rounds(monkeypatch)
    hits = random_hits(4000, 4000, 30, 7)
    out = alert_gate(hits_frame(spark, hits), cap=3, rows_per_slice=4000 // slices).collect()
    assert {(r["event_id"], r["rule_id"], r["source"]): r["status"] for r in out} == sequential_gate(hits, 3)
    assert settled.count("gate-chained") <= 1 and settled.count("gate-closing") <= gate.SPECULATE + 2


def test_traffic_that_lets_up_needs_no_chain(spark, monkeypatch):
    settled = _rounds(monkeypatch)
    hits = [{**h, "t": h["t"] + 1000 * (h["t"] // 100)} for h in random_hits(1500, 1500, 12, 4)]  # bursts far apart
    out = alert_gate(hits_frame(spark, hits), cap=4, rows_per_slice=120).collect()
    assert {(r["event_id"], r["rule_id"], r["source"]): r["status"] for r in out} == sequential_gate(hits, 4)
    assert "gate-chained" not in settled


@pytest.mark.parametrize("cap", [0, 3])
def test_short_chains_one_after_the_other(spark, cap):
    hits = random_hits(1200, 600, 3, 9, hot=0.7)  # a rule and source over many slices, all within the longest cooldown
    out = alert_gate(hits_frame(spark, hits), cap=cap, rows_per_slice=50, chain_hits=400).collect()
    assert {(r["event_id"], r["rule_id"], r["source"]): r["status"] for r in out} == sequential_gate(hits, cap)


def test_a_task_holds_about_as_many_hits_as_a_slice(spark):
    slim = hits_frame(spark, random_hits(5000, 50, 3, 9)).withColumn("t", F.unix_micros("ts"))
    lined = gate._sliced(slim.select("event_id", "rule_id", "rule_name", "source", "t"), 5, 20)
    assert lined.groupBy("slice").count().agg(F.max("count")).first()[0] < 2.5 * 250
    assert lined.agg(F.max("slice") + 1).first()[0] == lined.select("slice").distinct().count()


def test_hits_without_a_time_a_source_or_a_cooldown(spark):
    rows = [(1, "r", "r", None, 60, None), (2, "r", "r", None, 60, START), (3, "r", "r", None, 60, START), (4, None, None, "s", None, START), (5, None, None, "s", None, START)]
    frame = spark.createDataFrame(rows, "event_id long, rule_id string, rule_name string, source string, cooldown_sec int, ts timestamp")
    for cap in (0, 30):
        for size in (gate.ROWS_PER_SLICE, 1):
            out = {r["event_id"]: r["status"] for r in alert_gate(frame, cap=cap, rows_per_slice=size).collect()}
            assert out == {1: "fired", 2: "fired", 3: "cooldown", 4: "fired", 5: "fired"}
    assert alert_gate(frame.limit(0)).collect() == []


def test_outcomes_of_deliveries(spark):
    hits = [{"event_id": i, "rule_id": "r", "rule_name": "r", "source": "s", "cooldown_sec": 60, "t": 50 * i} for i in range(6)]
    records = alert_records(alert_gate(hits_frame(spark, hits)))
    tries = [(0, "r", "s", "webhook", False, "x"), (0, "r", "s", "webhook", True, None), (2, "r", "s", "webhook", False, None), (1, "r", "s", "webhook", True, None)]
    tried = spark.createDataFrame(tries, "event_id long, rule_id string, source string, channel string, delivered boolean, error string")
    out = gate.record_deliveries(records, tried)
    assert out.columns == records.columns
    assert sorted((r["event_id"], r["status"], r["error"]) for r in out.collect()) == [
        (0, "sent", None), (1, "suppressed", "cooldown"), (2, "failed", "webhook delivery failed"), (3, "suppressed", "cooldown"), (4, "pending", None), (5, "suppressed", "cooldown"),
    ]


def test_second_hit_inside_cooldown_is_recorded_but_not_delivered(spark):
    hits = [
        {"event_id": i, "rule_id": "r", "rule_name": "r", "source": "/var/log/a.log", "cooldown_sec": 3600, "t": 10 * i} for i in range(2)
    ]
    records = alert_records(alert_gate(hits_frame(spark, hits))).orderBy("event_id").collect()
    assert [(r["channel"], r["status"], r["error"]) for r in records] == [("webhook", "pending", None), ("suppressed", "suppressed", "cooldown")]


def greedy_requests(tokens, budget):
    request, opened, out = -1, None, []
    for t in tokens:
        if t > budget:
            request, opened = request + 1, None
        elif opened is None or opened + t > budget:
            request, opened = request + 1, t
        else:
            opened += t
        out.append(request)
    return out


@pytest.mark.parametrize("budget, largest", [(50, 30), (50, 80), (7, 9), (1000, 30)])
def test_packing_equals_greedy_loop(spark, budget, largest):
    rng = random.Random(budget + largest)
    sources = {"hot": [rng.randint(1, largest) for _ in range(900)], "b": [rng.randint(1, largest) for _ in range(70)], "c": [largest]}
    rows = [(s, i * 3, t) for s, ts in sources.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "source string, position long, tokens int")
    out = pack_token_budget(df, budget, block_bits=6).collect()
    got = {(r["source"], r["position"]): r["request"] for r in out}
    want = {(s, i * 3): q for s, ts in sources.items() for i, q in enumerate(greedy_requests(ts, budget))}
    assert got == want


def test_packing_holds_no_source_in_one_task(spark, monkeypatch):
    """A source of 700 blocks, with holes between its positions, and one of a single block: a task sees 16 tables at most."""
    settled = []
    settle = packing.settled
    monkeypatch.setattr(packing, "settled", lambda df, name: settled.append(settle(df, name)) or settled[-1])
    rng = random.Random(8)
    tokens = [rng.randint(1, 40) for _ in range(3000)]
    places = sorted(rng.sample(range(3000), 2000)) + list(range(2**33, 2**33 + 1000))
    rows = [("hot", p, t) for p, t in zip(places, tokens)] + [("b", 1, 7), (None, 3, 9), (None, 4, 90)]
    df = spark.createDataFrame(rows, "source string, position long, tokens int")
    got = {(r["source"], r["position"]): r["request"] for r in pack_token_budget(df, 64, block_bits=2).collect()}
    want = {("hot", p): q for p, q in zip(places, greedy_requests(tokens, 64))}
    assert got == want | {("b", 1): 0, (None, 3): 0, (None, 4): 1}
    tables = [s for s in settled if "leave" in s.columns]
    assert tables[0].filter("source = 'hot'").count() > 700 and len(tables) == 9
    for table in tables[:-1]:
        assert table.groupBy("source", F.shiftright("blk", packing.FAN_BITS)).count().agg(F.max("count")).first()[0] <= 16


def test_running_sum_over_blocks_equals_loop(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", i, rng.randint(0, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    for reverse in (False, True):
        out = running_sum(df, ["k"], "i", F.col("v"), total="total", reverse=reverse, block_bits=4).collect()
        want, totals = {}, {}
        for k, i, v in sorted(rows, key=lambda r: -r[1] if reverse else r[1]):
            totals[k] = totals.get(k, 0) + v
            want[i] = totals[k]
        assert {r["i"]: r["running"] for r in out} == want
        assert all(r["total"] == totals[r["k"]] for r in out)


def test_running_rank_below_keeps_the_first(spark):
    df = spark.range(500).withColumn("k", F.lit("x"))
    out = running_rank(df, ["k"], "id", below=37, block_bits=3)
    assert sorted(r["id"] for r in out.collect()) == list(range(37))


def test_prune_keeps_protected_rows_even_above_the_cap(spark):
    rows = [(1, "palo_alto"), (2, "palo_alto"), (3, "mist"), (4, "palo_alto"), (5, "mist")]
    df = spark.createDataFrame(rows, "id long, source_type string")
    kept = lambda **kw: sorted(r["id"] for r in prune_by_cap(df, **kw).collect())
    assert kept(max_events=3) == [3, 4, 5]
    assert kept(max_events=2, floors={"mist": 2}) == [3, 5]
    assert kept(max_events=1, floors={"mist": 2, "palo_alto": 1}) == [3, 4, 5]
    assert kept(max_events=0) == [1, 2, 3, 4, 5]


def test_slices_are_small_unless_there_are_very_many():
    assert [gate.slice_rows(n) for n in (1, 216_667, 2_166_667, 25_000_000, 100_000_000, 10**9)] == [25_000, 25_000, 25_000, 25_000, 100_000, 200_000]
