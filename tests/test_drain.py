"""The analysis job: what a run that dies leaves, and what running it again adds."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logquarry.bridge import Bridge
from logquarry.plans import load
from logquarry.sources.store import DayTable
from logquarry.streaming import drain as jobs


def _drain(*args, **options):
    return jobs.drain(*args, now=F.lit("2024-03-01 00:00:00").cast("timestamp"), **options)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i // 8), "generic", f"1,2024/01/01 00:00:00,7,THREAT,x action deny src=1.1.1.{i}" if i % 6 == 5 else f"line {i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "id long, received_at timestamp, source_type string, message string")
    held = DayTable(spark, str(tmp_path / "events"))
    held.append(frame.withColumn("event_date", F.to_date("received_at")))
    return held


def _asked(folder):
    """A model that notes each prompt in a folder, and fails where a file says so."""

    def model(prompts):
        import os
        import uuid

        first = prompts[0].split("\n")[1].split("|")[1]
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(first)
        if os.path.exists(f"{folder}/fail {first}"):
            raise RuntimeError("no answer")
        if os.path.exists(f"{folder}/die {first}"):
            os._exit(1)
        return ['{"severity":"medium","summary":"' + first + '"}']

    return model


def _notes(folder):
    return sorted(p.read_text() for p in folder.iterdir() if " " not in p.name)


def _marks(table):
    rows = table.read()
    return {} if "analysis_id" not in rows.columns else {r["id"]: (r["llm_severity"], r["llm_summary"], r["analysis_id"]) for r in rows.filter("analyzed_at is not null").collect()}


def test_all_events_are_marked_once(spark, table, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    result = _drain(table, str(tmp_path / "run"), _asked(str(notes)), size=10)
    assert result == {"logs_processed": 30, "batches_done": 3, "batches_ok": 3, "batches_fail": 0, "auto_skipped": 5, "stopped_reason": "empty"}
    marks = _marks(table)
    assert len(marks) == 30 and marks[0] == ("medium", "line 0", 2) and marks[29][2] in (5, 6)
    version = table.manifest()["version"]
    assert _drain(table, str(tmp_path / "run"), _asked(str(notes)), size=10) == result
    assert table.manifest()["version"] == version and len(_notes(notes)) == 3
    assert _drain(table, str(tmp_path / "next"), _asked(str(notes)), first_id=100)["logs_processed"] == 0


def test_failed_calls_leave_their_events_pending(spark, table, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "fail line 10").touch()
    result = _drain(table, str(tmp_path / "run"), _asked(str(notes)), size=10, round_batches=2, skip_blocked=False)
    assert (result["batches_ok"], result["batches_fail"], result["stopped_reason"]) == (1, 1, "model_error")
    assert sorted(_marks(table)) == list(range(10))  # the third batch was not begun
    (notes / "fail line 10").unlink()
    again = _drain(table, str(tmp_path / "run2"), _asked(str(notes)), first_id=50, size=10, skip_blocked=False, max_batches=1)
    assert (again["batches_ok"], again["stopped_reason"]) == (1, "batch_cap") and sorted(_marks(table)) == list(range(20))
    assert _marks(table)[10] == ("medium", "line 10", 51) and _marks(table)[0][2] == 2


def test_a_run_that_dies_goes_on_where_it_was(spark, table, tmp_path, monkeypatch):
    notes = tmp_path / "notes"
    notes.mkdir()
    late = spark.createDataFrame([(-1, datetime(2024, 1, 1), "generic", "late")], "id long, received_at timestamp, source_type string, message string")

    def lost(*args, **kwargs):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:  # after the model step
        patch.setattr(DayTable, "mark_analyzed", lost)
        with pytest.raises(RuntimeError, match="driver lost"):
            _drain(table, str(tmp_path / "run"), _asked(str(notes)), size=10, round_batches=1)
    assert _marks(table) == {} and len(_notes(notes)) == 3
    table.append(late.withColumn("event_date", F.to_date("received_at")))  # would shift every batch
    result = _drain(table, str(tmp_path / "run"), _asked(str(notes)), size=10, round_batches=1)
    assert result["logs_processed"] == 30 and len(_notes(notes)) == 3 and sorted(_marks(table)) == list(range(30))


def test_only_the_round_that_died_is_asked_again(spark, table, tmp_path, monkeypatch):
    notes = tmp_path / "notes"
    notes.mkdir()
    once = jobs.Ledger.once

    def dies(self, name, make):
        if name == "replies/round=1":
            raise RuntimeError("cluster lost")
        return once(self, name, make)

    with monkeypatch.context() as patch:
        patch.setattr(jobs.Ledger, "once", dies)
        with pytest.raises(RuntimeError, match="cluster lost"):
            _drain(table, str(tmp_path / "run"), _asked(str(notes)), size=10, round_batches=1, skip_blocked=False)
    assert _notes(notes) == ["line 0"]
    _drain(table, str(tmp_path / "run"), _asked(str(notes)), size=10, round_batches=1, skip_blocked=False)
    assert _notes(notes) == ["line 0", "line 10", "line 20"] and len(_marks(table)) == 30


def test_one_round_asks_every_batch_whichever_calls_fail(spark, table, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "fail line 10").touch()
    result = _drain(table, str(tmp_path / "run"), _asked(str(notes)), size=10, round_batches=0, skip_blocked=False)
    assert (result["batches_ok"], result["batches_fail"], result["logs_processed"]) == (2, 1, 30)
    assert sorted(_marks(table)) == [*range(10), *range(20, 30)] and _notes(notes) == ["line 0", "line 10", "line 20"]
    nothing = DayTable(spark, str(tmp_path / "none"))
    nothing.append(table.read().limit(0))
    assert _drain(nothing, str(tmp_path / "run2"), _asked(str(notes)), round_batches=0)["logs_processed"] == 0


def test_the_query_drains_its_whole_table(spark, tmp_path, monkeypatch):
    """Early and undated events, all source types, whole lines, and batches behind a failed call."""
    monkeypatch.setitem(jobs.drain.__kwdefaults__, "round_batches", 2)  # so that this table is more than a round by default
    rows = [(i, None if i == 67 else datetime(2024, 1, 1 + i % 5, 3), i, "x" * 130) for i in range(100)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r[0]: tuple(r[1:]) for r in load()["analysis_drain"].run(Bridge(spark, str(tmp_path))).collect()}
    want = {}
    for batch in range(10):
        ids = range(batch * 10, batch * 10 + 10)
        skipped = [i for i in ids if i % 4 == 0 and i % 5 < 3]
        told = [i for i in ids if i % 4 != 0]  # firewall lines do not hold the message
        failed, denied = any(i % 9 == 5 for i in told), any(i % 9 == 3 for i in told)
        reply = (None, None, None) if failed else ("high" if denied else "low", f"{10 - len(skipped)} lines", 2 + 2 * batch)
        skip = ("info", f"Auto-skipped {len(skipped)} blocked/denied log{'' if len(skipped) == 1 else 's'}", 1 + 2 * batch)
        want |= {i: skip if i in skipped else reply for i in ids}
    assert got == want and want[67][2] == 14 and want[1] == (None, None, None)
