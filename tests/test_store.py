"""Changes to a table of day folders: what is written anew, what stays, and what a change that dies leaves."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logquarry.operators import joins, ranking, rules
from logquarry.sources.store import DayTable

SCHEMA = "id long, received_at timestamp, source_type string, message string"


def _events(spark, ids, note="m"):
    rows = [(i, datetime(2024, 1, 1 + i // 10, i % 10), "palo_alto" if i % 3 else "mist", f"{note}{i}") for i in ids]
    return spark.createDataFrame(rows, SCHEMA).withColumn("event_date", F.to_date("received_at"))


def _files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(f"{path}/data") for n in names if n.endswith(".parquet")}


def _current(table):
    """Files the table reads now, by day."""
    out = {}
    for file in table.read().inputFiles():
        out.setdefault(file.split("event_date=")[1][:10], set()).add(file)
    return out


@pytest.fixture
def table(spark, tmp_path):
    held = DayTable(spark, str(tmp_path / "events"))
    held.append(_events(spark, range(40)))
    return held


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_upsert_writes_touched_days_only(spark, table):
    before = _current(table)
    changes = _events(spark, [3, 12, 41], "new").withColumn("received_at", F.when(F.col("id") == 12, F.lit("2024-01-04 23:00:00").cast("timestamp")).otherwise(F.col("received_at"))).drop("event_date")
    old = table.read()
    want = rules.upsert_by_key(old.drop("event_date"), changes, "id", "received_at")
    assert table.upsert(changes, "id", "received_at") == ["2024-01-01", "2024-01-02"]
    assert _rows(table.read(), *SCHEMA.replace(",", "").split()[::2]) == _rows(want, *SCHEMA.replace(",", "").split()[::2])
    assert table.read().filter("event_date <> to_date(received_at)").count() == 0
    after = _current(table)
    assert after["2024-01-03"] == before["2024-01-03"] and before["2024-01-04"] < after["2024-01-04"]  # one row moved there
    assert not before["2024-01-01"] & after["2024-01-01"] and "2024-01-05" in after
    assert table.upsert(_events(spark, [90], "far"), "id", "received_at") == ["2024-01-10"]


def test_verdicts_are_marked_in_place(spark, table):
    before = _current(table)
    analyses = spark.createDataFrame(
        [(1, [5, 25], "high", "s1", None, datetime(2024, 2, 1)), (2, [5], "low", "s2", None, datetime(2024, 2, 2)), (3, [11], "low", "x", "broken", datetime(2024, 2, 2))],
        "id long, log_ids array<long>, severity string, summary string, error string, created_at timestamp",
    )
    assert table.mark_analyzed(analyses, job="run1") == ["2024-01-01", "2024-01-03"]
    marked = table.read()
    assert _rows(marked.filter("analyzed_at is not null"), "id", "llm_severity", "analysis_id") == [(5, "low", 2), (25, "high", 1)]
    assert marked.count() == 40 and _current(table)["2024-01-02"] == before["2024-01-02"]
    version = table.manifest()["version"]
    assert table.mark_analyzed(analyses, job="run1") == [] and table.manifest()["version"] == version
    assert table.mark_analyzed(analyses.filter("id = 3")) == []


def test_events_without_a_time_are_marked_too(spark, table):
    table.append(_events(spark, [50, 51]).withColumns({"received_at": F.lit(None).cast("timestamp"), "event_date": F.lit(None).cast("date")}))
    analyses = spark.createDataFrame(
        [(1, [5, 51], "high", "s1", None, datetime(2024, 2, 1))],
        "id long, log_ids array<long>, severity string, summary string, error string, created_at timestamp",
    )
    table.mark_analyzed(analyses)
    assert _rows(table.read().filter("analyzed_at is not null"), "id", "analysis_id") == [(5, 1), (51, 1)]
    assert table.read().count() == 42


def test_a_change_that_dies_leaves_the_old_table(spark, table):
    before, files = _rows(table.read(), "id", "message"), _current(table)

    def dies(rows):
        return rows.withColumn("message", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise("changed"))

    with pytest.raises(Exception, match="lost"):
        table.rewrite(["2024-01-01", "2024-01-02"], dies)
    assert _rows(table.read(), "id", "message") == before and _current(table) == files
    table.rewrite(["2024-01-02"], lambda rows: rows.withColumn("message", F.lit("changed")))
    assert table.read().filter("message = 'changed'").count() == 10


def test_readers_keep_their_version_until_vacuum(spark, table):
    reader = table.read()
    table.rewrite(["2024-01-01"], lambda rows: rows.filter("id > 4"))
    assert reader.count() == 40 and table.read().count() == 35
    assert table.vacuum(2) == 0 and reader.count() == 40
    assert table.vacuum() == 1 and table.read().count() == 35  # the first write holds the other days still
    table.rewrite(table.days(), lambda rows: rows)
    assert table.vacuum() >= 3 and table.read().count() == 35 and len(table._names(f"{table.path}/data")) == 1


def test_two_writers_do_not_overwrite_each_other(spark, table):
    other = DayTable(spark, table.path)

    def meanwhile(rows):
        other.append(_events(spark, [60]))
        return rows

    with pytest.raises(RuntimeError, match="another writer"):
        table.rewrite(["2024-01-01"], meanwhile)
    assert table.read().count() == 41


def test_pruning_by_cap_age_and_number(spark, table):
    before, all_ = _current(table), table.read()
    want = _rows(ranking.prune_by_cap(all_, 22, {"mist": 11}), "id")
    touched = table.prune_by_cap(22, {"mist": 11})
    assert _rows(table.read(), "id") == want and len(want) == 22
    assert all(_current(table)[d] == before[d] for d in table.days() if d not in touched) and "2024-01-04" not in touched
    assert table.prune_by_cap(22) == [] and table.prune_by_cap(0) == []
    assert table.keep_newest("id", 12) and _rows(table.read(), "id") == [(i,) for i in range(28, 40)]
    assert table.prune_by_age("2024-01-04 05:00:00") == ["2024-01-03", "2024-01-04"]
    assert _rows(table.read(), "id") == [(i,) for i in range(35, 40)] and table.days() == ["2024-01-04"]
    assert table.prune_by_age("2024-01-04 00:00:00") == []
    assert table.prune_by_age("2024-02-01 00:00:00") == ["2024-01-04"] and table.read().count() == 0


def test_batches_are_written_once(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no table"):
        table.read()
    assert table.append(_events(spark, range(5)), batch=0) and table.append(_events(spark, range(5, 15)), batch=1)
    assert table.append(_events(spark, range(5, 12)), batch=1)  # a replay
    assert table.read().count() == 12 and table.read(batch=1).count() == 7 and table.read(["2024-01-02"]).count() == 2
    table.rewrite(["2024-01-02"], lambda rows: rows)
    assert not table.append(_events(spark, range(5, 12)), batch=1) and table.read().count() == 12
    assert table.append(_events(spark, []), batch=2) and table.read(batch=2).count() == 0
    assert joins.events_by_ids(table.read(), spark.range(3)).count() == 3


def test_ids_are_never_given_twice(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from logquarry.sources import sinks

    path = str(tmp_path / "appended")
    assert sinks.append_events(_events(spark, range(7)).drop("event_date"), path) == 7
    write = DataFrameWriter.parquet

    def dies(self, target, *args, **kwargs):
        if target == path:
            raise RuntimeError("lost")
        return write(self, target, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", dies)
        with pytest.raises(RuntimeError, match="lost"):
            sinks.append_events(_events(spark, range(5)).drop("event_date"), path)
    assert sinks.append_events(_events(spark, range(3)).drop("event_date"), path) == 15  # the ids of the lost write are gone
    assert sinks.append_events(_events(spark, []).drop("event_date"), path) == 15
    assert sinks.append_events(_events(spark, range(2)).drop("event_date"), path, first_id=100) == 102
    assert _rows(spark.read.parquet(path), "id") == [(i,) for i in [*range(7), *range(12, 15), 100, 101]]
