"""Followed log files: appended lines, unfinished lines, rotation, truncation, restarts and splits."""

import os

import pytest

from logquarry.sources import follow
from logquarry.streaming import jobs


@pytest.fixture
def logs(spark, tmp_path):
    root = tmp_path / "logs"
    (root / "sub").mkdir(parents=True)

    class Logs:
        folder = root

        def add(self, name, text):
            with open(root / name, "ab") as file:
                file.write(text.encode() if isinstance(text, str) else text)

        def run(self, **options):
            """Reads to the end of what is there; what this run added, by file."""
            stream = follow.follow_log_files(spark, f"file:{root}", glob="*.log*", **{"start": "start", **options})
            out, before = str(tmp_path / "rows"), set(self.rows)
            jobs.write_available(stream, out, str(tmp_path / "checkpoint"))
            self.rows = [tuple(r) for r in spark.read.parquet(out).select("source", "offset", "line").collect()]
            assert len(set(self.rows)) == len(self.rows)
            fresh = {}
            for source, _, line in sorted(set(self.rows) - before):
                fresh.setdefault(os.path.relpath(source, root), []).append(line)
            return fresh

        rows = []

    return Logs()


def test_appended_lines_arrive_once(logs):
    logs.add("a.log", "one\r\ntwo\n\nthr")
    logs.add("sub/b.log", b"bad \xff\n")
    logs.add("c.txt", "not followed\n")
    assert logs.run() == {"a.log": ["one", "two"], "sub/b.log": ["bad �"]}
    logs.add("a.log", "ee\nfour\n")
    assert logs.run() == {"a.log": ["three", "four"]}
    assert logs.run() == {}
    logs.add("d.log", "new\n")
    assert logs.run() == {"d.log": ["new"]}


def test_rotated_and_truncated_files(logs):
    logs.add("a.log", "1\n2\n")
    logs.add("b.log", "long line here\n")
    assert logs.run() == {"a.log": ["1", "2"], "b.log": ["long line here"]}
    logs.add("a.log", "3\n")
    os.rename(logs.folder / "a.log", logs.folder / "a.log.1")
    logs.add("a.log", "4\n")
    with open(logs.folder / "b.log", "w") as file:
        file.write("anew\n")
    assert logs.run() == {"a.log.1": ["3"], "a.log": ["4"], "b.log": ["anew"]}
    os.remove(logs.folder / "a.log.1")
    logs.add("b.log", "more\n")
    assert logs.run() == {"b.log": ["more"]}


def test_from_the_end(logs):
    logs.add("a.log", "old\nunfin")
    stream_seen = logs.run(start="end")
    assert stream_seen == {}
    logs.add("a.log", "ished\nnew\n")
    assert logs.run(start="end") == {"a.log": ["unfinished", "new"]}


@pytest.mark.parametrize("split", [1, 7, 64])
def test_long_stretches_are_split_between_lines(logs, split):
    lines = [f"line {i} " + "x" * (i % 23) for i in range(60)]
    logs.add("a.log", "\n".join(lines) + "\n")
    assert logs.run(split_bytes=split) == {"a.log": lines}


def test_a_line_longer_than_a_step_back(logs, monkeypatch):
    monkeypatch.setattr(follow, "TAIL_BYTES", 5)
    logs.add("a.log", "short\n" + "y" * 40)
    path = str(logs.folder / "a.log")
    assert follow.whole_lines(path, 46) == 6 and follow.whole_lines(path, 46, 6) == 6 and follow.whole_lines(path, 3) == 0


def test_a_file_renamed_after_the_trigger_is_read_under_its_new_name(logs):
    logs.add("a.log", "x\n")
    reader = follow.FollowReader(str(logs.folder), "*.log", "start", 100)
    (part,) = reader.partitions({}, reader.latestOffset())
    os.rename(logs.folder / "a.log", logs.folder / "z.log.9")
    assert list(reader.read(part)) == [(part.path, 0, "x")]
    os.remove(logs.folder / "z.log.9")
    with pytest.raises(FileNotFoundError):
        list(reader.read(part))
