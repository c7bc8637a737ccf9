"""A streaming source for log files that grow: lines appended between two triggers arrive once.

The stream's offset holds, for every file, its inode and the byte up to which whole lines have been read; it lives in the
query's checkpoint, so a restarted query goes on where it was. An unfinished last line waits until its line break comes.
A file that shrank starts anew, as does a new file under an old name; a file that was only renamed (rotated) is known by
its inode and goes on under its new name, so nothing is read twice and what was appended just before is not lost.

The driver lists files and looks at the last bytes of those that changed. Lines are read in the executors, long stretches
in several tasks, so the folder has to be mounted on all of them. A file that is cut short and grows beyond its old length
between two triggers cannot be told from one that only grew.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, offset long, line string"
SPLIT_BYTES = 64 << 20  # of one file read by one task, about
TAIL_BYTES = 1 << 16  # looked at in a step back to the last line break


@dataclass
class Stretch(InputPartition):
    """Lines of a file that begin at bytes ``low`` to ``high``; ``low`` begins one if ``whole``."""

    path: str
    inode: int
    low: int
    high: int
    whole: bool


def whole_lines(path: str, size: int, least: int = 0) -> int:
    """The end of the last line break before ``size``, ``least`` if there is none after it."""
    with open(path, "rb") as file:
        end = size
        while end > least:
            begin = max(least, end - TAIL_BYTES)
            file.seek(begin)
            found = file.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return least


class FollowReader(DataSourceStreamReader):
    def __init__(self, root: str, glob: str, start: str, split_bytes: int):
        self.root, self.glob, self.start, self.split_bytes = root, glob, start, split_bytes
        self.ends: dict[int, tuple[int, int]] = {}  # inode: size and end when last looked at

    def _files(self) -> dict[str, dict[str, int]]:
        out, ends = {}, {}
        for folder, _, names in os.walk(self.root):
            for name in sorted(fnmatch.filter(names, self.glob)):
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                    size, end = self.ends.get(stat.st_ino, (0, 0))
                    if stat.st_size != size:
                        end = whole_lines(path, stat.st_size, end if stat.st_size > size else 0)
                except OSError:  # gone or closed to us meanwhile
                    continue
                ends[stat.st_ino] = stat.st_size, end
                out[path] = {"inode": stat.st_ino, "at": end}
        self.ends = ends
        return out

    def initialOffset(self) -> dict:
        return {} if self.start == "start" else self._files()

    def latestOffset(self) -> dict:
        return self._files()

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        read = {held["inode"]: held["at"] for held in start.values()}
        out = []
        for path, now in end.items():
            at = read.get(now["inode"], 0)
            at = at if at <= now["at"] else 0  # it shrank
            for low in range(at, now["at"], self.split_bytes):
                out.append(Stretch(path, now["inode"], low, min(now["at"], low + self.split_bytes), low == at))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        with _opened(partition) as file:
            at = partition.low
            if not partition.whole:  # the line that reaches into this stretch belongs to the one before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            while at < partition.high:
                raw = file.readline()
                if not raw:
                    break
                line = raw.rstrip(b"\n").decode("utf-8", "replace").rstrip("\r")
                if line:
                    yield partition.path, at, line
                at += len(raw)


def _opened(partition: Stretch):
    """The file, under the name it has now if it was rotated since the trigger."""
    folder = os.path.dirname(partition.path)
    for path in [partition.path, *(os.path.join(folder, name) for name in sorted(os.listdir(folder)))]:
        try:
            file = open(path, "rb")  # noqa: SIM115
        except OSError:
            continue
        if os.fstat(file.fileno()).st_ino == partition.inode:
            return file
        file.close()
    raise FileNotFoundError(f"{partition.path} went before its lines were read")


class FollowedLogs(DataSource):
    """Options: path, glob, start (``end``: only what is appended from now on; ``start``: what is there too), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "followed_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FollowReader:
        given = self.options
        return FollowReader(given["path"], given.get("glob", "*"), given.get("start", "end"), int(given.get("splitBytes", SPLIT_BYTES)))


def follow_log_files(spark: SparkSession, root: str, *, glob: str = "*", start: str = "end", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of (source, offset, line): non-empty lines of the files below a folder as they grow."""
    spark.dataSource.register(FollowedLogs)
    stream = spark.readStream.format("followed_logs").option("path", root.removeprefix("file:")).option("glob", glob)
    return stream.option("start", start).option("splitBytes", split_bytes).load()
