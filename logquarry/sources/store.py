"""A table of day folders that is changed in place: only the days a change touches are written anew.

A manifest lists the folders that make up the table. A change writes new folders beside the old ones and then publishes a
new manifest by one rename, so a reader sees the table before the change or after it, and a change that dies leaves the
old table as it was. Days that a change doesn't touch keep their files. Folders no manifest needs any more are deleted by
``vacuum``. There is one writer at a time; readers need no lock.

The driver holds the manifest (a line for each folder), never rows. Folders are found by the days in which a join on the
key column alone finds rows to change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logquarry.operators import joins, ranking, rules

DAY = "event_date"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a time


class DayTable:
    """Events by day: ``event_date`` and the columns in ``by`` are folders."""

    def __init__(self, spark: SparkSession, path: str, *, by: Iterable[str] = ("source_type",)):
        self.spark, self.path, self.by = spark, path.rstrip("/"), [DAY, *by]

    # --- the manifest --------------------------------------------------------------------------------------

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _names(self, path: str) -> list[str]:
        fs, folder = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def manifest(self) -> dict:
        """version, schema, entries (day, write, batches) and the names of finished jobs."""
        versions = [n for n in self._names(f"{self.path}/manifest") if n.startswith("v")]
        if not versions:
            return {"version": 0, "schema": None, "entries": [], "jobs": []}
        fs, file = self._fs(f"{self.path}/manifest/{versions[-1]}")
        stream = fs.open(file)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, before: dict, schema: StructType, entries: list[dict], job: str | None = None) -> None:
        now = before | {"version": before["version"] + 1, "schema": json.loads(schema.json()), "entries": entries}
        now["jobs"] = [*before["jobs"], *([job] if job else [])]
        fs, draft = self._fs(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(now).encode()))
        finally:
            stream.close()
        final = self._fs(f"{self.path}/manifest/v{now['version']:012d}")[1]
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError("another writer has changed the table meanwhile")

    # --- reading -------------------------------------------------------------------------------------------

    def days(self) -> list[str]:
        return sorted({e["day"] for e in self.manifest()["entries"]})

    def read(self, days: Iterable[str] | None = None, *, batch: int | None = None) -> DataFrame:
        """The rows, of some days or of one batch alone if asked for; folders of other days are not even listed. Rows of a
        batch are told from others in a rewritten day by their column ``batch``."""
        return self._rows(self.manifest(), days, batch)

    def _rows(self, manifest: dict, days: Iterable[str] | None = None, batch: int | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError(f"there is no table at {self.path}")
        schema, wanted = StructType.fromJson(manifest["schema"]), None if days is None else set(days)
        entries = [e for e in manifest["entries"] if (wanted is None or e["day"] in wanted) and (batch is None or batch in e["batches"])]
        if not entries:
            return self.spark.createDataFrame([], schema)
        stored = StructType([f for f in schema if f.name not in self.by] + [StructField("write", StringType())] + [f for f in schema if f.name in self.by])
        reader = self.spark.read.schema(stored).option("basePath", f"{self.path}/data")
        rows = reader.parquet(*(f"{self.path}/data/write={e['write']}/{DAY}={e['day']}" for e in entries)).select(*schema.names)
        # a day that was written anew holds other batches' rows too
        mixed = batch is not None and "batch" in schema.names and any(e["batches"] != [batch] for e in entries)
        return rows.filter(F.col("batch") == batch) if mixed else rows

    # --- writing -------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, batches: list[int]) -> list[dict]:
        """New folders for the rows; the entries that name them."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/write={name}"
        rows.hint("rebalance", *self.by).write.partitionBy(*self.by).parquet(folder)
        days = [n.removeprefix(f"{DAY}=") for n in self._names(folder) if n.startswith(f"{DAY}=")]
        return [{"day": day, "write": name, "batches": batches} for day in days]

    def append(self, rows: DataFrame, *, batch: int | None = None) -> bool:
        """Adds rows. A batch that is written again replaces what it wrote before; if that was merged into rewritten days
        since, it is there already and nothing is done (False)."""
        before = self.manifest()
        if batch is not None and any(batch in e["batches"] and e["batches"] != [batch] for e in before["entries"]):
            return False
        kept = [e for e in before["entries"] if batch is None or e["batches"] != [batch]]
        self._publish(before, self._merged(before, rows), kept + self._write(rows, [] if batch is None else [batch]))
        return True

    def _merged(self, before: dict, rows: DataFrame) -> StructType:
        """The table's columns, then the rows' own."""
        fields = StructType.fromJson(before["schema"]).fields if before["schema"] else []
        return StructType([*fields, *(StructField(f.name, f.dataType) for f in rows.schema if f.name not in {x.name for x in fields})])

    def rewrite(self, days: Iterable[str], change: Callable[[DataFrame], DataFrame], *, drop: Iterable[str] = (), job: str | None = None) -> list[str]:
        """Puts ``change`` of the rows of some days in their place, and drops other days unread; returns the days touched.

        A ``job`` is done once: if its name is in the manifest already, nothing happens."""
        before = self.manifest()
        if job is not None and job in before["jobs"]:
            return []
        days, gone = set(days), set(drop)
        kept = [e for e in before["entries"] if e["day"] not in days | gone]
        held = [e for e in before["entries"] if e["day"] in days]
        schema, entries = StructType.fromJson(before["schema"]), []
        if held or not days:
            batches = sorted({b for e in held for b in e["batches"]})
            # more than one, so that a day of merged batches is never taken for the one folder of a batch
            rows = change(self._rows(before, days)) if days else None
            if rows is not None:
                schema, entries = self._merged(before, rows), self._write(rows, batches if len(batches) != 1 else [*batches, -1])
        self._publish(before, schema, kept + entries, job)
        return sorted(days | gone)

    def touched(self, keys: DataFrame, key: str) -> list[str]:
        """The days that hold any of the keys. Reads the key column alone."""
        day = F.coalesce(F.col(DAY).cast("string"), F.lit(NO_DAY))
        found = self.read().select(key, day.alias("day")).join(keys.select(key).distinct(), key, "left_semi")
        return sorted(r[0] for r in found.select("day").distinct().collect())

    def upsert(self, changes: DataFrame, key: str, version: str, *, keep: list[str] | None = None, job: str | None = None) -> list[str]:
        """Applies changes (``rules.upsert_by_key``): the days that hold a changed key are written anew, rows with new keys
        are added to their days."""
        changes = changes.withColumns({DAY: F.to_date("received_at")}) if DAY not in changes.columns else changes
        days = self.touched(changes, key)

        def change(current: DataFrame) -> DataFrame:
            merged = rules.upsert_by_key(current, changes, key, version, keep=keep)
            return merged.withColumn(DAY, F.to_date("received_at")) if "received_at" in merged.columns else merged

        if not days:
            return [] if job and job in self.manifest()["jobs"] else self._added(rules.latest_by_key(changes, key, version), job)
        return self.rewrite(days, change, job=job)

    def _added(self, rows: DataFrame, job: str | None) -> list[str]:
        before = self.manifest()
        entries = self._write(rows, [])
        self._publish(before, self._merged(before, rows), before["entries"] + entries, job)
        return sorted(e["day"] for e in entries)

    def mark_analyzed(self, analyses: DataFrame, *, job: str | None = None) -> list[str]:
        """Writes verdicts onto the events they cover (``joins.mark_analyzed``)."""
        ids = analyses.filter("error is null").select(F.explode("log_ids").alias("id"))
        days = self.touched(ids, "id")
        return self.rewrite(days, lambda events: joins.mark_analyzed(events, analyses), job=job)

    def keep_where(self, kept: Column) -> list[str]:
        """Deletes the rows for which ``kept`` doesn't hold. Days without any such row stay as they are, days of nothing
        else are dropped unread."""
        per_day = self.read().groupBy(F.col(DAY).cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"))
        counts = [tuple(r) for r in per_day.filter("kept < n").collect()]
        cut, gone = [d for d, _, k in counts if k], [d for d, _, k in counts if not k]
        return self.rewrite(cut, lambda rows: rows.filter(kept), drop=gone) if counts else []

    def prune_by_age(self, cutoff: str) -> list[str]:
        """Deletes events received before a time: earlier days unread, the day of the cutoff by rewriting it."""
        day = cutoff[:10]
        gone, cut = [d for d in self.days() if d < day], [d for d in self.days() if d == day]
        recent = F.col("received_at") >= F.lit(cutoff).cast("timestamp")
        if cut and not self.read(cut).filter(~recent).limit(1).count():
            cut = []
        return self.rewrite(cut, lambda rows: rows.filter(recent), drop=gone) if gone or cut else []

    def prune_by_cap(self, max_events: int, floors: dict[str, int] | None = None) -> list[str]:
        """Deletes the oldest events beyond a number (``ranking.prune_by_cap``)."""
        kept = ranking.within_cap(self.read(), max_events, floors)
        return [] if kept is None else self.keep_where(kept)

    def keep_newest(self, order: str, keep: int) -> list[str]:
        """Deletes all but the ``keep`` rows with the largest values of a unique integer column."""
        rows = self.read()
        excess = rows.count() - keep
        return self.keep_where(F.col(order) > ranking.nth_smallest(rows, order, excess)) if excess > 0 else []

    def vacuum(self, versions: int = 1) -> int:
        """Deletes what only manifests older than the last ``versions`` need; returns how many folders and files went."""
        fs, gone = self._fs(self.path)[0], []
        names = [n for n in self._names(f"{self.path}/manifest") if n.startswith("v")]
        needed = set()
        for name in names[-versions:]:
            stream = fs.open(self._fs(f"{self.path}/manifest/{name}")[1])
            needed |= {e["write"] for e in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["entries"]}
            stream.close()
        gone += [f"{self.path}/manifest/{n}" for n in self._names(f"{self.path}/manifest") if n not in names[-versions:]]
        gone += [f"{self.path}/data/{n}" for n in self._names(f"{self.path}/data") if n.startswith("write=") and n.removeprefix("write=") not in needed]
        for path in gone:
            fs.delete(self._fs(path)[1], True)
        return len(gone)
