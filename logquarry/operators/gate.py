"""Alert gate over a finished table: cooldown per (rule, source) and one cap over everything per minute.

Whether a hit fires depends on every earlier fire, so the gate is sequential by nature. It is run in parallel all the
same, and exactly. Hits are range-sorted into slices of about ``rows_per_slice`` hits (by default a thousandth of all,
within ``LEAST_ROWS`` and ``ROWS_PER_SLICE``, as a task holds a slice in memory), in the order of time (with a cap)
or of rule, source and time (without one, where only a rule and source that a slice border cuts have a past). What a
slice hands on is small and bounded: the last fire of each rule and source within the longest cooldown, and the last
``cap`` fires.

1. All slices are walked at once, as if nothing came before them, and again where what the slice before hands on differs
   from what was assumed. Where traffic lets up, that settles everything in a round or two.
2. Under a cap that binds without a pause no slice forgets how the one before ended. So the slices that are left are
   walked as chains: one task streams up to ``chain_hits`` hits in order, holding a batch and the state, and emits what
   every slice hands on; the rounds no longer depend on the number of slices. A walk leaps from the moment the cap is
   reached to the moment it lets go, so it looks at few of the hits that the cap suppresses.
3. With what every slice starts from known, all verdicts are given in one parallel pass.

A hit without a time counts as of the epoch, one without a cooldown as of none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import shared_dir

CAP_WINDOW_US = 60_000_000
ROWS_PER_SLICE = 200_000  # hits a task walks or judges at most, about
LEAST_ROWS, SLICES = 25_000, 1_000  # smaller slices do not pay; more slices than this only where they would be too large
SPECULATE = 3  # rounds over all slices at once before chains begin
CHAIN_HITS = 50_000_000  # hits one task streams in a chain at most
FIRED, COOLDOWN, RATE_LIMIT = "fired", "cooldown", "rate_limit"

_MEMORY = "slice long, rule_id string, source string, t long"
_STREAM = "run long, slice long, at long, rule_id string, source string, t long, wait long"
_VERDICT = "event_id long, rule_id string, source string, t long, status string"


class State:
    """The fires a gate remembers: the last one of each rule and source, and the last ``cap`` of all."""

    def __init__(self, cap: int, memory_us: int):
        self.cap, self.memory_us = cap, memory_us
        self.last: dict[tuple, int] = {}
        self.recent: list[tuple] = []  # (t, rule, source), oldest first

    def remember(self, fires: pd.DataFrame) -> State:
        for t, rule, source in sorted(zip(fires["t"], fires["rule_id"], fires["source"]), key=lambda f: f[0]):
            self._add(int(t), rule, source)
        return self

    def _add(self, t: int, rule, source) -> None:
        self.last[rule, source] = t
        if self.cap > 0:
            self.recent.append((t, rule, source))
            del self.recent[: -self.cap]

    def walk(self, hits: pd.DataFrame) -> list[int]:
        """Which of the hits, in their order, fire."""
        t, fires, i = hits["t"].to_numpy(np.int64), [], 0
        rules, sources, waits = hits["rule_id"].tolist(), hits["source"].tolist(), hits["wait"].tolist()
        while i < len(t):
            if 0 < self.cap <= len(self.recent):
                shut = self.recent[0][0] + CAP_WINDOW_US  # no fire up to and including this moment
                if t[i] <= shut:
                    i = int(np.searchsorted(t, shut, side="right"))
                    continue
            before = self.last.get((rules[i], sources[i]))
            if before is None or t[i] - before >= waits[i]:
                self._add(int(t[i]), rules[i], sources[i])
                fires.append(i)
            i += 1
        return fires

    def handed(self, hits: pd.DataFrame) -> list[tuple]:
        """(rule, source, t): what matters after the last of these hits. Without a cap that is its own rule and source's."""
        t, own = int(hits["t"].iloc[-1]), (hits["rule_id"].iloc[-1], hits["source"].iloc[-1])
        if self.cap <= 0:
            self.last = {own: self.last[own]} if own in self.last else {}
        self.last = {key: f for key, f in self.last.items() if t - f < self.memory_us}
        self.recent = [f for f in self.recent if t - f[0] <= CAP_WINDOW_US]
        recent = [(rule, source, f) for f, rule, source in self.recent]
        return sorted(recent + list({(*key, f) for key, f in self.last.items()} - set(recent)), key=repr)


def _handed_frame(number: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["rule_id", "source", "t"]).astype({"rule_id": object, "source": object, "t": "int64"})
    return out.assign(slice=number + 1)[["slice", "rule_id", "source", "t"]]


def _walked(cap: int, memory_us: int):
    """What one slice hands to the next, given what it starts from."""

    def run(hits: pd.DataFrame, memory: pd.DataFrame) -> pd.DataFrame:
        if hits.empty:
            return _handed_frame(0, [])
        state = State(cap, memory_us).remember(memory)
        hits = hits.sort_values("at")
        state.walk(hits)
        return _handed_frame(int(hits["slice"].iloc[0]), state.handed(hits))

    return run


def _chained(cap: int, memory_us: int):
    """What every slice of a chain hands on. Rows come in order; those that are no hits hold what a chain starts from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, chain, number, tail = State(cap, memory_us), None, None, None
        for batch in batches:
            for (own, part), rows in batch.groupby(["run", "slice"], sort=False):
                if tail is not None and (own, part) != (chain, number):
                    yield _handed_frame(number, state.handed(tail))
                    tail = None
                if own != chain:
                    state = State(cap, memory_us)
                chain, number = own, part
                state.remember(rows[rows["at"] < 0])
                hits = rows[rows["at"] >= 0]
                if len(hits):
                    state.walk(hits)
                    tail = hits.iloc[-1:]
        if tail is not None:
            yield _handed_frame(number, state.handed(tail))

    return run


def _judged(cap: int, memory_us: int):
    """The verdicts of one slice, given what it starts from."""

    def run(hits: pd.DataFrame, memory: pd.DataFrame) -> pd.DataFrame:
        columns = ["event_id", "rule_id", "source", "t", "status"]
        if hits.empty:
            return pd.DataFrame(columns=columns).astype({"event_id": "int64", "t": "int64"})
        state = State(cap, memory_us).remember(memory)
        hits = hits.sort_values("at").reset_index(drop=True)
        first = [state.last.get(key) for key in zip(hits["rule_id"], hits["source"])]
        fires = state.walk(hits)
        own = hits.groupby(["rule_id", "source"], sort=False, dropna=False).ngroup()
        fired = pd.Series(False, index=hits.index)
        fired.iloc[fires] = True
        # the last fire of the same rule and source before each hit: in the slice, else among what it starts from
        before = hits["t"].where(fired).groupby(own).ffill().groupby(own).shift().fillna(pd.Series(first, index=hits.index, dtype="float64"))
        cooling = (hits["t"] - before < hits["wait"]).to_numpy()
        status = np.where(fired, FIRED, np.where(cooling, COOLDOWN, RATE_LIMIT)).astype(object)
        return hits.assign(status=status)[columns]

    return run


def _settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sliced(slim: DataFrame, cap: int, slices: int) -> DataFrame:
    """The hits with their slice and their place in it."""
    order = ["t", "rule_name", "event_id", "rule_id", "source"] if cap > 0 else ["rule_id", "source", "t", "rule_name", "event_id"]
    lined = slim.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    lined = _settle(lined, "gate-lined")
    parts = sorted(r[0] for r in lined.select(F.shiftright("place", 33)).distinct().collect())
    numbers = slim.sparkSession.createDataFrame(list(enumerate(parts)), "slice long, part long")
    numbered = lined.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(numbers), "part")
    return numbered.withColumn("at", F.col("place").bitwiseAND((1 << 33) - 1)).drop("place", "part", "rule_name")


def _starts(lined: DataFrame, cap: int) -> list[int]:
    """Slices that take nothing from the one before: the first; without a cap, those that begin another rule or source."""
    if cap > 0:
        return [0]
    ends = lined.groupBy("slice").agg(F.max("at").alias("at"))
    head = lined.filter("at = 0").select("slice", "rule_id", "source")
    tail = lined.join(ends, ["slice", "at"]).select((F.col("slice") + 1).alias("slice"), F.col("rule_id").alias("r"), F.col("source").alias("s"))
    same = F.col("rule_id").eqNullSafe(F.col("r")) & F.col("source").eqNullSafe(F.col("s"))
    goes_on = head.join(tail, "slice").filter(same).select("slice")
    return sorted(r[0] for r in head.join(goes_on, "slice", "left_anti").select("slice").collect())  # a number for each slice at most


def slice_rows(hits: int) -> int:
    """Hits of a slice where the caller names no number."""
    return min(ROWS_PER_SLICE, max(LEAST_ROWS, hits // SLICES))


def gate_verdicts(
    hits: DataFrame, *, cap: int = 30, carried: DataFrame | None = None, rows_per_slice: int | None = None, chain_hits: int = CHAIN_HITS
) -> DataFrame:
    """(event_id, rule_id, source, t, status) per hit. ``carried``: earlier fires (rule_id, source, t)."""
    slim = hits.select(
        "event_id",
        "rule_id",
        "rule_name",
        "source",
        F.coalesce(F.unix_micros(F.col("ts")), F.lit(0)).alias("t"),
        F.coalesce(F.col("cooldown_sec").cast("long") * 1_000_000, F.lit(0)).alias("wait"),
    )
    slim = _settle(slim, "gate-hits")
    size = slim.agg(F.max("wait").alias("wait"), F.count("*").alias("n")).first()
    if not size["n"]:
        return slim.select("event_id", "rule_id", "source", "t", F.lit(FIRED).alias("status"))
    memory_us = max(size["wait"], CAP_WINDOW_US)
    rows_per_slice = rows_per_slice or slice_rows(size["n"])
    lined = _sliced(slim, cap, -(-size["n"] // rows_per_slice))
    given = _carried_memory(lined, carried, cap)
    slices = lined.agg(F.max("slice")).first()[0] + 1
    if slices > 1:  # a micro-batch mostly has one
        given = _settled_memory(lined, given, slices, cap, memory_us, max(1, chain_hits // rows_per_slice))
    return lined.groupBy("slice").cogroup(given.groupBy("slice")).applyInPandas(_judged(cap, memory_us), _VERDICT)


def _carried_memory(lined: DataFrame, carried: DataFrame | None, cap: int) -> DataFrame:
    """Earlier fires as what the slice starts from in which they are first needed."""
    if carried is None:
        return lined.sparkSession.createDataFrame([], _MEMORY)
    if cap > 0:
        return carried.select(F.lit(0).cast("long").alias("slice"), "rule_id", "source", "t")
    first = lined.groupBy(F.col("rule_id").alias("r"), F.col("source").alias("s")).agg(F.min("slice").alias("slice"))
    own = F.col("rule_id").eqNullSafe(F.col("r")) & F.col("source").eqNullSafe(F.col("s"))
    return carried.join(first, own).select("slice", "rule_id", "source", "t")


def _settled_memory(lined: DataFrame, given: DataFrame, slices: int, cap: int, memory_us: int, chain: int) -> DataFrame:
    """What every slice starts from."""
    starts = _starts(lined, cap)
    fresh = lined.sparkSession.createDataFrame([(s,) for s in starts], "slice long")

    def walked(part: DataFrame, memory: DataFrame) -> DataFrame:
        return part.groupBy("slice").cogroup(memory.groupBy("slice")).applyInPandas(_walked(cap, memory_us), _MEMORY)

    def started(closing: DataFrame) -> DataFrame:
        on = closing.filter(F.col("slice") < slices).join(F.broadcast(fresh), "slice", "left_anti")
        return given.unionByName(on)

    def differ(start: DataFrame, used: DataFrame) -> list[int]:
        both = start.withColumn("side", F.lit(1)).unionByName(used.withColumn("side", F.lit(-1)))
        net = both.groupBy("slice", "rule_id", "source", "t").agg(F.sum("side").alias("net")).filter("net <> 0")
        return sorted(r[0] for r in net.select("slice").distinct().collect())  # at most a number for each slice

    def numbers(of: list[int]) -> DataFrame:
        return F.broadcast(lined.sparkSession.createDataFrame([(s,) for s in of], "slice long"))

    used, closing = given, _settle(walked(lined, given), "gate-closing")
    for _ in range(SPECULATE):
        start = _settle(started(closing), "gate-start")
        stale = differ(start, used)
        if not stale:
            return start
        again = walked(lined.join(numbers(stale), "slice", "left_semi"), start.join(numbers(stale), "slice", "left_semi"))
        kept = closing.join(numbers([s + 1 for s in stale]), "slice", "left_anti")
        used, closing = start, _settle(kept.unionByName(again), "gate-closing")
    while True:
        start = _settle(started(closing), "gate-start")
        stale = differ(start, used)
        if not stale:
            return start
        runs = _chains(stale, starts, slices, chain)
        table = F.broadcast(lined.sparkSession.createDataFrame([(r[0], s) for r in runs for s in r], "run long, slice long"))
        heads = F.broadcast(lined.sparkSession.createDataFrame([(r[0],) for r in runs], "slice long"))
        memory = start.join(heads, "slice").select(F.col("slice").alias("run"), "slice", F.lit(-1).cast("long").alias("at"), "rule_id", "source", "t", F.lit(0).cast("long").alias("wait"))
        rows = lined.join(table, "slice").select("run", "slice", "at", "rule_id", "source", "t", "wait").unionByName(memory)
        rows = rows.repartition(len(runs), "run").sortWithinPartitions("run", "slice", "at")
        again = _settle(rows.mapInPandas(_chained(cap, memory_us), _MEMORY), "gate-chained")
        done = [s for r in runs for s in r]
        closing = _settle(closing.join(numbers([s + 1 for s in done]), "slice", "left_anti").unionByName(again), "gate-closing")
        # a chain's slices were walked from what the slices before them now hand on
        own = started(closing).join(numbers(done), "slice", "left_semi")
        used = _settle(used.join(numbers(done), "slice", "left_anti").unionByName(own), "gate-used")


def _chains(stale: list[int], starts: list[int], slices: int, chain: int) -> list[list[int]]:
    """Runs of slices to be walked in order, from the first stale slice of each stretch that hands on without a break."""
    out = []
    bounds = [*starts, slices]
    for low, high in zip(bounds, bounds[1:]):
        first = next((s for s in stale if low <= s < high), None)
        if first is not None:
            out.append(list(range(first, min(high, first + chain))))
    return out


def alert_gate(
    hits: DataFrame, *, cap: int = 30, carried: DataFrame | None = None, rows_per_slice: int | None = None, chain_hits: int = CHAIN_HITS
) -> DataFrame:
    """Hits with their status: fired, or suppressed by cooldown or rate_limit."""
    verdicts = gate_verdicts(hits, cap=cap, carried=carried, rows_per_slice=rows_per_slice, chain_hits=chain_hits)
    told = verdicts.select("event_id", F.col("rule_id").alias("_rule"), F.col("source").alias("_source"), "status")
    own = F.col("rule_id").eqNullSafe(F.col("_rule")) & F.col("source").eqNullSafe(F.col("_source"))
    return hits.join(told.withColumnRenamed("event_id", "_event"), (F.col("event_id") == F.col("_event")) & own).drop("_event", "_rule", "_source")


def alert_records(gated: DataFrame) -> DataFrame:
    """Rows of the alert table: suppressed hits once with their reason, fired hits once per channel.

    A rule with neither webhook nor e-mail leaves no row when it fires. Delivery is the caller's, so fired rows
    start as ``pending``.
    """
    suppressed = gated.filter(F.col("status") != FIRED).select(
        "event_id",
        "rule_id",
        "source",
        F.substring("line", 1, 2000).alias("line"),
        "ts",
        "origin",
        F.lit("suppressed").alias("channel"),
        F.lit("suppressed").alias("status"),
        F.col("status").alias("error"),
    )
    channels = F.array(
        F.when(F.coalesce("webhook_url", F.lit("")) != "", F.lit("webhook")),
        F.when(F.coalesce("email_to", F.lit("")) != "", F.lit("email")),
    )
    fired = (
        gated.filter(F.col("status") == FIRED)
        .withColumn("channel", F.explode(F.filter(channels, lambda c: c.isNotNull())))
        .select(
            "event_id",
            "rule_id",
            "source",
            F.substring("line", 1, 2000).alias("line"),
            "ts",
            "origin",
            "channel",
            F.lit("pending").alias("status"),
            F.lit(None).cast("string").alias("error"),
        )
    )
    return suppressed.unionByName(fired)


def received_alert_records(bodies: DataFrame, received_at=None) -> DataFrame:
    """Alert records sent by others (JSON ``body``) in the same shape."""
    body = F.col("body")

    def text(key: str):
        return F.get_json_object(body, f"$.{key}")

    now = F.current_timestamp() if received_at is None else received_at
    at = F.timestamp_micros((text("ts").try_cast("double") * 1_000_000).cast("long"))
    return bodies.select(
        F.lit(None).cast("long").alias("event_id"),
        text("rule_id").alias("rule_id"),
        F.coalesce(text("source"), F.lit("files")).alias("source"),
        F.substring(F.coalesce(text("line"), F.lit("")), 1, 2000).alias("line"),
        F.coalesce(at, now).alias("ts"),
        F.lit("files").alias("origin"),
        F.lit("webhook").alias("channel"),
        F.lit("sent").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )


def record_deliveries(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Alert records with the outcome of their delivery: pending ones become ``sent``, or ``failed`` with the reason.

    outcomes: event_id, rule_id, source, channel, delivered, error; of several attempts one that arrived counts. Records
    without an attempt stay pending, and suppressed ones are never touched.
    """
    key = ["event_id", "rule_id", "source", "channel"]
    tried = outcomes.groupBy(*key).agg(F.max("delivered").alias("_ok"), F.max("error").alias("_why"))
    joined = records.join(tried, key, "left")
    told = (F.col("status") == "pending") & F.col("_ok").isNotNull()
    reason = F.coalesce(F.nullif("_why", F.lit("")), F.concat("channel", F.lit(" delivery failed")))
    status = F.when(told, F.when(F.col("_ok"), "sent").otherwise("failed")).otherwise(F.col("status"))
    error = F.when(told, F.when(~F.col("_ok"), reason)).otherwise(F.col("error"))
    return joined.withColumns({"status": status, "error": error}).select(*records.columns)
