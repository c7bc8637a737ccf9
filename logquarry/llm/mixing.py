"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Each source gets a target: its share by weight of all words, at most ``cap`` times its own size, the excess reshared
by weight. Its documents, in an order fixed by a digest of their ids, are read again and again until the target is
reached; the last document may be taken in part, so a source's words meet the target exactly. A source's weight also
varies over training time: its schedule is a piecewise linear curve, integrated segment by segment, and the source's
cumulative word demand is put through the inverse of that integral. This yields each copy's training position in
[0, 1), by which copies are range-sorted.

No source is ever gathered: running sums are taken within about sqrt(n) digest ranges of a source and over the ranges'
totals, so both windows hold about sqrt(n) rows however hot the source is.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, sorted
last; if all sizes are zero, all targets are zero; rows that repeat a ``doc_id`` are separate documents; an empty
table gives an empty result; other columns are ignored (``plan``) or kept beside the copy's columns (``mix``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.llm.common import WORD, computed, located, written

WEIGHTS = (5.0, 2.0, 1.0)  # by rank of the source, repeating
CAP = 3.0
#: Schedule by weight: (time, relative weight) corners. Heavy sources lead the training, light ones close it.
CURVES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.75), (0.5, 1.5), (1.0, 0.75)), ((0.0, 0.5), (0.6, 0.5), (1.0, 2.0)))
DIGITS = 13  # hex digits of the digest that place a document within its source


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _segments(corners) -> list[tuple[float, float, float, float, float, float]]:
    """(start, end, weight at start, weight at end, integral before, integral after) per segment, the whole being 1."""
    pieces = list(zip(corners, corners[1:]))
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pieces)
    out, done = [], 0.0
    for a, b in pieces:
        more = (b[0] - a[0]) * (a[1] + b[1]) / 2 / whole
        out.append((a[0], b[0], a[1] / whole, b[1] / whole, done, done + more))
        done += more
    return out


def _curve(corners) -> Column:
    names = ("t0", "t1", "w0", "w1", "before", "after")
    return F.array(*(F.struct(*(F.lit(float(x)).alias(n) for n, x in zip(names, piece))) for piece in _segments(corners)))


def when_reached(demand: Column, curve: Column) -> Column:
    """The time at which the integral of the curve reaches ``demand`` (a fraction of the whole)."""
    found = F.coalesce(F.element_at(F.filter(curve, lambda s: demand < s["after"]), 1), F.element_at(curve, -1))

    def solve(s: Column) -> Column:
        rest = demand - s["before"]
        slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
        root = s["w0"] + F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * slope * rest))
        return F.least(s["t1"], s["t0"] + F.when(root > 0, 2 * rest / root).otherwise(0.0))

    return F.element_at(F.transform(F.array(found), solve), 1)


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, curves=CURVES) -> DataFrame:
    """One row per source: source, n, source_size, weight, target, curve. ``sizes`` has source and size.

    Sources are capped in the order of cap / weight; a source is capped if its weight's share of what the sources
    before it left would exceed its cap. One window over one row per source decides all of them.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    pick = lambda values: F.element_at(F.array(*values), (rank % len(values) + 1).cast("int"))
    ranked = totals.withColumn("weight", pick([F.lit(float(w)) for w in weights])).withColumn("curve", pick([_curve(c) for c in curves]))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    rest_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    spent = F.coalesce(F.sum(F.col("source_size") * cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("source_size").over(Window.partitionBy())
    level = ranked.withColumn("level", (whole - spent) / rest_weight).withColumn("limit", F.col("source_size") * cap)
    free = F.col("limit") > F.col("level") * F.col("weight")
    # beyond the first source that stays below its cap the level no longer changes
    first_free = F.first(F.when(free, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(first_free.isNull(), F.col("limit")).otherwise(first_free * F.col("weight"))
    return level.select("source", "n", "source_size", "weight", F.least(target, "limit").alias("target"), "curve")


def plan(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, curves=CURVES, row: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, position (of the first copy), and the
    order columns source, place, lead (words of its source's round before it).

    ``row`` names columns that tell each row for good; they are carried along and order rows alike in id and size."""
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    fields = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": words_in(F.col("text")), "place": place}
    sized = written(computed(docs, fields | {name: F.col(name) for name in row}), "sizes")
    goals = written(targets(sized, weights, cap, curves).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "targets")
    share = F.conv(F.substring("place", 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)
    ranged = sized.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).join(goals.select("key", "n"), "key")
    ranged = ranged.withColumn("slot", F.floor(share * F.ceil(F.sqrt("n"))))
    slots = ranged.groupBy("key", "slot").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = written(slots.select("key", "slot", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before")), "slots")
    within = Window.partitionBy("key", "slot").orderBy("place", F.desc("size"), *row).rowsBetween(Window.unboundedPreceding, -1)
    led = ranged.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    led = led.join(slots, ["key", "slot"]).withColumn("lead", F.col("before") + F.col("inner"))
    led = led.join(goals.select("key", "source_size", "target", "curve"), "key")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    over = F.floor(F.col("target") - rounds * F.col("source_size")) - F.col("lead")
    part = F.least(F.greatest(over, F.lit(0)), F.col("size"))
    led = led.withColumn("taken", (rounds * F.col("size") + part).cast("long"))
    led = led.withColumn("copies", F.when(F.col("taken") > 0, rounds + (part > 0).cast("long")).otherwise(0).cast("int"))
    first = F.when(F.col("taken") > 0, when_reached(F.col("lead") / F.col("target"), F.col("curve")))
    return led.withColumn("position", first)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position (rounded); sorted by it, documents not taken last."""
    position = F.round("position", 9).alias("position")
    rows = plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", position, "place")
    return rows.orderBy(F.asc_nulls_last("position"), "place").drop("place")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training sequence: one row per copy taken, with the document's columns and mix_copy, mix_words,
    mix_position, range-sorted by position. A copy of fewer words than the document ends its source's stream.

    Rows are matched by their place in their files, so rows without an id and rows that share one are all mixed, and no
    copy of the texts is made. A document's own column of one of the three names gives way to the copy's."""
    placed, row = located(docs)
    led = plan(placed, **options, row=row).filter("taken > 0")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("mix_copy")
    each = led.select(*row, "size", "source_size", "target", "taken", "lead", "curve", copy)
    words = F.least(F.col("size"), F.col("taken") - F.col("mix_copy") * F.col("size"))
    demand = (F.col("mix_copy") * F.col("source_size") + F.col("lead")) / F.col("target")
    each = each.select(*row, "mix_copy", words.alias("mix_words"), when_reached(demand, F.col("curve")).alias("mix_position"))
    each = written(each, "copies")
    own = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_words", "mix_position")]
    copies = placed.select(*own, *row).join(each, row).drop(*row)
    return copies.repartitionByRange("mix_position", "doc_id").sortWithinPartitions("mix_position", "doc_id")
