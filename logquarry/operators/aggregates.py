"""Grouped counts: flows, windows, trends and coverage. All are partial-then-final hash aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions import fixed
from logquarry.operators.joins import geo_enrich
from logquarry.operators.search import allowed_flows, between, source_group

GEO = ["lat", "lon", "country"]


def _edges(df: DataFrame, extra: list[Column]) -> DataFrame:
    geo = [side + name for side in ("src_", "dst_") for name in GEO if side + name in df.columns]
    grouped = df.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("cnt"), *extra, *[F.max(c).alias(c) for c in geo])
    return grouped.filter("src_lat is not null and dst_lat is not null")


def _top_edges(edges: DataFrame, limit: int | None) -> DataFrame:
    return edges if limit is None else edges.orderBy(F.desc("cnt"), "src_ip", "dst_ip").limit(limit)


def flow_aggregates(
    events: DataFrame, *, since: Column | None = None, until: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Edges by address pair with both coordinates known, the largest first."""
    at = F.coalesce(*[c for c in ("event_ts", "received_at") if c in events.columns])
    df = events.filter("src_ip is not null and dst_ip is not null")
    if since is not None:
        df = df.filter(at >= since)
    if until is not None:
        df = df.filter(at <= until)
    return _top_edges(_edges(df, []), limit)


def archive_flow_aggregates(flows: DataFrame, *, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """The same over archived flows, with bytes."""
    total = F.sum(F.coalesce("bytes", F.lit(0))).alias("sum_bytes")
    return _top_edges(_edges(between(flows, "ts", since), [total]), limit)


def flow_map_points(events: DataFrame, ranges: DataFrame, *, since: Column | None = None) -> DataFrame:
    """Allowed flows per destination. Geography is looked up after the aggregation, once per destination."""
    counts = allowed_flows(between(events, "received_at", since)).groupBy("flow_dst").agg(F.count(F.lit(1)).alias("flows"))
    points = geo_enrich(counts.withColumnRenamed("flow_dst", "dst_ip"), ranges, addresses={"dst_ip": ""})
    return points.filter("lat is not null")


def count_events(events: DataFrame, *, since: Column | None = None) -> DataFrame:
    """Per source type: all events and those since a time; the null row is the total."""
    recent = F.lit(True) if since is None else F.col("received_at") >= since
    aggregates = [F.count(F.lit(1)).alias("events"), F.count_if(recent).alias("recent")]
    by_type = events.groupBy("source_type").agg(*aggregates)
    total = by_type.agg(F.sum("events").alias("events"), F.sum("recent").alias("recent"))
    return by_type.unionByName(total.withColumn("source_type", F.lit(None).cast("string")))


def window_counts(events: DataFrame, analyses: DataFrame, since: Column, until: Column) -> DataFrame:
    """Raw events, un-analysed events and analyses in a closed window, as one row."""
    pending = F.col("analyzed_at").isNull() if "analyzed_at" in events.columns else F.lit(True)
    raw = between(events, "received_at", since, until).select(
        F.lit(1).alias("raw"), pending.cast("int").alias("pending"), F.lit(0).alias("analysis")
    )
    done = between(analyses, "created_at", since, until).select(
        F.lit(0).alias("raw"), F.lit(0).alias("pending"), F.lit(1).alias("analysis")
    )
    both = raw.unionByName(done)
    sums = {"raw": "raw_in_window", "pending": "pending_in_window", "analysis": "analyses_in_window"}
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in sums.items()])


# --- analyses ----------------------------------------------------------------------------------------------


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def anomaly_count(df: DataFrame) -> Column:
    if "anomalies" in df.columns:
        return F.coalesce(F.size("anomalies"), F.lit(0))
    return F.coalesce(F.json_array_length("anomalies_json"), F.lit(0))


def _analysis_sums(df: DataFrame) -> dict[str, Column]:
    ok = F.col("error").isNull()
    level = F.lower("severity")
    return {
        "analyses_total": F.count(F.lit(1)),
        "ok_total": F.count_if(ok),
        "err_total": F.count_if(~ok),
        "sev_high": F.count_if(ok & (level == "high")),
        "sev_critical": F.count_if(ok & (level == "critical")),
        "elevated_total": F.count_if(ok & level.isin("high", "critical")),
        "anomalies_total": F.coalesce(F.sum(F.when(ok, anomaly_count(df))), F.lit(0)),
    }


def analysis_coverage(analyses: DataFrame) -> DataFrame:
    """Distinct days, oldest and newest day among error-free analyses.

    Days are grouped first, so the distinct count runs over days and not over analyses.
    """
    days = analyses.filter("error is null").groupBy(day_of(F.col("created_at")).alias("day")).agg(F.lit(1))
    return days.agg(
        F.count("day").alias("distinct_days"), F.min("day").alias("oldest_day"), F.max("day").alias("newest_day")
    )


def analysis_window_stats(analyses: DataFrame, since: Column, until: Column) -> DataFrame:
    df = between(analyses, "created_at", since, until)
    return df.agg(*[c.alias(n) for n, c in _analysis_sums(df).items()])


def daily_trend(analyses: DataFrame, today: Column, *, lookback_days: int = 42) -> DataFrame:
    """Per day sums from ``lookback_days`` days before today on."""
    days = max(1, lookback_days)
    df = analyses.filter(F.col("created_at") >= F.date_sub(today, days).cast("timestamp"))
    sums = {n: c for n, c in _analysis_sums(df).items() if not n.startswith("sev_")}
    return df.groupBy(day_of(F.col("created_at")).alias("day")).agg(*[c.alias(n) for n, c in sums.items()])


TREND_SUMS = ["analyses_total", "ok_total", "err_total", "elevated_total", "anomalies_total"]


def weekly_trend(daily: DataFrame) -> DataFrame:
    """Daily rows summed into ISO weeks."""
    day = F.col("day").cast("date")
    year, week = F.extract(F.lit("yearofweek"), day), F.weekofyear(day)
    grouped = daily.groupBy(
        year.alias("iso_year"),
        week.alias("iso_week"),
        F.date_format(F.date_trunc("week", day), "yyyy-MM-dd").alias("week_start"),
    ).agg(*[F.sum(c).alias(c) for c in TREND_SUMS])
    return grouped.withColumn("week_label", F.format_string("%d-W%02d", "iso_year", "iso_week"))


def dense_days(daily: DataFrame, today: Column, *, lookback_days: int = 42) -> DataFrame:
    """Every one of the last ``lookback_days`` days, zeros where nothing happened."""
    spark = daily.sparkSession
    calendar = spark.range(1).select(
        F.explode(F.sequence(F.date_sub(today, lookback_days - 1), today)).alias("d")
    )
    days = calendar.select(day_of(F.col("d").cast("timestamp")).alias("day"))
    joined = days.join(daily, "day", "left")
    return joined.select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in TREND_SUMS])


def trend_delta(buckets: DataFrame, order: str, label: str) -> DataFrame:
    """Last non-empty bucket against the one before it, with a sentence; the sentence is null with one bucket.

    Trend rows are at most one per day of the look-back, so the unpartitioned window stays tiny.
    """
    pair = buckets.filter("analyses_total > 0").orderBy(F.desc(order)).limit(2)
    back = Window.orderBy(order)
    names = fixed.TREND_CHANGES
    deltas = [(F.col(c) - F.lag(c).over(back)).alias(f"{c}_delta") for c in names]
    newest = pair.select(F.lag(order).over(back).alias("previous"), F.col(order).alias("latest"), *deltas)
    newest = newest.orderBy(F.desc("latest")).limit(1)

    def part(column: str, text: str) -> Column:
        d = F.col(f"{column}_delta")
        return F.when(d != 0, F.concat(F.lit(f"{text} "), F.when(d > 0, "+").otherwise(""), d.cast("string")))

    changes = F.concat_ws(", ", *[part(c, t) for c, t in names.items()])
    same = fixed.TREND_SAME.format(label)
    sentence = (
        F.when(F.col("previous").isNull(), None)
        .when(changes == "", same)
        .otherwise(F.concat(F.lit(fixed.TREND_BEFORE.format(label)), changes, F.lit(".")))
    )
    return newest.withColumn("sentence", sentence)


def trend_scale(buckets: DataFrame) -> DataFrame:
    """The largest value a chart of the buckets must hold, at least 1."""
    per_row = F.greatest(
        "analyses_total",
        F.col("ok_total") + F.col("err_total"),
        "elevated_total",
        F.floor(F.col("anomalies_total") / 3),
        F.lit(1),
    )
    return buckets.agg(F.coalesce(F.max(per_row), F.lit(1)).cast("long").alias("scale"))


def baseline_level(coverage: DataFrame) -> DataFrame:
    """How much history there is."""
    days = F.col("distinct_days")
    level = F.when((days <= 0) | F.col("oldest_day").isNull(), fixed.BASELINE_EMPTY)
    for limit, name in fixed.BASELINE_STEPS:
        level = level.when(days < limit, name)
    return coverage.withColumn("level", level.otherwise(fixed.BASELINE_STEADY))


def summary_attempts(summaries: DataFrame) -> DataFrame:
    """Latest success and latest attempt per granularity."""
    return summaries.groupBy("granularity").agg(
        F.max(F.when(F.col("error").isNull(), F.col("created_at"))).alias("last_ok"), F.max("created_at").alias("last_any")
    )


# --- inventory and counters --------------------------------------------------------------------------------


def group_sizes(files: DataFrame, root: str) -> DataFrame:
    """Files and bytes per source group."""
    grouped = files.withColumn("label", source_group(F.col("path"), root)).filter("label is not null")
    return grouped.groupBy("label").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def ingest_counters(events: DataFrame, dimensions: list[str], *, dropped: DataFrame | None = None, alerts: DataFrame | None = None) -> DataFrame:
    """Counts per value of several dimensions in one pass: each row is counted once per dimension.

    ``dropped`` rows are counted by their ``reason`` (dimension ``drop_reason``), delivered ``alerts`` by their ``origin``
    (``alert_origin``), and the events stored now are a gauge (``stored``). Each kind is summed where it is read.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    counted = events.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("total"))
    for rows, dimension, column in ((dropped, "drop_reason", "reason"), (None if alerts is None else alerts.filter("status = 'sent'"), "alert_origin", "origin")):
        if rows is not None:
            more = rows.groupBy(F.lit(dimension).alias("dimension"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("total"))
            counted = counted.unionByName(more)
    if dropped is not None or alerts is not None:
        counted = counted.unionByName(events.agg(F.lit("stored").alias("dimension"), F.lit(None).cast("string").alias("value"), F.count(F.lit(1)).alias("total")))
    return counted


def drop_reasons(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Received messages (id, raw) that are not among the stored events, with the reason: ``unparseable`` if nothing but
    blanks is left of them, else ``exception``."""
    missing = raw.join(stored.select("id"), "id", "left_anti")
    blank = F.coalesce(F.length(F.trim("raw")) == 0, F.lit(True))
    return missing.withColumn("reason", F.when(blank, "unparseable").otherwise("exception"))


def data_presence(events: DataFrame, analyses: DataFrame, summaries: DataFrame) -> DataFrame:
    """Which kinds of data exist, as one row of flags. Each kind is looked for until its first row."""
    kinds = {
        "firewall": events.filter("source_type = 'palo_alto'"),
        "flows": events.filter("src_ip is not null and dst_ip is not null"),
        "cloud": events.filter("source_type = 'mist'"),
        "analyses": analyses,
        "summaries": summaries.filter("error is null"),
    }
    found = [rows.select(F.lit(kind).alias("kind")).limit(1) for kind, rows in kinds.items()]
    seen = found[0]
    for part in found[1:]:
        seen = seen.unionByName(part)
    return seen.agg(*[F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False)).alias(kind) for kind in kinds])


def oldest_line_ts(lines: DataFrame) -> DataFrame:
    """Oldest timestamp per source (``ts`` must be present)."""
    return lines.filter("ts is not null").groupBy("source").agg(F.min("ts").alias("oldest_ts"))


def ingest_rate(
    events: DataFrame, by: list[str], *, width: str = "5 minutes", slide: str | None = None, alerts: DataFrame | None = None
) -> DataFrame:
    """Events per time window and dimension; works on tables and on watermarked streams.

    With ``alerts`` (ts, origin) the alerts of each window are counted beside them, by origin: rows of another ``kind``,
    whose dimensions are empty. Both inputs may be streams with watermarks of their own.
    """

    def counted(rows: DataFrame, at: str, names: list[str]) -> DataFrame:
        window = F.window(at, width, slide) if slide else F.window(at, width)
        return rows.groupBy(window.alias("w"), *names).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *names, "events")

    own = counted(events, "received_at", by)
    if alerts is None:
        return own
    text = F.lit(None).cast("string")
    left = own.select(F.lit("events").alias("kind"), "window_start", "window_end", *by, text.alias("origin"), "events")
    right = counted(alerts, "ts", ["origin"])
    return left.unionByName(right.select(F.lit("alerts").alias("kind"), "window_start", "window_end", *(text.alias(c) for c in by), "origin", "events"))
