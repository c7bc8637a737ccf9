"""Lookups and set checks as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import fixed
from logquarry.functions.net import ip_number, ipv6_key, is_public, is_public_key
from logquarry.functions.text import any_of
from logquarry.operators.running import computed_once, settled
from logquarry.operators.search import first_rows, list_events, newest

BROADCAST_ROWS = 1_000_000  # ranges up to this many bucket rows, and addresses found, are sent to every executor
HOT_ROWS = 1_000_000  # rows of an address from which on they are not gathered by a shuffle


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``max_rows`` rows; counting stops just beyond the limit."""
    return df.limit(max_rows + 1).count() <= max_rows


# --- geography ---------------------------------------------------------------------------------------------


def _bucketed(ranges: DataFrame, values: list[str]) -> DataFrame:
    """IPv4 ranges repeated once per /16 they touch, so that containment becomes an equi-join plus a filter."""
    buckets = F.sequence(F.shiftright("ip_lo", 16), F.shiftright("ip_hi", 16))
    return ranges.select(F.explode(buckets).alias("_bucket"), "ip_lo", "ip_hi", *values)


def _attach_range(df: DataFrame, ip: str, buckets: DataFrame, values: list[str], prefix: str, how: str = "left") -> DataFrame:
    renamed = buckets.select(
        F.col("_bucket").alias("_rb"),
        F.col("ip_lo").alias("_lo"),
        F.col("ip_hi").alias("_hi"),
        *[F.col(v).alias(prefix + v) for v in values],
    )
    numbered = computed_once(df, "_n", ip_number(F.col(ip)))
    keyed = computed_once(numbered, "_ip", F.when(is_public(F.col("_n")), F.col("_n"))).drop("_n")
    inside = (F.shiftright("_ip", 16) == F.col("_rb")) & F.col("_ip").between(F.col("_lo"), F.col("_hi"))
    return keyed.join(renamed, inside, how).drop("_ip", "_rb", "_lo", "_hi")


def geo_enrich(
    df: DataFrame,
    ranges: DataFrame,
    *,
    addresses: dict[str, str] | None = None,
    values: list[str] | None = None,
    broadcast_ranges: bool | None = None,
    ranges_6: DataFrame | None = None,
) -> DataFrame:
    """Add ``<prefix>_lat``, ``<prefix>_lon``, ``<prefix>_country`` per address column.

    Ranges (ip_lo, ip_hi, …) must not overlap, as in any geo database; only public addresses are looked up.
    Ranges that were counted and found small go to every executor and the input is not shuffled. Otherwise
    only the distinct addresses meet the ranges, and the result is joined back per address: sent to every executor if it
    was found small, otherwise by a shuffle that hot addresses take no part in.

    ``ranges_6`` holds IPv6 ranges, their ends as keys of 32 hex digits (``ipv6_key``). IPv4 addresses in mapped form
    are looked up among the IPv4 ranges.
    """
    addresses = addresses or {"src_ip": "src_", "dst_ip": "dst_"}
    values = values or ["lat", "lon", "country"]
    if {"lat", "lon"} <= set(values):  # a range without a place tells nothing
        ranges = ranges.filter("lat is not null and lon is not null")
        ranges_6 = None if ranges_6 is None else ranges_6.filter("lat is not null and lon is not null")
    df = df.drop(*[p + v for p in addresses.values() for v in values])
    out = _geo_4(df, ranges, addresses, values, broadcast_ranges)
    return out if ranges_6 is None else _geo_6(out, df, ranges_6, addresses, values)


def _counted_addresses(df: DataFrame, addresses: dict[str, str]) -> DataFrame:
    """Each address (_a) with its rows (_n), as a table."""
    every = df.select(F.explode(F.array(*addresses)).alias("_a")).filter("_a is not null")
    return settled(every.groupBy("_a").agg(F.count(F.lit(1)).alias("_n")), "addresses")


def _join_back(df: DataFrame, address: Column, found: DataFrame, counted: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds the values that were found (a table with ``_a``) for an address, under new names; null where there are none.

    Few addresses go to every executor, and the rows stay where they are. Otherwise rows meet their address in a shuffle,
    but for those of addresses with more than ``HOT_ROWS`` rows, of which there are few by that count: one task would
    sort them all.
    """
    one = found.select("_a", *[F.col(v).alias(name) for v, name in names.items()])
    own = address == F.col("_a")
    if fits_broadcast(one):
        return df.join(F.broadcast(one), own, "left").drop("_a")
    hot = F.broadcast(counted.filter(F.col("_n") > HOT_ROWS).select("_a"))
    often = df.join(hot, own, "left_semi").join(F.broadcast(one.join(hot, "_a", "left_semi")), own, "left")
    # rows without an address need no look-up and would all be one key of the join
    rest = df.filter(address.isNotNull()).join(hot, own, "left_anti").join(one.join(hot, "_a", "left_anti"), own, "left")
    both = often.drop("_a").unionByName(rest.drop("_a"))
    return both.unionByName(df.filter(address.isNull()), allowMissingColumns=True)


def _geo_4(df: DataFrame, ranges: DataFrame, addresses: dict[str, str], values: list[str], broadcast_ranges: bool | None) -> DataFrame:
    buckets = _bucketed(ranges, values)
    small = fits_broadcast(buckets) if broadcast_ranges is None else broadcast_ranges
    if small:
        for ip, prefix in addresses.items():
            df = _attach_range(df, ip, F.broadcast(buckets), values, prefix)
        return df
    counted = _counted_addresses(df, addresses)
    found = settled(_attach_range(counted.select("_a"), "_a", buckets, values, "", how="inner"), "geo-found")
    for ip, prefix in addresses.items():
        df = _join_back(df, F.col(ip), found, counted, {v: prefix + v for v in values})
    return df


def _bucketed_6(ranges: DataFrame, values: list[str]) -> DataFrame:
    """Ranges repeated at most 16 times, once per value of the first hex digit in which their ends differ.

    A bucket is a prefix of a range's own length, one digit beyond what its ends have in common, so a range of any width
    has few of them: IPv6 ranges differ in width by a factor of 2^64 and more, and no one prefix length would do.
    """
    lo, hi = F.col("ip_lo"), F.col("ip_hi")
    same = F.aggregate(  # leading digits that the ends have in common, up to 31
        F.sequence(F.lit(1), F.lit(31)), F.lit(0), lambda n, k: F.when((n == k - 1) & (lo.substr(F.lit(1), k) == hi.substr(F.lit(1), k)), k).otherwise(n)
    )
    with_length = ranges.withColumn("_len", same + 1)

    def digit(end: Column) -> Column:
        return F.conv(end.substr(F.col("_len"), F.lit(1)), 16, 10).cast("int")

    digits = F.sequence(digit(lo), digit(hi))
    prefix = F.transform(digits, lambda d: F.concat(lo.substr(F.lit(1), F.col("_len") - 1), F.lower(F.hex(d))))
    return with_length.select("_len", F.explode(prefix).alias("_prefix"), "ip_lo", "ip_hi", *values)


def _geo_6(df: DataFrame, given: DataFrame, ranges: DataFrame, addresses: dict[str, str], values: list[str]) -> DataFrame:
    """Fills in the values of IPv6 addresses. Only distinct addresses meet the ranges: an address has one prefix for each
    prefix length that the ranges use, so the join is one of equal prefixes, with the ends checked after it. ``given``
    holds the rows as they were before the IPv4 look-up, which reading the addresses does not need."""
    buckets = _bucketed_6(ranges, values)
    lengths = sorted(r[0] for r in buckets.select("_len").distinct().collect())  # 32 at most
    six = {ip: F.when(F.col(ip).contains(":"), F.col(ip)) for ip in addresses}
    counted = _counted_addresses(given.select(*[a.alias(ip) for ip, a in six.items()]), addresses)
    keyed = computed_once(counted.select("_a"), "_key", ipv6_key(F.col("_a"))).filter(is_public_key(F.col("_key")))
    prefixes = F.array(*(F.substring("_key", 1, n) for n in lengths)) if lengths else F.array().cast("array<string>")
    each = keyed.select("_a", "_key", F.explode(prefixes).alias("_prefix"))
    found = each.join(buckets.drop("_len"), "_prefix").filter(F.col("_key").between(F.col("ip_lo"), F.col("ip_hi")))
    found = settled(found.select("_a", *values), "geo-found")
    for ip, prefix in addresses.items():
        df = _join_back(df, six[ip], found, counted, {v: f"_six_{v}" for v in values})
        df = df.withColumns({prefix + v: F.coalesce(prefix + v, f"_six_{v}") for v in values}).drop(*(f"_six_{v}" for v in values))
    return df


def with_asn_label(asn: DataFrame) -> DataFrame:
    """``asn`` text of a range table with number and organisation."""
    number, org = F.col("asn_number"), F.col("asn_org")
    tag = F.concat(F.lit("AS"), number.cast("string"))
    text = F.when(number.isNotNull() & org.isNotNull(), F.concat(tag, F.lit(" "), org))
    return asn.withColumn("asn", F.coalesce(text, tag, org, F.lit("")))


# --- set checks --------------------------------------------------------------------------------------------


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key by ``order``; partial aggregation makes repeated keys cheap."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("_row")).select("_row.*")


def dedup_new_events(events: DataFrame, stored_keys: DataFrame, *, key: str = "parser", order: str = "seq") -> DataFrame:
    """Events whose key is not stored yet, the first of each key only."""
    return first_per_key(events, key, order).join(stored_keys.select(key), key, "left_anti").select(*events.columns)


def merge_archive_flows(live: DataFrame, archive: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Live edges, then archive edges of pairs not seen live, larger counts first; cut if a limit is named."""
    fresh = archive.join(live.select("src_ip", "dst_ip"), ["src_ip", "dst_ip"], "left_anti")
    both = live.withColumn("archived", F.lit(0)).unionByName(fresh.withColumn("archived", F.lit(1)), allowMissingColumns=True)
    return first_rows(both.orderBy("archived", F.desc("cnt"), "src_ip", "dst_ip"), limit)


def new_and_gone_sources(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """Sources that appeared or vanished between two listings: one grouped pass over both."""
    both = before.select(key, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(key, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    sides = both.groupBy(key).agg(F.max("b").alias("b"), F.max("a").alias("a")).filter("a <> b")
    return sides.select(key, F.when(F.col("a") == 1, "new").otherwise("gone").alias("change"))


def events_by_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events of an id list; unknown ids are ignored."""
    return events.join(ids.select("id"), "id", "left_semi")


def newest_cloud_ids(events: DataFrame, *, since: Column | None = None, limit: int | None = None) -> DataFrame:
    return list_events(events, since=since, source_type="mist", limit=limit).select("id")


def related_events(events: DataFrame, event_id: int, *, limit: int = 30) -> DataFrame:
    """Newest other events that share an address or MAC with one event, else its neighbours in time."""
    row = events.filter(F.col("id") == event_id).first()
    if row is None:
        return events.limit(0)
    event = row.asDict()
    import re

    macs = re.findall(f"({fixed.MAC_TOKEN})", event.get("message") or "")
    named = [event.get(c) for c in ("remote_ip", "src_ip", "dst_ip", "syslog_host")]
    needles = list(dict.fromkeys([n for n in named if n] + macs))[:8]
    if not needles:
        hour = F.expr("INTERVAL 1 HOUR")
        at = F.lit(event["received_at"])
        return list_events(events, since=at - hour, until=at + hour, source_type=event["source_type"], limit=limit)
    texts = [F.col(c) for c in ("message", "raw") if c in events.columns]
    exact = [F.col(c) for c in ("remote_ip", "src_ip", "dst_ip") if c in events.columns]
    tests = [F.lower(t).contains(n.lower()) for n in needles for t in texts] + [e.isin(needles) for e in exact]
    found = F.coalesce(any_of([F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))
    return newest(events.filter((F.col("id") != event_id) & found), "received_at", limit)


def mark_analyzed(events: DataFrame, analyses: DataFrame) -> DataFrame:
    """Write the latest successful verdict onto the events it covered (analyses: id, log_ids, severity, summary, …)."""
    verdicts = (
        analyses.filter("error is null")
        .select(
            F.explode("log_ids").alias("id"),
            F.struct("severity", F.substring("summary", 1, 500).alias("summary"), F.col("id").alias("aid"), "created_at").alias("v"),
        )
        .groupBy("id")
        .agg(F.max_by("v", F.col("v.aid")).alias("v"))
    )
    fresh = {
        "llm_severity": F.col("v.severity"),
        "llm_summary": F.col("v.summary"),
        "analysis_id": F.col("v.aid"),
        "analyzed_at": F.col("v.created_at"),
    }
    joined = events.join(verdicts, "id", "left")
    for name, value in fresh.items():
        old = F.col(name) if name in events.columns else F.lit(None)
        joined = joined.withColumn(name, F.coalesce(value, old))
    return joined.drop("v")


def schedule_job_status(schedules: DataFrame, jobs: DataFrame) -> DataFrame:
    """Schedules with the outcome of their last job; a running or missing job leaves them as they are.

    schedules: id, last_job_id, last_status, last_error. jobs: job_id, status, error.
    """
    joined = schedules.join(jobs, schedules["last_job_id"] == jobs["job_id"], "left")
    failed = F.col("status").isin("error", "failed")
    status = F.when(F.col("status") == "done", "done").when(failed, "error").when(F.col("status") == "cancelled", "cancelled")
    error = (
        F.when(F.col("status") == "done", "")
        .when(failed, F.coalesce(F.nullif("error", F.lit("")), F.lit(fixed.JOB_FAILED)))
        .when(F.col("status") == "cancelled", "cancelled")
    )
    return joined.select(
        schedules["id"],
        "last_job_id",
        F.coalesce(status, "last_status").alias("last_status"),
        F.coalesce(error, "last_error").alias("last_error"),
    )


def schedule_alert_decision(results: DataFrame) -> DataFrame:
    """Whether a scheduled analysis alerts (severity, anomalies, alert_on_anomalies, min_severity).

    The verdict is judged as the words of a line, so only level words raise it; low and medium floors act as
    warning.
    """
    from logquarry.functions.severity import classify_severity, severity_rank

    floor = F.lower(F.coalesce("min_severity", F.lit("warning")))
    floor = F.when(floor.isin(fixed.SEVERITY_FLOORS), floor).otherwise("warning")
    line = F.concat(F.lit("severity-"), F.lower(F.coalesce("severity", F.lit("info"))), F.lit(" event"))
    loud = severity_rank(classify_severity(line)) >= severity_rank(floor)
    flagged = F.col("alert_on_anomalies") & (F.coalesce(F.size("anomalies"), F.lit(0)) > 0)
    return results.withColumn("should_alert", F.coalesce(flagged, F.lit(False)) | loud)
