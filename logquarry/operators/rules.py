"""Rule tables compiled to column expressions.

Alert rules, saved searches, columnizers and timestamp rules are configuration: a person wrote each of them.
They are read once on the driver and become one predicate each, so matching is a map over the events with no
join, no shuffle and no per-pair interpretation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from logquarry.functions import severity, syslog
from logquarry.functions.text import basename, glob_matches, query_predicate
from logquarry.functions.times import line_timestamp, pattern_timestamp

RULES_PER_ARRAY = 200  # predicates per array; more rules take more arrays in the same projection


def latest_by_key(table: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row per key (insert-or-update): a partial aggregate, no window."""
    whole = F.struct(*table.columns)
    return table.groupBy(key).agg(F.max_by(whole, F.col(version)).alias("_row")).select("_row.*")


def upsert_by_key(current: DataFrame, changes: DataFrame, key: str, version: str, *, keep: list[str] | None = None) -> DataFrame:
    """Table after applying changes: a change wins over the stored row whatever its version, the newest change over
    the others. Columns in ``keep`` stay as first inserted when the key exists."""
    sided = current.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    merged = sided.withColumn("_order", F.struct("_side", version))
    columns = [c for c in sided.columns if c != "_side"]
    newest = latest_by_key(merged, key, "_order").select(*columns)
    if not keep:
        return newest
    firsts = merged.groupBy(key).agg(*[F.min_by(c, "_order").alias(c) for c in keep])
    return newest.drop(*keep).join(firsts, key).select(*columns)


def delete_by_key(table: DataFrame, key: str, gone: list[str]) -> DataFrame:
    return table.filter(~F.col(key).isin(gone))


def active_rules(rules: DataFrame) -> list[Row]:
    """Enabled current rules in name order."""
    current = latest_by_key(rules, "id", "updated_at") if "updated_at" in rules.columns else rules
    return sorted(current.filter("enabled").collect(), key=lambda r: (r["name"], r["id"]))


def _value(rule: Row, name: str):
    return rule[name] if name in rule.__fields__ else None


def _hit(rule: Row) -> Column:
    cooldown = _value(rule, "cooldown_sec")
    return F.struct(
        F.lit(rule["id"]).alias("rule_id"),
        F.lit(rule["name"]).alias("rule_name"),
        F.lit(300 if cooldown is None else int(cooldown)).alias("cooldown_sec"),
        F.lit(_value(rule, "webhook_url")).cast("string").alias("webhook_url"),
        F.lit(_value(rule, "email_to")).cast("string").alias("email_to"),
    )


def _explode_hits(df: DataFrame, rules: list[tuple[Row, Column]]) -> DataFrame:
    """One row per (input row, matching rule): one scan however many rules there are."""
    if rules:
        marks = []
        for start in range(0, len(rules), RULES_PER_ARRAY):
            batch = rules[start : start + RULES_PER_ARRAY]
            marks.append(F.filter(F.array(*[F.when(predicate, _hit(rule)) for rule, predicate in batch]), lambda m: m.isNotNull()))
        hits = F.concat(*marks) if len(marks) > 1 else marks[0]
    else:
        hits = F.expr(
            "cast(array() as array<struct<rule_id:string,rule_name:string,cooldown_sec:int,"
            "webhook_url:string,email_to:string>>)"
        )
    return df.withColumn("_hit", F.explode(hits)).select("*", "_hit.*").drop("_hit")


def match_alert_rules(events: DataFrame, rules: list[Row]) -> DataFrame:
    """Event hits. Rules bound to a path are for lines and are skipped; ``scope`` does not apply to events."""
    compiled = []
    for rule in rules:
        if _value(rule, "log_dir") or _value(rule, "file_glob"):
            continue
        predicate = query_predicate("line", rule["query"], rule["mode"])
        wanted = _value(rule, "source_type")
        compiled.append((rule, predicate & (F.col("source_type") == wanted) if wanted else predicate))
    shaped = events.select(
        F.col("id").alias("event_id"),
        F.coalesce(F.nullif("message", F.lit("")), F.col("raw") if "raw" in events.columns else F.lit(None), F.lit("")).alias("line"),
        "source_type",
        F.concat_ws(":", "source_type", "remote_ip").alias("source"),
        F.col("received_at").alias("ts"),
        F.lit("hub").alias("origin"),
    )
    return _explode_hits(shaped, compiled).drop("source_type")


def match_line_rules(lines: DataFrame, rules: list[Row]) -> DataFrame:
    """Line hits: root prefix, file glob, failure scope and query. ``source_type`` does not apply to lines."""
    compiled = []
    for rule in rules:
        predicate = query_predicate("line", rule["query"], rule["mode"])
        if _value(rule, "scope") == "failures_only":
            predicate = severity.is_failure(F.col("line")) & predicate
        if _value(rule, "file_glob"):
            predicate = glob_matches(basename(F.col("source")), rule["file_glob"]) & predicate
        if _value(rule, "log_dir"):
            predicate = F.col("source").startswith(rule["log_dir"]) & predicate
        compiled.append((rule, predicate))
    ts = F.coalesce("ts", "received_at") if "ts" in lines.columns else F.col("received_at")
    shaped = lines.select(F.col("id").alias("event_id"), "line", "source", ts.alias("ts"), F.lit("files").alias("origin"))
    return _explode_hits(shaped, compiled)


def saved_search_hits(lines: DataFrame, searches: list[Row]) -> DataFrame:
    """Every saved search over the lines in its scope, in one pass."""
    compiled = []
    for search in searches:
        predicate = query_predicate("line", search["query"], search["mode"])
        if _value(search, "log_dir"):
            predicate = F.col("source").startswith(search["log_dir"].rstrip("/") + "/") & predicate
        if _value(search, "file_path"):
            predicate = (F.col("source") == search["file_path"]) & predicate
        compiled.append((search, predicate))
    shaped = lines.filter(F.length("line") > 0).withColumnRenamed("id", "event_id")
    hits = _explode_hits(shaped, compiled)
    return hits.withColumnsRenamed({"rule_id": "search_id", "rule_name": "search_name"}).drop(
        "cooldown_sec", "webhook_url", "email_to"
    )


# --- rules chosen by file name -----------------------------------------------------------------------------


def by_priority(rules: list[dict]) -> list[dict]:
    return sorted((r for r in rules if r.get("enabled", True)), key=lambda r: -int(r.get("priority", 0)))


def resolved_rule(source: Column, rules: list[dict]) -> Column:
    """Id of the first enabled rule, by priority, whose glob matches the file name."""
    chain = [F.when(glob_matches(basename(source), r.get("file_glob")), F.lit(r["id"])) for r in by_priority(rules)]
    return F.coalesce(*chain, F.lit(None).cast("string"))


def resolve_file_rules(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per source with the rule that applies to it."""
    return lines.select("source").distinct().withColumn("rule_id", resolved_rule(F.col("source"), rules))


def _columnized(line: Column, rule: dict) -> Column:
    config = rule.get("config") or {}
    if rule.get("type") == "syslog":
        return syslog.syslog_map(line)
    if rule.get("type") == "csv":
        return syslog.csv_map(line, config.get("delimiter", ","), config.get("quote", '"'))
    if rule.get("type") == "regex":
        return syslog.regex_map(line, config.get("pattern", ""))
    return F.create_map(F.lit("line"), line)


def _per_rule(source: Column, rules: list[dict], value) -> Column:
    """``value(rule)`` of the rule that applies to a source, null without one. Names are matched in the
    projection: that costs a few short regular expressions per row and no shuffle of the lines."""
    result = None
    for rule in by_priority(rules):
        test = glob_matches(basename(source), rule.get("file_glob"))
        result = F.when(test, value(rule)) if result is None else result.when(test, value(rule))
    return result


def apply_columnizers(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """Add ``columns`` (name to text) using the columnizer of each file; null where none applies."""
    value = _per_rule(F.col("source"), rules, lambda r: _columnized(F.col("line"), r))
    return lines.withColumn("columns", F.lit(None).cast("map<string,string>") if value is None else value)


def _rule_timestamp(line: Column, rule: dict) -> Column:
    from logquarry.functions import fixed

    config = rule.get("config") or {}
    default = config.get("time_default", "00:00:00")
    if rule.get("type", "regex") == "regex":
        return pattern_timestamp(
            line,
            config.get("pattern", ""),
            config.get("date_group", "event_date"),
            config.get("time_group", "event_time"),
            default,
        )
    clock = F.nullif(F.regexp_extract(line, fixed.BRACKETED_DATE, 2), F.lit(""))
    text = F.concat_ws(
        " ", F.regexp_extract(line, fixed.BRACKETED_DATE, 1), F.substring_index(F.coalesce(clock, F.lit(default)), ".", 1)
    )
    return F.when(line.rlike(fixed.BRACKETED_DATE), text.try_cast("timestamp"))


def parse_custom_timestamps(lines: DataFrame, rules: list[dict], *, year: int | None = None) -> DataFrame:
    """``ts`` by the file's timestamp rule, else by the leading timestamp."""
    value = _per_rule(F.col("source"), rules, lambda r: _rule_timestamp(F.col("line"), r))
    default = line_timestamp(F.col("line"), year)
    return lines.withColumn("ts", default if value is None else F.coalesce(value, default))
