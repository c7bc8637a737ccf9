"""Model-assisted analysis as Spark jobs. The model itself is a function the caller supplies."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from logquarry.functions import fixed
from logquarry.functions.severity import is_low_level
from logquarry.functions.text import cut, ellipsize, strip
from logquarry.operators.aggregates import analysis_window_stats, anomaly_count
from logquarry.operators.packing import estimate_tokens
from logquarry.operators.ranking import recent_summaries, window_analyses
from logquarry.operators.running import computed_once, running_rank, running_sum
from logquarry.operators.search import between, with_blocked
from logquarry.session import small_batches

BATCH_SOURCE_TYPES = ["palo_alto", "generic", "windows"]
PART_ROWS = 64  # rows of an Arrow batch that are Python objects at a time


def with_called(
    df: DataFrame, column: str, added: StructType, call: Callable[[list], list[list]], *, rows: int = PART_ROWS
) -> DataFrame:
    """Adds what ``call`` returns for the values of one column, a list for each added field.

    It is called with ``rows`` values at a time; the other columns stay in Arrow, so a worker holds a small Arrow batch and
    the objects of these rows, whatever the texts' number.
    """
    names, types = added.fieldNames(), to_arrow_schema(added).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = call(part.column(column).to_pylist())
                more = [pa.array(values, kind) for values, kind in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *names])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


# --- batches and prompts -----------------------------------------------------------------------------------


def pending_events(
    events: DataFrame, *, since: Column | None = None, until: Column | None = None, source_types: list[str] | None = None
) -> DataFrame:
    """Un-analysed events of a window."""
    df = between(events, "received_at", since, until)
    if "analyzed_at" in df.columns:
        df = df.filter("analyzed_at is null")
    return df.filter(F.col("source_type").isin(source_types)) if source_types else df


def analysis_batches(pending: DataFrame, size: int) -> DataFrame:
    """Rows in id order with their batch number; batches have ``size`` rows."""
    ranked = running_rank(pending, [], "id", out="_rank")
    return ranked.withColumn("batch", F.expr(f"(_rank - 1) div {max(1, size)}")).drop("_rank")


def batch_progress(batches: DataFrame) -> DataFrame:
    """Pending rows and batches, as one row."""
    per_batch = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))
    return per_batch.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("pending_total"), F.count("batch").alias("batches_total"))


def _ordered(condition: Column, value: Column) -> Column:
    """Values of a batch that satisfy a condition, in id order. A batch has a handful of rows."""
    rows = F.array_sort(F.collect_list(F.when(condition, F.struct(F.col("id"), value.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def split_blocked(batches: DataFrame) -> DataFrame:
    """Per batch: ids the firewall already blocked, the auto-skip summary for them, and what is left to analyse."""
    marked = with_blocked(batches, out="_blocked")
    grouped = marked.groupBy("batch").agg(
        _ordered(F.col("_blocked"), F.col("id")).alias("skipped_ids"),
        _ordered(~F.col("_blocked"), F.col("id")).alias("log_ids"),
        _ordered(~F.col("_blocked"), F.col("message")).alias("lines"),
    )
    n = F.size("skipped_ids")
    text = F.concat(F.lit(fixed.SKIPPED_BEFORE), n.cast("string"), F.lit(fixed.SKIPPED_AFTER), F.when(n == 1, "").otherwise("s"))
    return grouped.withColumn("skip_summary", F.when(n > 0, text))


def auto_skip_analyses(split: DataFrame) -> DataFrame:
    """The analyses that record skipped rows."""
    return split.filter(F.size("skipped_ids") > 0).select(
        "batch",
        F.col("skipped_ids").alias("log_ids"),
        F.lit(fixed.AUTO_SKIP_MODEL).alias("model"),
        F.lit("info").alias("severity"),
        F.col("skip_summary").alias("summary"),
        F.lit(None).cast("string").alias("error"),
    )


def prompt_text(lines: Column, max_chars: int) -> Column:
    body = F.array_join(
        F.transform(lines, lambda line, i: F.concat(i.cast("string"), F.lit("|"), ellipsize(line, max_chars))), "\n"
    )
    return F.concat(F.size(lines).cast("string"), F.lit(fixed.PROMPT_HEAD), body)


def build_prompts(split: DataFrame, *, line_limit: int = 1200, note: str = "") -> DataFrame:
    """One prompt per batch that has lines to analyse."""
    prompt = prompt_text(F.col("lines"), line_limit)
    if note:
        prompt = F.concat(F.lit(note + "\n"), prompt)
    return split.filter(F.size("log_ids") > 0).select("batch", "log_ids", prompt.alias("prompt"))


def run_model(prompts: DataFrame, model: Callable[[list[str]], list[str]], *, name: str = "model") -> DataFrame:
    """Replies per prompt with status, duration and error. A failing call marks its own row only."""

    def call(texts: list[str]) -> list[list]:
        replies, errors, spent = [], [], []
        for prompt in texts:
            started = time.perf_counter()
            try:
                replies.append(model([prompt])[0])
                errors.append(None)
            except Exception as failure:  # the row carries the message; the events stay pending
                replies.append(None)
                errors.append(str(failure))
            spent.append((time.perf_counter() - started) * 1000)
        status = ["failed" if e is not None else "ok" for e in errors]
        return [[name] * len(texts), replies, status, spent, errors]

    added = StructType().add("model", "string").add("raw_response", "string")
    added = added.add("status", "string").add("duration_ms", "double").add("error", "string")
    return with_called(prompts, "prompt", added, call)


# --- reply cleaning ----------------------------------------------------------------------------------------

# a string reaches to its closing quote, or to the end if it has none
_INSIDE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.S)
_FENCED = re.compile(fixed.FENCED_BLOCK)


def balanced_objects(text: str) -> list[str]:
    """The outermost balanced ``{…}`` stretches of any nesting depth; braces inside strings do not count.

    Strings exist inside objects only: a quote in the prose around them (``5" wide``) opens nothing. A brace that is never
    closed opens nothing either: objects inside it count.
    """
    open_at: list[int] = []
    spans: list[tuple[int, int]] = []
    at = text.find("{")
    while at >= 0:
        token = _INSIDE.search(text, at)
        if token is None:
            break
        at = token.end()
        if token[0] == "{":
            open_at.append(token.start())
        elif token[0] == "}" and open_at:
            start = open_at.pop()
            while spans and spans[-1][0] > start:  # inner objects belong to this one
                spans.pop()
            spans.append((start, at))
        if not open_at:
            at = text.find("{", at)
    return [text[a:b] for a, b in spans]


def embedded_object(text: str | None) -> str | None:
    """The whole text if it is a JSON object, else the last of its fenced blocks and balanced objects that is one."""
    if not text or "{" not in text:
        return None
    if _is_json_object(text):
        return text
    blocks = [m[1] for m in _FENCED.finditer(text)] if "```" in text else []
    return next((b for b in reversed(blocks + balanced_objects(text)) if _is_json_object(b)), None)


def _is_json_object(text: str) -> bool:
    if not (text.startswith("{") and text.endswith("}")):
        return False
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


def _embedded(texts: pd.Series) -> pd.Series:
    return pd.Series([embedded_object(t) for t in texts], dtype=object)


def _is_object(text: Column) -> Column:
    """A JSON object. Texts that do not even begin and end like one are not parsed: failed parses are slow."""
    parsed = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return F.when(text.startswith("{") & text.endswith("}"), F.coalesce(parsed, F.lit(False))).otherwise(False)


def reply_object(reply: Column) -> Column:
    """The JSON object in a free-text reply, null when there is none.

    The whole text comes first, then fenced blocks and balanced objects of any depth from the last to the first (in
    Arrow batches), then what lies between the first and the last brace.
    """
    text = strip(F.coalesce(reply, F.lit("")))
    embedded = F.pandas_udf(_embedded, "string")(text)
    widest = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(embedded, F.when(_is_object(widest), widest))


def _text(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def _choice(value: Column, allowed: list[str], missing: str, unknown: str) -> Column:
    lowered = F.lower(F.coalesce(value, F.lit(missing)))
    return F.when(lowered.isin(allowed), lowered).otherwise(unknown)


def _or(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))


def _short(value: Column, limit: int) -> Column:
    return cut(strip(F.coalesce(value, F.lit(""))), limit)


def _items(json: Column, key: str, limit: int) -> Column:
    """The objects among the first ``limit`` items of a list, as JSON texts."""
    items = F.from_json(_text(json, key), "array<string>")
    items = F.slice(F.coalesce(items, F.array().cast("array<string>")), F.lit(1), F.lit(limit))
    return F.filter(items, lambda item: F.coalesce(item.startswith("{"), F.lit(False)))


def _indexes(item: Column) -> Column:
    values = F.from_json(_text(item, "related_log_indexes"), "array<string>")
    whole = F.transform(
        F.filter(values, lambda v: F.coalesce(v.rlike(r"^-?\d+(\.\d+)?$"), F.lit(False))),
        lambda v: F.substring_index(v, ".", 1).try_cast("long"),
    )
    return F.coalesce(whole, F.array().cast("array<bigint>"))


def clean_replies(replies: DataFrame, *, column: str = "raw_response") -> DataFrame:
    """Add severity, summary (220) and anomalies (4; title 56, detail 130, indexes) of each reply."""
    json = F.col("_json")
    found = json.isNotNull()

    def anomaly(item: Column) -> Column:
        return F.struct(
            _or(_short(F.coalesce(_text(item, "title"), F.lit(fixed.ANOMALY_TITLE)), 56), fixed.ANOMALY_TITLE).alias("title"),
            _short(_text(item, "detail"), 130).alias("detail"),
            _indexes(item).alias("related_log_indexes"),
        )

    severity = F.when(found, _choice(_text(json, "severity"), fixed.VERDICT_LEVELS, "info", "low")).otherwise("low")
    summary = F.when(found, _or(_short(_text(json, "summary"), 220), fixed.NO_SUMMARY)).otherwise(fixed.NON_JSON_SUMMARY)
    return (
        computed_once(replies, "_json", reply_object(F.col(column)))
        .withColumn("severity", severity)
        .withColumn("summary", summary)
        .withColumn("anomalies", F.transform(_items(json, "anomalies", 4), anomaly))
        .drop("_json")
    )


def clean_explanations(replies: DataFrame, *, column: str = "raw_response") -> DataFrame:
    """Add severity, summary (160), explanation (800) and up to four actions (120) of each reply."""
    plain = F.to_json(F.struct(F.lit("low").alias("severity"), F.lit(fixed.NON_JSON_SUMMARY).alias("summary")))
    raw_summary = _text(F.col("_safe"), "summary")
    explanation = F.coalesce(F.nullif(_short(_text(F.col("_safe"), "explanation"), 800), F.lit("")), _short(raw_summary, 800))
    actions = F.from_json(_text(F.col("_safe"), "actions"), "array<string>")
    actions = F.slice(F.coalesce(actions, F.array().cast("array<string>")), F.lit(1), F.lit(4))
    actions = F.filter(F.transform(actions, lambda a: _short(a, 0)), lambda a: F.length(a) > 0)
    return (
        computed_once(replies, "_json", reply_object(F.col(column)))
        .withColumn("_safe", F.coalesce(F.col("_json"), plain))
        .withColumn("severity", _choice(_text(F.col("_safe"), "severity"), fixed.VERDICT_LEVELS, "info", "info"))
        .withColumn("summary", _or(_short(raw_summary, 160), fixed.EXPLANATION_SUMMARY))
        .withColumn("explanation", explanation)
        .withColumn("actions", F.transform(actions, lambda a: cut(a, 120)))
        .drop("_json", "_safe")
    )


def clean_summaries(replies: DataFrame, *, column: str = "raw_response") -> DataFrame:
    """Add headline (100), summary (420), up to ten findings and confidence of each reply."""
    json = F.col("_json")

    def finding(item: Column) -> Column:
        return F.struct(
            _or(_short(F.coalesce(_text(item, "title"), F.lit(fixed.FINDING_TITLE)), 70), fixed.FINDING_TITLE).alias("title"),
            _short(_text(item, "detail"), 200).alias("detail"),
        )

    findings, anomalies = _items(json, "findings", 10), _items(json, "anomalies", 10)
    has_findings = F.coalesce(F.json_array_length(_text(json, "findings")), F.lit(0)) > 0
    chosen = F.when(has_findings, findings).otherwise(anomalies)
    missing = F.when(json.isNull(), fixed.NON_JSON_SUMMARY).otherwise(fixed.NO_SUMMARY)
    return (
        computed_once(replies, "_json", reply_object(F.col(column)))
        .withColumn("headline", _or(_short(_text(json, "headline"), 100), fixed.NO_HEADLINE))
        .withColumn("summary", F.coalesce(F.nullif(_short(_text(json, "summary"), 420), F.lit("")), missing))
        .withColumn("findings", F.transform(chosen, finding))
        .withColumn("confidence", _choice(_text(json, "confidence"), fixed.CONFIDENCE_LEVELS, "low", "low"))
        .drop("_json")
    )


# --- period summaries --------------------------------------------------------------------------------------

STATS_KEYS = [
    "analyses_total", "ok_total", "err_total", "sev_high", "sev_critical", "elevated_total", "anomalies_total",
]


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def _one_line(text: Column, limit: int) -> Column:
    return ellipsize(strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))), limit)


def summary_context(
    analyses: DataFrame,
    since: Column,
    until: Column,
    *,
    weekly: bool = False,
    summaries: DataFrame | None = None,
    limit: int,
) -> DataFrame:
    """The text a period summary is written from, as one row: sums, snippets and, weekly, recent daily runs.

    The snippets come from the ``limit`` oldest analyses, 500 at most, so collecting them into one text is bounded.
    """
    kind, snippet, failure = ("WEEKLY", 280, 100) if weekly else ("DAILY", 320, 120)
    stats = analysis_window_stats(analyses, since, until)
    json = F.to_json(F.struct(*STATS_KEYS))
    rows = window_analyses(analyses, since, until, limit).select("id", "error", "severity", "summary", anomaly_count(analyses).alias("n"))
    failed = F.concat(F.lit(" FAILED err="), _one_line(F.col("error"), failure))
    fine = F.concat(
        F.lit(" sev="), F.coalesce("severity", F.lit("")), F.lit(" anomalies="), F.col("n").cast("string"),
        F.lit(" summary="), _one_line(F.col("summary"), snippet),
    )
    text = F.concat(F.lit("id="), F.col("id").cast("string"), F.when(F.coalesce("error", F.lit("")) != "", failed).otherwise(fine))
    collected = rows.agg(F.array_sort(F.collect_list(F.struct("id", text.alias("t")))).alias("r"))
    numbered = F.transform(F.col("r"), lambda r, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), r["t"]))
    parts = [
        F.concat(F.lit(f"ROLE={kind}_META_WINDOW UTC="), _stamp(since), F.lit(".."), _stamp(until)),
        F.concat(F.lit("AGGREGATE_JSON="), F.col("stats_json")),
    ]
    pieces = stats.select(json.alias("stats_json")).unionByName(collected.select(numbered.alias("snippets")), allowMissingColumns=True)
    if weekly:
        if summaries is None:
            raise ValueError("a weekly context needs the summaries")
        daily = recent_summaries(summaries, "daily", 8)
        line = F.concat(
            F.lit("- "), _stamp(F.col("created_at")), F.lit(" label="), F.coalesce("period_label", F.lit("")),
            F.lit(" conf="), F.coalesce("confidence", F.lit("")), F.lit(" headline="), _one_line(F.col("headline"), 140),
        )
        runs = daily.agg(F.sort_array(F.collect_list(F.struct("created_at", "id", line.alias("t"))), asc=False).alias("d"))
        pieces = pieces.unionByName(runs.select(F.transform("d", lambda r: r["t"]).alias("runs")), allowMissingColumns=True)
        listing = F.when(F.size("runs") > 0, F.array_join("runs", "\n")).otherwise(fixed.NO_DAILY_RUNS)
        parts += [F.lit(fixed.RECENT_RUNS), listing, F.lit(fixed.SNIPPETS_WEEKLY)]
    else:
        parts += [F.lit(fixed.SNIPPETS_DAILY)]
    # one row per piece, put side by side
    joined = pieces.agg(*[F.first(c, ignorenulls=True).alias(c) for c in pieces.columns])
    closing = F.lit(fixed.WEEKLY_TASK if weekly else fixed.DAILY_TASK)
    return joined.select(F.array_join(F.concat(F.array(*parts), "snippets", F.array(closing)), "\n").alias("context"))


def summary_due(
    attempts: DataFrame, analyses: DataFrame, now: Column, *, intervals: dict[str, int] | None = None,
    minimums: dict[str, int] | None = None, retry_seconds: int = 3600,
) -> DataFrame:
    """Per granularity: analyses in its window and whether a summary should be written now."""
    intervals = intervals or {"daily": 86400, "weekly": 604800}
    minimums = minimums or {"daily": 2, "weekly": 4}
    counted = analyses.filter((F.col("model") != fixed.AUTO_SKIP_MODEL) & (F.col("created_at") <= now))
    ages = F.unix_micros(now) - F.unix_micros("created_at")
    counts = counted.agg(*[F.count_if(ages <= s * 1_000_000).alias(g) for g, s in intervals.items()])
    per_kind = F.array(
        *[
            F.struct(F.lit(g).alias("granularity"), F.col(g).alias("n"), F.lit(s).alias("interval"), F.lit(minimums[g]).alias("minimum"))
            for g, s in intervals.items()
        ]
    )
    kinds = counts.select(F.explode(per_kind).alias("k")).select("k.*")

    def age(column: str) -> Column:
        return F.unix_micros(now) - F.unix_micros(column)

    joined = kinds.join(attempts, "granularity", "left")
    rested = F.col("last_any").isNull() | (age("last_any") >= retry_seconds * 1_000_000)
    elapsed = F.col("last_ok").isNull() | (age("last_ok") >= F.col("interval").cast("long") * 1_000_000)
    due = rested & elapsed & (F.col("n") >= F.col("minimum"))
    return joined.select("granularity", F.col("n").alias("analyses"), due.alias("due"))


# --- lines for the model -----------------------------------------------------------------------------------


def tail_budget(lines: DataFrame, max_chars: int) -> DataFrame:
    """Last lines of each source within a character budget; the last line is always kept."""
    cost = F.length("line") + 1
    summed = running_sum(lines, ["source"], "line_index", cost, out="_chars", reverse=True, below=max(max_chars, 1))
    kept = summed.filter((F.col("_chars") <= max_chars) | (F.col("_chars") == cost))
    return kept.drop("_chars")


def choose_mode(lines: DataFrame, direct_bytes: int, *, window: bool = False, skip_low_levels: bool = True) -> DataFrame:
    """Per source: bytes and lines worth analysing, and whether they go to the model directly or by retrieval.

    A journal is always direct.
    """
    kept = lines.filter(~is_low_level(F.col("line"))) if skip_low_levels else lines
    sums = kept.groupBy("source").agg(
        F.sum(F.octet_length("line") + 1).alias("bytes"), F.count(F.lit(1)).alias("lines")
    )
    direct = "direct-window" if window else "direct"
    mode = (
        F.when(F.col("source").startswith("journal://"), "direct-journal-window")
        .when(F.col("bytes") <= direct_bytes, direct)
        .otherwise("rag")
    )
    return sums.withColumn("mode", mode)


def chunk_lines(
    lines: DataFrame,
    *,
    size: int = 40,
    overlap: int = 8,
    line_limit: int = 512,
    newest_lines: int = 0,
    newest_chunks: int = 0,
) -> DataFrame:
    """Overlapping chunks per source (source, line_index, line) to (source, start_line, text).

    Blank lines drop out of a chunk and blank chunks out of the result. Chunk numbers follow from the position,
    so a chunk is its own group of at most ``size`` lines, however long the source. The two ``newest`` options
    are the caller's choice to look only at the end of each source; 0 looks at everything.
    """
    size = 40 if size <= 0 else size
    step = max(1, size - max(0, min(overlap, size - 1)))
    position = F.col("line_index")
    if newest_lines > 0:
        totals = lines.groupBy("source").agg((F.max("line_index") + 1).alias("_n"))
        lines = lines.join(totals, "source")
        position = position - F.greatest(F.col("_n") - newest_lines, F.lit(0))
        lines = lines.withColumn("line_index", position).filter(F.col("line_index") >= 0).drop("_n")
        position = F.col("line_index")
    first = F.greatest(F.lit(0), F.expr(f"(line_index - {size - 1} + {step - 1}) div {step}"))
    last = F.expr(f"line_index div {step}")
    placed = lines.filter(F.length(strip(F.col("line"))) > 0).select(
        "source", position.alias("p"), ellipsize(F.col("line"), line_limit).alias("t"), F.explode(F.sequence(first, last)).alias("k")
    )
    rows = F.array_sort(F.collect_list(F.struct("p", "t")))
    chunks = placed.groupBy("source", "k").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"))
    chunks = chunks.select("source", (F.col("k") * step).alias("start_line"), "text")
    if newest_chunks > 0:
        ranked = running_rank(chunks, ["source"], "start_line", reverse=True, below=newest_chunks)
        chunks = ranked.drop("rank")
    return chunks


def embed_text(text: Column, *, max_chars: int = 4000, max_tokens: int = 512) -> Column:
    """Text ready for an embedding call: no NUL, trimmed, capped by characters and by tokens, never empty."""
    clean = _or(strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(""))), " ")
    clean = ellipsize(clean, max_chars)
    return ellipsize(clean, max(16, max_tokens * 4)) if max_tokens > 0 else clean


def prepare_embed_text(chunks: DataFrame, *, max_chars: int = 4000, max_tokens: int = 512) -> DataFrame:
    prepared = chunks.withColumn("text", embed_text(F.col("text"), max_chars=max_chars, max_tokens=max_tokens))
    return prepared.withColumn("tokens", estimate_tokens(F.col("text")))


def embed_chunks(
    chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], *, batch: int = 8, retries: int = 4
) -> DataFrame:
    """Add ``embedding``. A failing call is retried, then split in halves; one text that keeps failing raises."""

    def vectors(texts: list[str]) -> list[list[float]]:
        for attempt in range(retries):
            try:
                return embed(texts)
            except Exception:
                if len(texts) > 1:
                    middle = len(texts) // 2
                    return vectors(texts[:middle]) + vectors(texts[middle:])
                if attempt == retries - 1:
                    raise
        return []

    def call(texts: list[str]) -> list[list]:
        return [[v for i in range(0, len(texts), batch) for v in vectors(texts[i : i + batch])]]

    added = StructType([StructField("embedding", ArrayType(FloatType()))])
    return with_called(chunks, "text", added, call, rows=batch * max(1, PART_ROWS // batch))


def squared_distance(vector: Column, query: list[float]) -> Column:
    other = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(vector, other, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def top_k_chunks(vectors: DataFrame, query: list[float], *, source: str | None = None, k: int = 12) -> DataFrame:
    """The k chunks of a source nearest to a query vector, in line order."""
    df = vectors.filter(F.col("source") == source) if source is not None else vectors
    near = df.withColumn("distance", squared_distance(F.col("embedding"), query))
    return near.orderBy("distance", "source", "start_line").limit(k).orderBy("source", "start_line")


def source_key(source: Column, mtime_ns: Column, size: Column) -> Column:
    """Key of a source's chunk set; a journal is keyed by its name alone."""
    stamped = F.concat_ws(":", source, mtime_ns.cast("string"), size.cast("string"))
    return F.left(F.sha2(F.when(source.startswith("journal://"), source).otherwise(stamped), 256), F.lit(16))


def index_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the stored chunk sets of the sources present, leaving others alone."""
    chunks.hint("rebalance", "source_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").parquet(path)
