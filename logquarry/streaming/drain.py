"""The analysis of pending events as one job that can be run again: plan, ask the model, record, mark.

Everything a run decides is kept in its ledger, a folder of its own. The plan (which events form which batch) is settled
before the first call, so a run that dies and is started again goes on with the same batches; replies are kept round by
round, so only the round that died is asked again; and the verdicts are written onto the events under the run's name, which
the table accepts once. No event is lost or marked twice, however often a run is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators import analysis
from logquarry.sources.store import DayTable

ANALYSIS = "id long, batch long, log_ids array<long>, model string, raw_response string, severity string, summary string, error string, created_at timestamp"


class Ledger:
    """Tables of one run, each written whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def has(self, name: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of this name; made and written if it isn't there yet."""
        if not self.has(name):
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")


def _split(batches: DataFrame, skip_blocked: bool) -> DataFrame:
    if skip_blocked:
        return analysis.split_blocked(batches)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", "message"))), lambda r: r)
    each = batches.groupBy("batch").agg(rows.alias("_rows"))
    nothing = F.array().cast("array<long>")
    return each.select("batch", nothing.alias("skipped_ids"), F.col("_rows.id").alias("log_ids"), F.col("_rows.message").alias("lines"), F.lit(None).cast("string").alias("skip_summary"))


def drain(
    table: DayTable,
    ledger: str,
    model: Callable[[list[str]], list[str]],
    *,
    now: Column,
    name: str = "model",
    first_id: int = 1,
    size: int = 40,
    round_batches: int = 10_000,
    max_batches: int = 0,
    since: Column | None = None,
    until: Column | None = None,
    skip_blocked: bool = True,
    line_limit: int = 1200,
) -> dict:
    """Analyses the pending events of a table and marks them; returns the run's counts and why it stopped.

    Rounds of ``round_batches`` batches run one after the other, the calls of a round in parallel. After a round with a
    failed call no other round begins; with 0 there is one round, so every batch is asked whichever calls fail. Events of
    failed calls stay pending for the next run; events that the firewall had blocked already are marked without a call.
    Analyses are numbered from ``first_id`` by batch, so a repeated run gives the same numbers.
    """
    spark, book = table.spark, Ledger(table.spark, ledger)

    def planned() -> DataFrame:
        batches = analysis.analysis_batches(analysis.pending_events(table.read(), since=since, until=until).select("id", "message"), size)
        return _split(batches if max_batches <= 0 else batches.filter(F.col("batch") < max_batches), skip_blocked)

    plan = book.once("plan", planned)
    count = (plan.agg(F.max("batch")).first()[0] or 0) + 1 if not plan.isEmpty() else 0
    stopped, reached = ("batch_cap" if 0 < max_batches <= count else "empty"), 0
    replies = []
    step = round_batches if round_batches > 0 else max(count, 1)
    for low in range(0, count, step):
        reached = min(count, low + step)

        def asked(low: int = low, high: int = reached) -> DataFrame:
            prompts = analysis.build_prompts(plan.filter((F.col("batch") >= low) & (F.col("batch") < high)), line_limit=line_limit)
            return analysis.clean_replies(analysis.run_model(prompts.drop("lines"), model, name=name))

        replies.append(book.once(f"replies/round={low}", asked))
        if not replies[-1].filter("error is not null").isEmpty():
            stopped = "model_error"
            break

    def recorded() -> DataFrame:
        skipped = analysis.auto_skip_analyses(plan.filter(F.col("batch") < reached)).withColumn("raw_response", F.lit(""))
        rows = skipped.withColumn("id", F.lit(first_id) + 2 * F.col("batch"))
        for part in replies:
            failed = F.col("error").isNotNull()
            told = part.withColumns({"severity": F.when(failed, "low").otherwise(F.col("severity")), "summary": F.when(failed, "").otherwise(F.col("summary"))})
            told = told.withColumns({"id": F.lit(first_id) + 2 * F.col("batch") + 1, "raw_response": F.coalesce("raw_response", F.lit(""))})
            rows = rows.unionByName(told.select(rows.columns))
        kinds = {f.split()[0]: f.split()[1] for f in ANALYSIS.split(", ")}
        return rows.withColumn("created_at", now).select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))

    analyses = book.once("analyses", recorded) if reached else spark.createDataFrame([], ANALYSIS)
    if reached:
        table.mark_analyzed(analyses, job=f"drain {ledger}")
    n, auto, failed = F.size("log_ids"), F.col("model") == analysis.fixed.AUTO_SKIP_MODEL, F.col("error").isNotNull()
    sums = analyses.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("logs_processed"),
        F.count_distinct("batch").alias("batches_done"),
        F.count_if(~auto & ~failed).alias("batches_ok"),
        F.count_if(failed).alias("batches_fail"),
        F.coalesce(F.sum(F.when(auto, n)), F.lit(0)).alias("auto_skipped"),
    ).first()
    return {**sums.asDict(), "stopped_reason": stopped}
