"""Running sums and ranks that survive hot groups.

A plain window over ``partitionBy(source)`` puts every row of a source into one task, and a window without
keys puts the whole table there. Here the order column is cut into blocks; the blocks' sums are small and get
their own running sum, and only the rows of one block ever meet in a task. A key that holds a third of the
table is thus spread over (its rows / block size) groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.session import shared_dir

BLOCK_BITS = 20  # about a million consecutive order values per group
SENT_BLOCKS = 100_000  # surviving blocks up to this many are sent to every executor


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections use several times.

    The optimizer inlines a projected expression into every filter and column above it; a generator of one row
    is left alone, so the value is computed once per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    amount: Column,
    *,
    out: str = "running",
    total: str | None = None,
    reverse: bool = False,
    below: int | None = None,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Inclusive running sum of ``amount`` per key along the integer column ``order`` (unique within a key).

    ``reverse`` sums from the end. ``below`` keeps only rows whose running sum *before* them is under the
    limit. The surviving blocks are then settled and counted first; unless there are very many, they are sent to
    the executors, so rows of other blocks are dropped where they are read and never shuffled. ``total`` adds the sum
    of the whole key.
    """
    base = df.withColumn("_blk", F.shiftright(F.col(order), block_bits)).withColumn("_amt", amount.cast("long"))
    group = [*keys, "_blk"]
    direction = F.desc if reverse else F.asc
    over_blocks = Window.partitionBy(*keys).orderBy(direction("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = base.groupBy(*group).agg(F.sum("_amt").alias("_sum"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(over_blocks), F.lit(0)))
    if total:
        blocks = blocks.withColumn(total, F.sum("_sum").over(Window.partitionBy(*keys)))
    if below is not None:
        blocks = settled(blocks.filter(F.col("_before") < below), "blocks")
        if blocks.limit(SENT_BLOCKS + 1).count() <= SENT_BLOCKS:
            blocks = F.broadcast(blocks)
    within = (
        Window.partitionBy(*group).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = base.join(blocks.drop("_sum"), group)
    result = joined.withColumn(out, F.col("_before") + F.sum("_amt").over(within))
    if below is not None:
        result = result.filter(F.col(out) - F.col("_amt") < below)
    return result.drop("_blk", "_amt", "_before")


def running_rank(df: DataFrame, keys: list[str], order: str, *, out: str = "rank", **options) -> DataFrame:
    """1-based position per key along ``order``."""
    return running_sum(df, keys, order, F.lit(1), out=out, **options)
