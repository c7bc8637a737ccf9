"""Greedy in-order packing of texts into requests under a token budget, for sources of any length.

Packing is sequential within a source: where a request ends decides where the next begins. A block of
consecutive texts, however, turns "tokens in the open request when the block starts" into "tokens in the open
request when it ends, and requests begun meanwhile", and that is a small table with one entry per possible
number of open tokens. Such tables compose like functions, so they are summarised as a tree: ``FAN`` neighbours at a time
become one table of the same size, level by level, until a source has one; on the way back each table tells its parts what
is open where they begin. Then all blocks are numbered in parallel. A task sees one block or ``FAN`` tables, however long
a source is, and the rounds grow with the logarithm of its blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.operators.running import settled

BLOCK_BITS = 16
FAN_BITS = 4  # a table of the next level stands for 16 neighbours


def estimate_tokens(text: Column) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("int")


def _next_start(tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For a request begun at each text, where the next one begins; and the prefix sums."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    size = len(tokens)
    following = np.searchsorted(sums, sums[:-1] + budget, side="right") - 1
    oversize = np.flatnonzero(tokens > budget)
    stops = np.append(oversize, size)
    own_stop = stops[np.searchsorted(oversize, np.arange(size), side="left")]
    later_stop = stops[np.searchsorted(oversize, np.arange(size), side="right")]
    following = np.where(own_stop == np.arange(size), np.arange(size) + 1, np.minimum(following, later_stop))
    return following, sums


def _first_start(open_tokens: np.ndarray, tokens: np.ndarray, sums: np.ndarray, budget: int) -> np.ndarray:
    """Where the first new request begins when a request with ``open_tokens`` is open at the start."""
    over = np.searchsorted(sums, budget - open_tokens, side="right") - 1
    oversize = np.flatnonzero(tokens > budget)
    stop = oversize[0] if len(oversize) else len(tokens)
    return np.where(open_tokens == 0, 0, np.minimum(over, stop))


def _summary(budget: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        tokens = block["tokens"].to_numpy(dtype=np.int64)
        size = len(tokens)
        following, sums = _next_start(tokens, budget)
        closing, begun = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for start in range(size - 1, -1, -1):
            after = following[start]
            if after == size:
                closing[start] = 0 if tokens[start] > budget else sums[size] - sums[start]
                begun[start] = 1
            else:
                closing[start], begun[start] = closing[after], begun[after] + 1
        opened = np.arange(budget + 1)
        first = _first_start(opened, tokens, sums, budget)
        stays = first >= size
        leave = np.where(stays, opened + sums[size], closing[np.minimum(first, size)])
        count = np.where(stays, 0, begun[np.minimum(first, size)])
        return pd.DataFrame(
            {"source": [block["source"].iloc[0]], "blk": [block["blk"].iloc[0]], "leave": [leave.tolist()], "begun": [count.tolist()]}
        )

    return run


def _composed(budget: int):
    """One table for a run of neighbouring tables: each begins with what the one before leaves open."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        leave, begun = np.arange(budget + 1), np.zeros(budget + 1, np.int64)
        for part in parts.sort_values("blk").itertuples():
            begun = begun + np.asarray(part.begun)[leave]
            leave = np.asarray(part.leave)[leave]
        return pd.DataFrame({"source": [parts["source"].iloc[0]], "blk": [parts["up"].iloc[0]], "leave": [leave.tolist()], "begun": [begun.tolist()]})

    return run


def _entries(parts: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """What is open, and how many requests began, where each of the neighbours begins."""
    rows = []
    if not (parts.empty or above.empty):
        opened, number = int(above["opened"].iloc[0]), int(above["number"].iloc[0])
        for part in parts.sort_values("blk").itertuples():
            rows.append((part.source, part.blk, opened, number))
            opened, number = int(part.leave[opened]), number + int(part.begun[opened])
    return pd.DataFrame(rows, columns=["source", "blk", "opened", "number"]).astype({"source": object})


_TABLE, _ENTRY = "source string, blk long, leave array<long>, begun array<long>", "source string, blk long, opened long, number long"


def _up(table: DataFrame) -> DataFrame:
    return table.withColumn("up", F.shiftright("blk", FAN_BITS))


def _block_entries(summaries: DataFrame, budget: int) -> DataFrame:
    """(source, blk, opened, number) of every block."""
    levels = [settled(summaries, "packing")]
    while not levels[-1].groupBy("source").count().filter("count > 1").isEmpty():
        composed = _up(levels[-1]).groupBy("source", "up").applyInPandas(_composed(budget), _TABLE)
        levels.append(settled(composed, "packing"))
    zero = F.lit(0).cast("long")
    entries = levels[-1].select("source", "blk", zero.alias("opened"), zero.alias("number"))
    for table in reversed(levels[:-1]):
        above = entries.withColumnRenamed("blk", "up").groupBy("source", "up")
        entries = settled(_up(table).groupBy("source", "up").cogroup(above).applyInPandas(_entries, _ENTRY), "packing")
    return entries


def _number(budget: int):
    def run(block: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        if entry.empty or block.empty:
            return pd.DataFrame({"source": pd.Series([], dtype=object), "position": [], "request": []})
        tokens = block["tokens"].to_numpy(dtype=np.int64)
        following, sums = _next_start(tokens, budget)
        opened = np.array([int(entry["opened"].iloc[0])])
        starts = np.zeros(len(tokens), np.int64)
        at = int(_first_start(opened, tokens, sums, budget)[0])
        while at < len(tokens):
            starts[at] = 1
            at = following[at]
        request = int(entry["number"].iloc[0]) + np.cumsum(starts) - 1
        return pd.DataFrame({"source": block["source"].to_numpy(dtype=object), "position": block["position"].to_numpy(), "request": request})

    return run


def pack_token_budget(texts: DataFrame, budget: int, *, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(source, position, tokens) to (source, position, request); requests count from 0 per source.

    A budget of zero or less means one request per source.
    """
    if budget <= 0:
        return texts.select("source", "position", F.lit(0).cast("long").alias("request"))
    slim = texts.select(
        "source", F.col("position").cast("long"), F.col("tokens").cast("long"), F.shiftright("position", block_bits).cast("long").alias("blk")
    )
    blocks = slim.groupBy("source", "blk")
    entries = _block_entries(blocks.applyInPandas(_summary(budget), _TABLE), budget)
    return blocks.cogroup(entries.groupBy("source", "blk")).applyInPandas(
        _number(budget), "source string, position long, request long"
    )
