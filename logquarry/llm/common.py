"""Helpers shared by the text operators: scratch tables, words, hash buckets and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.session import shared_dir

#: Words are maximal runs of anything but these six ASCII blanks, as ``bytes.split()`` cuts them too.
WORD = r"[^\x20\x09-\x0D]+"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
BLANKS = " \t\n\x0b\x0c\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the cluster's shared folder: cuts the lineage and survives lost executors.

    The shuffle files of the job that writes it are dropped as soon as the table stands, and rows go to Python in small
    batches: long texts would otherwise fill tens of MB on both sides.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    wanted = {DROP_SHUFFLES: "true", BATCH_BYTES: SMALL_BATCH}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    if _open_scopes:
        _open_scopes[-1].paths.append(path)
    return table


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in small batches from now on, also where a caller writes what an operator returns."""
    spark.conf.set(BATCH_BYTES, SMALL_BATCH)


class Scope:
    """The tables written while a ``scratch`` block is open."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, table: DataFrame) -> DataFrame:
        """Leaves a table that ``written`` made to the block around, or in place if there is none."""
        self.kept.append(table.written_at)
        return table


_open_scopes: list[Scope] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scope]:
    """Tables that ``written`` makes in this block go when it ends, but for those that are kept.

    What leaves the block must read kept tables alone.
    """
    scope = Scope()
    _open_scopes.append(scope)
    try:
        yield scope
    finally:
        _open_scopes.pop()
        for path in scope.paths:
            if path not in scope.kept:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if _open_scopes:
            _open_scopes[-1].paths += scope.kept


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened until none is taken (column names don't tell case apart)."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


#: Steps that neither repeat rows nor join them: above them a row still has one place in one file.
_ONE_TO_ONE = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "Relation"}


def _nodes(plan) -> list[str]:
    below = plan.children()
    return [plan.nodeName().split(" ")[0], *(name for k in range(below.size()) for name in _nodes(below.apply(k)))]


def located(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with two more columns, whose names are returned: a row's file and its number there.

    They name a row for good, whatever its columns hold, and cost no copy. Rows that don't come straight from Parquet
    files are written first.
    """
    names = unused(docs.columns, "_file", "_at")
    place = [F.col(f"_metadata.{field}").alias(name) for field, name in zip(("file_path", "row_index"), names)]
    if "_metadata" not in {c.lower() for c in docs.columns} and set(_nodes(docs._jdf.queryExecution().analyzed())) <= _ONE_TO_ONE:
        try:
            return docs.select("*", *place), names
        except AnalysisException:  # files of another format don't number their rows
            pass
    copy = written(docs, "rows")
    if "_metadata" in {c.lower() for c in docs.columns}:
        copy = written(docs.withColumns({names[0]: F.lit(""), names[1]: F.monotonically_increasing_id()}), "rows")
        return copy, names
    return copy.select("*", *place), names


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from every training set: CRC-32 of the id's digits leaves 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def computed(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Only the columns of ``fields``, each computed once per row.

    The optimizer inlines projected expressions into every later use; a generator of one row is left alone.
    """
    return df.select(F.inline(F.array(F.struct(*(value.alias(name) for name, value in fields.items())))))


def joined(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of ``n`` nodes along the links i - j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def by_groups(keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas`` over partitions that are sorted by ``keys``: the results of all groups, one group held at a time."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            cut = np.flatnonzero((rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(axis=1)) + 1
            if held and (held[0][keys].iloc[0] != rows[keys].iloc[0]).any():
                yield run(pd.concat(held, ignore_index=True))
                held = []
            for low, high in zip([0, *cut], [*cut, len(rows)]):
                part = rows.iloc[low:high]
                if high < len(rows):
                    yield run(pd.concat([*held, part], ignore_index=True) if held else part)
                    held = []
                else:
                    held.append(part)
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return each


def components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, root) for every linked node; ``root`` is the smallest node reachable.

    Alternating large and small stars: every round is two aggregations to a minimum and two joins, the tree depth
    shrinks geometrically, and no component ever meets in one task. Rounds are written tables; only the last one stays.
    """
    with scratch(links.sparkSession) as held:
        edges = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
        edges = written(edges, "stars")
        while not _are_stars(edges):
            with scratch(links.sparkSession) as round_:
                both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
                lowest = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
                large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
                large = written(large.filter("u <> v"), "stars")
                least = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
                hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                edges = round_.keep(written(least.select("u", F.col("m").alias("v")).unionByName(hung).distinct(), "stars"))
        held.keep(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none: edges lead to smaller nodes, so that is the smallest."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    per_node = ends.groupBy("node").agg(F.sum("down").alias("hangs"), F.min("down").alias("least"))
    return per_node.filter("hangs > 1 or (hangs = 1 and least = 0)").isEmpty()
