"""Bloom filters as small tables: which of many folders may hold a key, without reading their keys.

A folder's filter is a set of rows (bits, word, mask): the 64-bit words that are not empty. Filters are made by one
aggregate, and all folders are asked in one join, so neither the driver nor a task ever holds a filter as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, PROBES = 10, 7  # a key that isn't there passes in about 1 % of cases
LEAST_BITS = 1 << 10


def bits_for(keys: int) -> int:
    """The size of a filter: a power of two."""
    return max(LEAST_BITS, 1 << (BITS_PER_KEY * max(1, keys) - 1).bit_length())


def _places(key: str, bits: Column) -> Column:
    """(word, mask) of each of a key's bits."""
    first, step = F.xxhash64(F.col(key)), F.xxhash64(F.lit(1), F.col(key)).bitwiseOR(F.lit(1))
    narrow = F.lit((1 << 56) - 1)  # sums of such numbers stay below 2^63
    at = F.array(*((first.bitwiseAND(narrow) + i * step.bitwiseAND(narrow)).bitwiseAND(bits - 1) for i in range(PROBES)))
    return F.transform(at, lambda p: F.struct(F.shiftright(p, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int")).alias("mask")))


def filter_of(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(bits, word, mask) of a folder's keys."""
    size = F.lit(bits).cast("long")
    each = keys.select(F.explode(_places(key, size)).alias("p")).select("p.word", "p.mask")
    return each.groupBy("word").agg(F.bit_or("mask").alias("mask")).select(size.alias("bits"), "word", "mask")


def folders_that_may_hold(keys: DataFrame, key: str, filters: DataFrame, folder: str) -> list:
    """The folders whose filter lets one of the keys pass, in order: a value for each folder at most.

    ``filters`` has the rows of ``filter_of`` and the folder's name; sizes may differ from folder to folder.
    """
    sizes = [r[0] for r in filters.select("bits").distinct().collect()]  # powers of two
    if not sizes:
        return []
    asked = keys.select(key).distinct().withColumn("bits", F.explode(F.array(*(F.lit(s).cast("long") for s in sizes))))
    asked = asked.select(F.col(key).alias("_key"), "bits", F.posexplode(_places(key, F.col("bits"))).alias("probe", "p"))
    asked = asked.select("_key", "bits", "probe", F.col("p.word").alias("word"), F.col("p.mask").alias("bit"))
    met = asked.join(filters.select("bits", "word", "mask", folder), ["bits", "word"]).filter(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    passed = met.groupBy(folder, "_key").agg(F.count("*").alias("n")).filter(F.col("n") == PROBES)
    return sorted(r[0] for r in passed.select(folder).distinct().collect())
