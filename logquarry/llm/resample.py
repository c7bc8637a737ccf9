"""Importance resampling towards a target distribution of hashed word features.

A text's features are its runs of one to ``runs`` words; a feature's bucket is the CRC-32 of its bytes modulo
``buckets``. The counts of both corpora in every bucket give the bucket a gain (a log ratio of smoothed shares, in
whole thousandths), a document's weight is the sum of its features' gains, and a Gumbel number that the document's id
alone decides turns "draw without replacement by weight" into "take the highest scores".

CRCs are taken by length-bucketed matrices: the distinct features of a slab are grouped by length, the features of one
length form a two-dimensional ``uint8`` array, all their CRCs are updated column by column, and the buckets are
scattered back to the features' occurrences. A task holds a slab of features and a bounded table of features it has
already met; texts are cut into pieces between words, so a long text is never listed as a whole.

Both passes read the texts where they lie. Between them only bucket counts move: ``buckets`` rows of each task at most,
and as many on the driver. Ranks come from one range sort of slim rows and the row counts of its partitions.

Defined cases: a null or empty text has no features, weight 0, and is never drawn; a null ``doc_id`` takes the digest of
the empty id and comes after all ids in a tie; rows that repeat a ``doc_id`` are documents of their own; an empty target
has zero counts; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import written

BUCKETS, RUNS, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, 10, 2024
PIECE = 1 << 20  # bytes of a text that are split into words at a time
SLAB = 1 << 18  # features whose buckets are looked up at a time, about
KNOWN = 1 << 19  # features a task remembers with their buckets
_POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z to a-z, everything outside words to a blank.
_FOLDED = bytes(low if (low := ord(chr(b).lower()) if b < 0x80 else b) in _WORD_BYTES else 0x20 for b in range(256))


def _steps() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_STEPS = _steps()


def crc32s(features: list[bytes]) -> np.ndarray:
    """The CRC-32 of each feature, by matrices of equal length."""
    out = np.zeros(len(features), np.uint32)
    if not features:
        return out
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        matrix = np.frombuffer(b"".join([features[i] for i in group]), np.uint8).reshape(len(group), -1)
        crc = np.full(len(group), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            crc = _STEPS[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[group] = ~crc
    return out


def pieces(text: bytes | None, runs: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, features) of the text's pieces; a run belongs to the piece in which it ends."""
    folded = (text or b"").translate(_FOLDED)
    at, tail = 0, []
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        at = end
        features, held = list(words), tail + words
        for n in range(2, runs + 1):
            first = max(0, len(tail) - n + 1)
            features += map(b" ".join, zip(*(held[first + k :] for k in range(n))))
        tail = held[len(held) - runs + 1 :] if runs > 1 else []
        yield len(words), features


def slabs(texts: Iterable[bytes | None], runs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(text number, words, features of each piece, all features) of about ``SLAB`` features at a time."""
    held: list[tuple[int, int, int]] = []
    features: list[bytes] = []
    for number, text in enumerate(texts):
        for words, piece in pieces(text, runs):
            held.append((number, words, len(piece)))
            features += piece
            if len(features) >= SLAB:
                yield *np.array(held, np.int64).T, features
                held, features = [], []
    if held:
        yield *np.array(held, np.int64).T, features


class Buckets:
    """Looks up features' buckets; remembers a bounded number of features."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = buckets, {}

    def of(self, features: list[bytes]) -> np.ndarray:
        distinct = set(features)
        if len(self.known) > KNOWN:
            self.known = {}
        fresh = [f for f in distinct if f not in self.known]
        self.known.update(zip(fresh, (crc32s(fresh) % np.uint32(self.buckets)).tolist()))
        return np.fromiter(map(self.known.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = Buckets(buckets), np.zeros(buckets, np.int64)
        for rows in batches:
            for _, _, _, features in slabs(rows["text"], runs):
                held += np.bincount(found.of(features), minlength=buckets)
        filled = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": filled, "n": held[filled]})

    each = texts.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in each.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of a bucket's smoothed shares in the target and in the raw corpus."""
    size, raw_all, target_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = ((int(t) + 1) * (raw_all + size) / ((int(s) + 1) * (target_all + size)) for s, t in zip(raw, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def gumbel(doc_id: str, seed: int) -> Column:
    """Whole thousandths of a Gumbel number decided by the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, gain: np.ndarray, runs: int) -> DataFrame:
    """(doc_id, words, n_features, weight) of every row."""

    @F.pandas_udf("words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = Buckets(len(gain))
        for texts in batches:
            out = np.zeros((3, len(texts)), np.int64)
            for number, words, sizes, features in slabs(texts, runs):
                running = np.concatenate([[0], np.cumsum(gain[found.of(features)])])
                end = np.cumsum(sizes)
                for held, amount in zip(out, (words, sizes, running[end] - running[end - sizes])):
                    np.add.at(held, number, amount)
            yield pd.DataFrame(dict(zip(("words", "n_features", "weight"), out)))

    return docs.select("doc_id", weigh(F.col("text").cast("binary")).alias("f")).select("doc_id", "f.*")


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """Adds ``rank`` to the rows that ``fits`` marks with the ``draw`` highest scores, ties to smaller ids.

    Rows are sorted by range; a row's place is the number of rows in the partitions before its own plus its place there.
    Rows alike in score and id are spread by their place in the settled table, so no tie is bound to one task.
    """
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_tie")]
    spread = scored.withColumn("_tie", F.monotonically_increasing_id())
    lined = spread.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    lined = written(lined, "lined").withColumn("_part", F.shiftright("_place", 33))
    held = sorted(tuple(r) for r in lined.groupBy("_part").agg(F.count("*")).collect())  # a row for each partition
    ahead, offsets = 0, []
    for part, n in held:
        offsets.append((part, ahead))
        ahead += n
    before = scored.sparkSession.createDataFrame(offsets, "_part long, _ahead long")
    place = F.col("_ahead") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    rank = F.when(F.col("fits") & (place <= draw), place)
    return lined.join(F.broadcast(before), "_part").withColumn("rank", rank)


def resample(
    docs: DataFrame, target: DataFrame, *, runs: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null for documents not drawn.

    ``share`` per cent of the documents with at least ``least_words`` words are drawn, the highest scores first.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    rows = weighed(docs, gain, runs).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    rows = written(rows.withColumn("fits", F.col("words") >= least_words).drop("words"), "scored")
    draw = share * rows.filter("fits").count() // 100
    return ranked(rows, draw).select("doc_id", "n_features", "weight", "score", "rank")
