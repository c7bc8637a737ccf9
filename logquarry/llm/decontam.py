"""Benchmark decontamination by the q-gram lemma and banded alignment.

A document leaks an item if some stretch of its text is within ``BUDGET`` edits per item character, after both are
lower-cased and anything but letters and digits becomes one blank. An occurrence of an item of m characters with at
most k edits shares at least m - q + 1 - k q of its q-grams with the text, all on neighbouring diagonals (place in the
text less place in the item). So shared q-grams are counted per item in overlapping bands of diagonals, bands below
the bound are dropped without loss, and the rest is verified by an alignment confined to the band's diagonals. For this q
is ``GRAM``, or for short items as much less as keeps the bound at one or more.

The items are the query set: they are sent to the workers in blocks of a fixed number of characters, one block after the
other, and every block meets every document once, where it lies. No document meets another.

Defined cases: a null or empty text leaks nothing; items that are null or have no letter or
digit match nothing; items alike in text are reported each, items without an id under a null id; rows that repeat a ``doc_id`` are searched separately; an empty table on either side gives no
leak; other columns are ignored (``leaks``) or kept (``clean``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator  # noqa: TC003 (pandas_udf reads the hints)
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import located, unused, written
from logquarry.llm.suffixes import Hashes

GRAM = 12
BUDGET = 0.05  # edits per item character
BLOCK = 4_000_000  # item characters sent at a time
SLAB = 1 << 18  # text bytes searched at a time, or one document
SIEVE, SMALL_SIEVE = 24, 16  # bits of the first look-up, and of that for items with shorter grams

_TABLE = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_OTHER = re.compile(r"[\W_]+")
MATCHES = "array<struct<item_id:bigint,edits:int,item_chars:int,shared:int>>"


def plain(text: str | None) -> bytes:
    """Lower-cased letters and digits of any script; every run of anything else is one blank."""
    low = (text or "").lower()
    if low.isascii():  # by bytes, which is faster
        return b" ".join(low.encode().translate(_TABLE).split())
    return _OTHER.sub(" ", low).strip().encode("utf-8", "replace")


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int | None:
    """Fewest edits that turn the item into a stretch of the text, on diagonals ``low`` to ``high``; None beyond the
    budget. The stretch may begin and end anywhere."""
    width = high - low + 1
    step = np.arange(width)
    cost = np.where((step + low >= 0) & (step + low <= len(text)), 0, budget + 1)
    padded = np.full(width + len(item) + 1, -1, np.int16)
    begin = max(0, low)
    part = text[begin : low + len(padded)] if low + len(padded) > 0 else text[:0]
    padded[begin - low : begin - low + len(part)] = part
    for i, letter in enumerate(item):
        end = step + low + i + 1  # text bytes used on each diagonal
        new = cost + (padded[i : i + width] != letter)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        new = np.minimum.accumulate(new - step) + step
        new[(end < 0) | (end > len(text))] = budget + 1
        if new.min() > budget:
            return None
        cost = new
    return int(cost.min())


class Items:
    """The q-grams of a block of items, looked up by hash."""

    def __init__(self, ids: list[int | None], texts: list[bytes], budget: float, gram: int = GRAM):
        self.gram, self.drop = gram, np.uint64(64 - (SIEVE if gram == GRAM else SMALL_SIEVE))
        self.ids, self.texts = ids, [np.frombuffer(t, np.uint8) for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.edits = (self.sizes * budget).astype(np.int64)
        self.least = np.maximum(1, self.sizes - gram + 1 - self.edits * gram)
        item = np.repeat(np.arange(len(texts)), np.maximum(0, self.sizes - gram + 1))
        grams = [Hashes(t).rolling(gram) for t in self.texts if len(t) >= gram]
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        offset = np.concatenate([np.arange(max(0, n - gram + 1)) for n in self.sizes]) if len(texts) else item
        order = np.argsort(grams, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << (64 - int(self.drop)), bool)
        self.sieve[self.grams >> self.drop] = True

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its leaks: item id, edits, item characters, shared q-grams of the best band."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        sizes = np.array([len(t) for t in texts])
        octets = np.frombuffer(b"".join(texts), np.uint8)
        if len(octets) < self.gram or not len(self.grams):
            return out
        values = Hashes(octets).rolling(self.gram)
        at = np.flatnonzero(self.sieve[values >> self.drop])
        slot = np.minimum(np.searchsorted(self.grams, values[at]), len(self.grams) - 1)
        hit = self.grams[slot] == values[at]
        at, slot = at[hit], slot[hit]
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, at, side="right")
        whole = at + self.gram <= ends[text]
        at, slot, text = at[whole], slot[whole], text[whole]
        times = self.count[slot]
        entry = np.repeat(self.first[slot] - np.cumsum(times) + times, times) + np.arange(times.sum())
        text, place = np.repeat(text, times), np.repeat(at - (ends - sizes)[text], times)
        item = self.item[entry]
        diagonal = place - self.offset[entry]
        band = diagonal // (self.edits[item] + 1)
        text, item, band = np.tile(text, 2), np.tile(item, 2), np.concatenate([band, band - 1])
        order = np.lexsort((band, item, text))
        text, item, band = text[order], item[order], band[order]
        new = np.ones(len(text), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)
        first = np.flatnonzero(new)
        shared = np.diff(first, append=len(text))
        enough = shared >= self.least[item[first]]
        first, shared = first[enough], shared[enough]
        found = set()
        for k in np.lexsort((-shared, item[first], text[first])):  # the fullest band of a text and item comes first
            t, i = int(text[first[k]]), int(item[first[k]])
            if (t, i) in found:
                continue
            budget, low = int(self.edits[i]), int(band[first[k]]) * (int(self.edits[i]) + 1)
            edits = aligned(self.texts[i], np.frombuffer(texts[t], np.uint8), low - budget, low + 2 * (budget + 1) - 1 + budget, budget)
            if edits is not None:
                found.add((t, i))
                out[t].append((self.ids[i], edits, int(self.sizes[i]), int(shared[k])))
        return out


def gram_of(size: int, budget: float) -> int:
    """The longest q up to ``GRAM`` of which an item within its edits keeps at least one; 0 for an empty item."""
    return min(GRAM, size // (int(size * budget) + 1))


def indexes(ids: list[int | None], texts: list[bytes], budget: float) -> list[Items]:
    """The items by the q they need; nearly all need the same."""
    need = [gram_of(len(t), budget) or min(1, len(t)) for t in texts]
    return [Items([i for i, n in zip(ids, need) if n == q], [t for t, n in zip(texts, need) if n == q], budget, q) for q in sorted(set(need) - {0})]


def _searcher(sent):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = indexes(*sent.value)

        def found_in(held: list[bytes]) -> list[list[tuple]]:
            return [list(chain.from_iterable(each)) for each in zip(*(i.search(held) for i in items))] if items else [[] for _ in held]

        for texts in batches:
            found, held, size = [], [], 0
            for text in texts:
                held.append(plain(text))
                size += len(held[-1])
                if size >= SLAB:
                    found += found_in(held)
                    held, size = [], 0
            found += found_in(held) if held else []
            yield pd.Series([sorted(f, key=lambda m: (m[0] is None, m[0] or 0, *m[1:])) for f in found], dtype=object)

    return search


def blocks(benchmark: DataFrame, budget: float = BUDGET, size: int = BLOCK) -> Iterator[tuple[Column, bool]]:
    """One column of matches per block of items, to be applied to a frame's ``text``, and whether it is the only one.

    Items come to the driver partition by partition and are held until they have ``size`` characters; a block is sent out,
    searched, and dropped before the next one is sent.
    """
    context = benchmark.sparkSession.sparkContext

    def packed() -> Iterator[tuple[list, list]]:
        ids, texts, held = [], [], 0
        for row in benchmark.filter("text is not null").select("item_id", "text").toLocalIterator():
            ids.append(row["item_id"])
            texts.append(plain(row["text"]))
            held += len(texts[-1])
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
        yield ids, texts

    each = packed()
    block, following = next(each), next(each, None)
    only = following is None
    while block is not None:
        sent = context.broadcast((*block, budget))
        yield F.pandas_udf(_searcher(sent), MATCHES)("text"), only
        if not only:
            sent.destroy()
        block, following = following, next(each, None)


def leaks(docs: DataFrame, benchmark: DataFrame, *, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, edits, item_chars and shared (q-grams) of every leak."""
    parts = []
    for found, only in blocks(benchmark, budget):
        each = docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")
        if only:
            return each
        parts.append(written(each, "leaks"))
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, *, budget: float = BUDGET) -> DataFrame:
    """The documents that leak nothing, decided row by row."""
    placed, row = located(docs)
    (leaked,) = unused(placed.columns, "_leaks")
    gone = []
    for found, only in blocks(benchmark, budget):
        if only:
            return docs.withColumn(leaked, F.size(found)).filter(F.col(leaked) == 0).drop(leaked)
        gone.append(written(placed.select(*row, F.size(found).alias(leaked)).filter(F.col(leaked) > 0).select(*row), "leaking"))
    return placed.join(reduce(DataFrame.unionByName, gone).distinct(), row, "left_anti").select(*docs.columns)
