"""Exact removal of repeated byte strings by a sparse, range-partitioned suffix sort.

A byte goes if it lies in a ``length``-byte string that starts earlier too (in a smaller document, or earlier in the
same one). Sorting every suffix would move a hundred times the corpus, so suffixes are sorted at anchors only: each
string of ``length`` bytes holds one anchor, the place of its smallest hashed ``GRAM`` bytes, which depends on the
string alone. Consecutive starts with one anchor form a block; about one block per 43 bytes.

1. Blocks are ordered by what the suffix at their anchor leads with (its hash, then the hash of all bytes that the
   block's strings cover), then by place. Spark samples splitters and range-partitions them on that whole order, so
   even a passage in every document is split evenly; each bucket is sorted and read once, and the buckets' first and
   last entries are compared across boundaries. A block equal to an earlier one is a repeat as a whole.
2. Blocks that share their anchor with different surroundings are the edges of repeats. Their covered bytes are
   fetched and the edges of one anchor compare all their strings. Anchors with more than ``CROWD`` edges go the other
   way: their strings are range-partitioned and sorted as in step 1.
3. Each document's repeats are merged and cut out.

Only hashes and positions of blocks are shuffled, beside the texts; nothing is limited or sampled but the splitters.

Defined cases: a null text is empty; a null id comes before all others; rows alike in id and text are one document
and share its result, rows that share only the id are separate documents ordered by a hash of their text; an empty
table gives an empty result; other columns are ignored (``repeats``) or kept (``cut``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator  # noqa: TC003 (pandas_udf reads the hints)

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import scratch, unused, written

LENGTH = 100
GRAM = 16  # bytes whose hash picks an anchor
SLAB = 1 << 18  # bytes hashed at a time, or one document
CROWD = 4096  # edges of one anchor that are compared in one task
KEY = ["doc", "sub"]
PLACE = "hi long, lo long, doc long, sub int, at long"  # at: start << 8 | number of starts

_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substring of a byte array, from one running sum of bytes times powers of an odd number."""

    def __init__(self, octets: np.ndarray):
        global _powers
        if len(_powers[0]) <= len(octets):
            size, back = max(SLAB, len(octets)) + 1, np.uint64(pow(int(_ODD), -1, 1 << 64))
            _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_ODD, back))
        self.sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(octets)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * _powers[1][start] + np.asarray(size, np.uint64))

    def rolling(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:count]) * _powers[1][:count] + np.uint64(size))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def blocks_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, number of starts, anchor hash and hash of the covered bytes, for every block."""
    sizes = np.array([len(t) for t in texts])
    octets = np.frombuffer(b"".join(texts), np.uint8)
    if len(octets) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes = Hashes(octets)
    grams = hashes.rolling(GRAM)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    anchor = (np.uint64(0xFFFFFFFF) - (_least(order, length - GRAM + 1) & np.uint64(0xFFFFFFFF))).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    start = np.flatnonzero(np.arange(length, length + len(anchor)) <= ends[owner])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    anchor = anchor[start]
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    count = np.diff(first, append=len(start))
    begin = start[first]
    which = owner[begin]
    return which, begin - (ends - sizes)[which], count, grams[anchor[first]], hashes.of(begin, count + length - 1)


def _slabs(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    at, held, size = 0, [], 0
    for i, text in enumerate(rows["text"]):
        held.append(text.encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= SLAB or i + 1 == len(rows):
            yield rows.iloc[at : i + 1], held
            at, held, size = i + 1, [], 0


def _blocks(length: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for part, texts in _slabs(rows):
                which, begin, count, hi, lo = blocks_of(texts, length)
                doc, sub = part["doc"].to_numpy()[which], part["sub"].to_numpy()[which]
                yield pd.DataFrame({"hi": hi.view(np.int64), "lo": lo.view(np.int64), "doc": doc, "sub": sub, "at": begin << 8 | count})

    return emit


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads one sorted bucket. kind 0: equal to an earlier entry; 1: first of its kind, beside others with the same
    ``hi``; 2 and 3: the bucket's first entry and the first entry of its last kind."""
    from pyspark import TaskContext

    bucket = TaskContext.get().partitionId()
    carry = None  # the first entry of the kind that was open at the end of the last batch, and whether it is an edge
    for rows in batches:
        if not len(rows):
            continue
        opened = carry is None
        if not opened:
            rows = pd.concat([carry, rows], ignore_index=True)
        hi, lo = rows["hi"].to_numpy(), rows["lo"].to_numpy()
        new_hi = np.diff(hi, prepend=~hi[0]) != 0
        new = new_hi | (np.diff(lo, prepend=~lo[0]) != 0)
        if opened:
            yield rows.iloc[:1].assign(kind=2, bucket=bucket)
        else:
            new_hi[0] = not beside
        first = np.flatnonzero(new)
        lead = first[np.cumsum(new) - 1]  # the first entry of each entry's kind
        own = np.ones(len(rows), bool)
        for name in ("doc", "sub", "at"):
            own &= rows[name].to_numpy() == rows[name].to_numpy()[lead]
        repeated = np.flatnonzero(~own)
        alone = new_hi[first]
        edge = ~alone
        edge[:-1] |= ~alone[1:]
        carry, beside = rows.iloc[first[-1] : first[-1] + 1], not alone[-1]
        yield rows.iloc[repeated].assign(kind=0, bucket=bucket)
        yield rows.iloc[first[:-1][edge[:-1]]].assign(kind=1, bucket=bucket)
    if carry is not None:
        if beside:
            yield carry.assign(kind=1, bucket=bucket)
        yield carry.assign(kind=3, bucket=bucket)


def sorted_runs(places: DataFrame, name: str) -> DataFrame:
    """Kinds 0 and 1 of all entries (see ``_runs``), buckets compared across their boundaries."""
    spark, columns = places.sparkSession, ["hi", "lo", "doc", "sub", "at"]
    bucketed = places.repartitionByRange(*columns).sortWithinPartitions(*columns)
    found = written(bucketed.mapInPandas(_runs, PLACE + ", kind int, bucket int"), name)
    # two rows per bucket: the first entry, and the first entry of the kind that is open at the end
    bounds = found.filter("kind > 1").orderBy("bucket", "kind").collect()
    extra, open_ = [], None
    for head, tail in zip(bounds[::2], bounds[1::2]):
        if open_ is not None and open_["hi"] == head["hi"]:
            if open_["lo"] == head["lo"]:
                if (open_["doc"], open_["sub"], open_["at"]) != (head["doc"], head["sub"], head["at"]):
                    extra.append((*head[:5], 0))
                # the head's kind began in an earlier bucket; where others follow here, that beginning is an edge
                extra.append((*open_[:5], 1))
            else:
                extra += [(*open_[:5], 1), (*head[:5], 1)]
        same = open_ is not None and (open_["hi"], open_["lo"]) == (tail["hi"], tail["lo"])
        open_ = open_ if same else tail
    told = found.filter("kind < 2").select(*columns, "kind")
    return told.unionByName(spark.createDataFrame(extra, PLACE + ", kind int").coalesce(1)) if extra else told


def _covered(length: int):
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, sub, text, edges in zip(rows["doc"], rows["sub"], rows["text"], rows["edges"]):
                octets = text.encode("utf-8", "replace")
                for edge in edges:
                    start, count = edge["at"] >> 8, edge["at"] & 255
                    out.append((edge["hi"], doc, sub, start, octets[start : start + count + length - 1]))
            yield pd.DataFrame(out, columns=["hi", "doc", "sub", "start", "octets"])

    return fetch


def _strings(rows: pd.DataFrame, length: int):
    """Every string of the rows' bytes: offset in their concatenation, row number, start, and its hash."""
    octets = np.frombuffer(b"".join(rows["octets"]), np.uint8)
    sizes = np.array([len(o) for o in rows["octets"]])
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), counts)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    offset = (np.cumsum(sizes) - sizes)[row] + inner
    return octets, row, rows["start"].to_numpy()[row] + inner, offset, Hashes(octets).of(offset, length)


def _compare(length: int):
    """Edges in the order of their anchors: strings that an earlier edge of the same anchor has too, as runs."""

    def repeats(rows: pd.DataFrame) -> pd.DataFrame:
        octets, row, start, offset, value = _strings(rows, length)
        group, doc, sub = (rows[c].to_numpy()[row] for c in ("hi", "doc", "sub"))
        order = np.lexsort((start, sub, doc, value, group))
        group, value, doc, sub, start, offset = (x[order] for x in (group, value, doc, sub, start, offset))
        new = (np.diff(group, prepend=~group[0]) != 0) | (np.diff(value, prepend=~value[0]) != 0)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = np.flatnonzero((doc != doc[lead]) | (sub != sub[lead]) | (start != start[lead]))
        same = np.ones(len(again), bool)
        for k in range(length):  # equal hashes are checked byte by byte
            same &= octets[offset[again] + k] == octets[offset[lead[again]] + k]
        again = again[same]
        again = again[np.lexsort((start[again], sub[again], doc[again]))]
        doc, sub, start = doc[again], sub[again], start[again]
        cut = np.flatnonzero((np.diff(doc, prepend=0) != 0) | (np.diff(sub, prepend=0) != 0) | (np.diff(start, prepend=0) > 1) | (np.arange(len(doc)) == 0))
        last = np.append(cut[1:], len(doc)) - 1 if len(doc) else cut
        return pd.DataFrame({"doc": doc[cut], "sub": sub[cut], "begin": start[cut], "end": start[last] + length})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for rows in batches:
            if not len(rows):
                continue
            rows = rows if kept is None else pd.concat([kept, rows], ignore_index=True)
            whole = rows["hi"].to_numpy() != rows["hi"].iloc[-1]
            kept = rows[~whole]
            if whole.any():
                yield repeats(rows[whole])
        if kept is not None:
            yield repeats(kept)

    return run


def _crowded(length: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 2_000):
                part = rows.iloc[at : at + 2_000]
                _, row, start, offset, value = _strings(part, length)
                second = [hashlib.blake2b(o, digest_size=8).digest() for o in _each(part, length)]
                lo = np.frombuffer(b"".join(second), np.int64)
                yield pd.DataFrame({"hi": value.view(np.int64), "lo": lo, "doc": part["doc"].to_numpy()[row], "sub": part["sub"].to_numpy()[row], "at": start << 8 | 1})

    return emit


def _each(rows: pd.DataFrame, length: int) -> Iterator[bytes]:
    for octets in rows["octets"]:
        for k in range(len(octets) - length + 1):
            yield octets[k : k + length]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.hash(text).alias("sub"), text.alias("text"))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, sub, spans: each document's repeated stretches (begin, end) in bytes, unmerged."""
    with scratch(docs.sparkSession) as held:
        return held.keep(_spans(docs, length))


def _spans(docs: DataFrame, length: int) -> DataFrame:
    keyed = _keyed(docs)
    found = sorted_runs(keyed.mapInPandas(_blocks(length), PLACE), "blocks")
    whole = found.filter("kind = 0").select(*KEY, F.shiftright("at", 8).alias("begin"), (F.shiftright("at", 8) + F.col("at").bitwiseAND(255) + length - 1).alias("end"))
    edges = written(found.filter("kind = 1").select("hi", *KEY, "at").distinct(), "edges")
    wanted = edges.groupBy(*KEY).agg(F.collect_list(F.struct("hi", "at")).alias("edges"))
    texts = keyed.join(written(wanted, "wanted"), KEY)
    covered = written(texts.mapInPandas(_covered(length), "hi long, doc long, sub int, start long, octets binary"), "covered")
    crowds = edges.groupBy("hi").count().filter(F.col("count") > CROWD).select("hi")
    crowds = written(crowds, "crowds")
    few = covered.join(crowds, "hi", "left_anti").repartition("hi").sortWithinPartitions("hi")
    near = few.mapInPandas(_compare(length), "doc long, sub int, begin long, end long")
    parts = [whole, near]
    if not crowds.isEmpty():
        many = covered.join(crowds, "hi", "left_semi").mapInPandas(_crowded(length), PLACE)
        again = sorted_runs(many, "crowded").filter("kind = 0")
        parts.append(again.select(*KEY, F.shiftright("at", 8).alias("begin"), (F.shiftright("at", 8) + length).alias("end")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return written(both.groupBy(*KEY).agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")


def merged(stretches) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in stretches):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def _kept(octets: bytes, stretches: list[list[int]]) -> bytes:
    ends = [0, *(end for _, end in stretches)]
    return b"".join(octets[a:b] for a, b in zip(ends, [*(begin for begin, _ in stretches), len(octets)]))


def _digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, found in zip(texts, spans):
        octets, stretches = text.encode("utf-8", "replace"), merged(found if found is not None else ())
        kept = _kept(octets, stretches)
        out.append((len(octets), len(octets) - len(kept), len(stretches), hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The kept bytes as text; a character cut in two loses its other half as well."""
    out = [None if t is None else _kept(t.encode("utf-8", "replace"), merged(s if s is not None else ())).decode("utf-8", "ignore") for t, s in zip(texts, spans)]
    return pd.Series(out, dtype=object)


def _key_of(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"], F.lit(-(1 << 63))), F.hash(F.coalesce(docs["text"], F.lit("")))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    found = spans(docs, length)
    doc, sub = _key_of(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), doc.alias("doc"), sub.alias("sub"))
    digest = F.pandas_udf(_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rows = rows.join(found, KEY, "left").select("doc_id", digest("text", "spans").alias("d"))
    return rows.select("doc_id", "d.*")


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated stretches cut out; other columns as they were."""
    key, sub, spans_, k1, k2 = unused(docs.columns, "_doc", "_sub", "_spans", "_k1", "_k2")
    found = spans(docs, length).select(F.col("doc").alias(key), F.col("sub").alias(sub), F.col("spans").alias(spans_))
    rows = docs.withColumns(dict(zip((k1, k2), _key_of(docs))))
    rows = rows.join(found, (F.col(k1) == F.col(key)) & (F.col(k2) == F.col(sub)), "left")
    whole = F.col(spans_).isNull()
    changed = {"text": F.when(whole, F.col("text")).otherwise(F.pandas_udf(_cut, "string")("text", spans_))}
    kept = rows.withColumns(changed)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(*docs.columns)
