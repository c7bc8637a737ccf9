"""Language identification by prediction by partial matching.

For each language a byte context tree up to ``ORDER`` is counted over a bounded sample of labelled documents (at most
about ``SAMPLE`` rows per language, chosen by a hash of their ids; whole texts). A byte costs the code length of its
count in the longest context that has seen it, plus the escapes (method C) from the longer contexts that have not; the
statistics stay frozen while a text is scored. A document gets the language with the shortest code, and as score that
language's posterior under equal priors.

The trees' costs are folded into one table of byte 4-grams per language, looked up in slabs of a fixed number of bytes,
so memory does not depend on a text's length. The model's size is bounded by the sample and sent to the workers.

Defined cases: a null text or one without any letter is ``und`` with score 0, and so is every text if there is no
training row; a null id is not held out; rows that repeat a ``doc_id`` are scored separately; an empty table gives an
empty result; other columns are ignored. Texts are scored in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator  # noqa: TC003 (pandas_udf reads the hints)

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import held_out, unused, written

ORDER = 3
SAMPLE = 400  # training documents per language, about
SLAB = 1 << 19  # bytes scored at a time
UNKNOWN = "und"
EXCESS = 256  # bits above 8 a byte beyond which a text is in none of the languages


def _octets(text: str) -> np.ndarray:
    return np.frombuffer(b"\n" * ORDER + text.lower().encode("utf-8", "replace"), np.uint8)


def _grams(octets: np.ndarray) -> np.ndarray:
    """Code of the ORDER + 1 bytes that end at each byte of the text."""
    wide = octets.astype(np.uint32)
    return wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for lang, part in rows.groupby("lang"):
            code, n = np.unique(np.concatenate([_grams(_octets(t)) for t in part["text"]]), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": code.astype(np.int64), "n": n})


def training_rows(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """About ``per_language`` rows of each language: those whose id hashes below a bound set from the row counts."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # settled, its size is known when the join is planned: texts stay where they are and no language is gathered
    share = written(rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")), "shares")
    point = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    return rows.join(share, "lang").filter(point < F.col("share")).select("lang", "text")


class Trees:
    """Costs in bits of every byte 4-gram under each language's frozen context tree."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        per = [counts[counts["lang"] == lang] for lang in self.langs]
        # orders[k]: sorted codes of k + 1 bytes seen in any language
        codes = np.unique(counts["gram"].to_numpy(np.int64))
        self.seen = [np.unique(codes & ((1 << 8 * (k + 1)) - 1)) for k in range(ORDER + 1)]
        below = np.full((1, len(self.langs)), 8.0)  # order -1: all 256 bytes alike
        self.cost, self.escape = [], []
        for k in range(ORDER + 1):
            contexts = np.unique(self.seen[k] >> 8)
            cost, escape = np.zeros((len(self.seen[k]), len(per))), np.zeros((len(contexts), len(per)))
            for j, rows in enumerate(per):
                gram, where = np.unique(rows["gram"].to_numpy(np.int64) & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
                n = np.bincount(where, rows["n"].to_numpy(float), len(gram))
                at = np.searchsorted(contexts, gram >> 8)
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                left = total + kinds > 0
                escape[left, j] = -np.log2(kinds[left] / (total + kinds)[left])
                shorter = below[:, j] if k == 0 else below[np.searchsorted(self.seen[k - 1], self.seen[k] & ((1 << 8 * k) - 1)), j]
                cost[:, j] = escape[np.searchsorted(contexts, self.seen[k] >> 8), j] + shorter
                cost[np.searchsorted(self.seen[k], gram), j] = -np.log2(n / (total + kinds)[at])
            self.cost.append(cost.astype(np.float32))
            self.escape.append((contexts, escape.astype(np.float32)))
            below = cost
        self._hash()

    def _hash(self) -> None:
        grams = self.seen[ORDER].astype(np.uint32)
        self.bits = max(12, int(len(grams) * 8).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        todo, step = np.arange(len(grams)), 0
        while len(todo):
            at = self._place(grams[todo], step)
            free = self.slot[at] < 0
            at, rows = at[free], todo[free]
            at, first = np.unique(at, return_index=True)
            self.slot[at] = rows[first]
            todo = np.setdiff1d(todo, rows[first])
            step += 1
        self.steps = step

    def _place(self, grams: np.ndarray, step: int) -> np.ndarray:
        mixed = grams * np.uint32(2654435761)
        return ((mixed >> np.uint32(32 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def rows_of(self, grams: np.ndarray) -> np.ndarray:
        """Row of each 4-gram in the cost table, -1 where no language has it."""
        keys = self.seen[ORDER].astype(np.uint32)
        found = self.slot[self._place(grams, 0)]
        wrong = np.flatnonzero((found >= 0) & (keys[found] != grams))
        for step in range(1, self.steps + 1):
            if not len(wrong):
                break
            again = self.slot[self._place(grams[wrong], step)] if step < self.steps else np.full(len(wrong), -1, np.int32)
            found[wrong] = again
            wrong = wrong[(again >= 0) & (keys[again] != grams[wrong])]
        return found

    def _fallback(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Costs of codes of ``order`` + 1 bytes that no language has seen."""
        if order < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        contexts, escape = self.escape[order]
        at = np.minimum(np.searchsorted(contexts, grams >> 8), len(contexts) - 1)
        out = np.where((contexts[at] == grams >> 8)[:, None], escape[at], np.float32(0))
        shorter = grams & ((1 << 8 * order) - 1)
        if order == 0:
            return out + np.float32(8.0)
        seen = self.seen[order - 1]
        at = np.minimum(np.searchsorted(seen, shorter), len(seen) - 1)
        known = seen[at] == shorter
        out[known] += self.cost[order - 1][at[known]]
        out[~known] += self._fallback(shorter[~known], order - 1)
        return out

    def bits_of(self, texts: list[str]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        held, owners, size = [], [], 0

        def flush():
            nonlocal held, owners, size
            if held:
                grams, starts = np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]
                rows = self.rows_of(grams)
                cost = self.cost[ORDER][rows]
                missing = np.flatnonzero(rows < 0)
                cost[missing] = self._fallback(grams[missing].astype(np.int64), ORDER)
                np.add.at(out, owners, np.add.reduceat(cost, starts, axis=0, dtype=np.float64))
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            octets = _octets(text)
            for at in range(0, len(octets) - ORDER, SLAB):
                piece = _grams(octets[at : at + SLAB + ORDER])
                held.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= SLAB:
                    flush()
        flush()
        return out


def train(docs: DataFrame, per_language: int = SAMPLE) -> Trees | None:
    """The context trees of a bounded sample; None if no row can be learned from."""
    counted = training_rows(docs, per_language).mapInPandas(_count, "lang string, gram long, n long")
    counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Trees(counts) if len(counts) else None


def _scorer(sent):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = sent.value
        for texts in batches:
            known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            known &= trees is not None
            pred, best, rate = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if known.any():
                chosen = texts[known].tolist()
                bits = trees.bits_of(chosen)
                pred[known] = np.array(trees.langs, object)[bits.argmin(axis=1)]
                best[known] = 1 / np.exp2(np.minimum(0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
                rate[known] = bits.min(axis=1) / np.array([max(1, len(t.encode("utf-8", "replace"))) for t in chosen])
            yield pd.DataFrame({"lang_pred": pred, "score": best, "bits_per_byte": rate})

    return score


def identify(docs: DataFrame, *, per_language: int = SAMPLE, trees: Trees | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row."""
    trees = trees or train(docs, per_language)
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    score = F.pandas_udf(_scorer(sent), "lang_pred string, score double, bits_per_byte double")
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("s"))
    return scored.select("doc_id", "held_out", "s.lang_pred", "s.score", "s.bits_per_byte")


def _lettered(texts: pd.Series) -> pd.Series:
    return pd.Series([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)


def known(docs: DataFrame, *, per_language: int = SAMPLE) -> DataFrame:
    """The documents in a language that is known, decided row by row; their columns as they were.

    A text without a letter goes, and so does one that no learned language shortens: its shortest code takes over 8 bits
    a byte, by more than ``EXCESS`` bits in all, so that a text of a few letters is not judged by chance. Without a row to
    learn from every text with a letter stays.
    """
    trees = train(docs, per_language)
    if trees is None:
        return docs.filter(F.pandas_udf(_lettered, "boolean")("text"))
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    score = F.pandas_udf(_scorer(sent), "lang_pred string, score double, bits_per_byte double")
    (told,) = unused(docs.columns, "_language")
    over = (F.col(told)["bits_per_byte"] - 8) * F.octet_length("text")
    return docs.withColumn(told, score("text")).filter((F.col(told)["lang_pred"] != UNKNOWN) & (over <= EXCESS)).select(*docs.columns)
