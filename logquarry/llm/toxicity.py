"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

Sentences get a logistic score from hashed words and word beginnings; a document's score is their noisy-or, one minus
the product of the sentences' complements. Only documents are labelled: the gradient of the document's likelihood
spreads its label over its sentences in proportion to how much each one explains it, so the trained model also locates
the offending sentences. It is fitted on a bounded sample of labelled rows (about ``SAMPLE`` of each label, whole
texts of ``MOST_BYTES`` at most); every document is then scored in whole, in Arrow batches.

Defined cases: a null or empty text is scored as one empty sentence; a null id is not held out; null labels teach
nothing, and if a document is labelled twice the higher label counts; without a positive label every score is the
untrained one; rows that repeat a ``doc_id`` are scored separately; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator  # noqa: TC003 (pandas_udf reads the hints)
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import held_out, written

SAMPLE = 3_500  # training documents per label, about
MOST_BYTES = 1 << 15  # of a training document: longer ones are scored, but teach nothing, so the sample has bounded bytes
BUCKETS = 1 << 18
HEADS = (4, 5, 6, 7, 8)  # bytes of a word's beginnings
START, ROUNDS, CURVATURE, LASSO = -4.0, 160, 0.3, 1.5e-4
TOXIC_WEIGHT = 3.0  # of a toxic document's loss: a miss is worse than a false alarm
LEAST = 3  # occurrences of a feature in the sample
THRESHOLD = 0.3
REMEMBERED = 300_000  # words a worker keeps scores of

_ENDS = b".!?\n"
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 10 if c in _ENDS else 32 for c in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence in lower case; sentences end at a full stop, ``!``, ``?`` or line break."""
    cut = (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split(b"\n")
    return [words for words in map(bytes.split, cut) if words] or [[]]


def features(word: bytes) -> list[int]:
    return [crc32(word) % BUCKETS, *(crc32(b"^" + word[:n]) % BUCKETS for n in HEADS if n <= len(word))]


def fit(texts: list[str], labels: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept: accelerated proximal steps with a lasso on the weighted mean document loss."""
    ids, sizes, owners = [], [], []
    for i, text in enumerate(texts):
        for words in sentences(text):
            own = [f for w in words for f in features(w)]
            ids.append(np.array(own, np.int32))
            sizes.append(len(own))
            owners.append(i)
    ids, sizes, owners = np.concatenate(ids), np.array(sizes), np.array(owners)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    common = np.bincount(ids, minlength=BUCKETS)[ids] >= LEAST
    ids, sentence = ids[common], sentence[common].astype(np.int32)
    first = np.flatnonzero(np.diff(owners, prepend=-1))
    share = importance * np.where(labels == 1, TOXIC_WEIGHT, 1.0) / importance.sum()
    weights = ahead = np.zeros(BUCKETS)
    bias = bias_ahead = START
    pace = 1.0
    for _ in range(ROUNDS):
        z = bias_ahead + np.bincount(sentence, ahead[ids], len(sizes))
        p = 0.5 * (1 + np.tanh(z / 2))
        none = np.exp(-np.add.reduceat(np.logaddexp(0, z), first))  # chance that no sentence offends
        pull = np.where(labels == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * share
        slope = p * pull[owners]
        moved = ahead - np.bincount(ids, slope[sentence], BUCKETS) / CURVATURE
        new = np.sign(moved) * np.maximum(0, np.abs(moved) - LASSO / CURVATURE)
        new_bias = bias_ahead - 0.1 * slope.sum() / CURVATURE
        later = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        if ((ahead - new) * (new - weights)).sum() > 0:  # the momentum overshoots: start it anew
            later, ahead, bias_ahead = 1.0, new, new_bias
        else:
            ahead, bias_ahead = new + (pace - 1) / later * (new - weights), new_bias + (pace - 1) / later * (new_bias - bias)
        weights, bias, pace = new, new_bias, later
    return weights, float(bias)


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)
    rows = pd.concat(held, ignore_index=True) if held else None
    if held and len(rows) and rows["toxic"].nunique() > 1:
        rows = rows.sort_values("doc_id")
        weights, bias = fit(rows["text"].tolist(), rows["toxic"].to_numpy(), rows["importance"].to_numpy())
        at = np.flatnonzero(weights)
        yield pd.DataFrame({"bucket": [*at, -1], "weight": [*weights[at], bias]})


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic and importance (one over the sampled share) of about ``per_label`` documents of each label."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = written(marked.groupBy("toxic").agg((F.lit(float(per_label)) / F.count("*")).alias("share")), "shares")
    point = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    chosen = marked.join(share, "toxic").filter(point < F.col("share"))
    chosen = written(chosen.select("doc_id", "toxic", (1 / F.least("share", F.lit(1.0))).alias("importance")), "labelled")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= MOST_BYTES)
    return texts.join(F.broadcast(chosen), "doc_id")  # a bounded number of ids


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> tuple[dict[int, float], float]:
    """Non-zero weights by bucket, and the intercept. The sample is bounded, so one task fits it."""
    rows = written(training_rows(docs, labels, per_label), "sample")
    model = {int(b): float(w) for b, w in rows.coalesce(1).mapInPandas(_fit_rows, "bucket long, weight double").toPandas().itertuples(index=False)}
    return model, model.pop(-1, START)


def _scorer(sent):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, bias = sent.value
        known: dict[bytes, float] = {}

        class Scores(dict):
            def __missing__(self, word: bytes) -> float:
                value = self[word] = sum(weights.get(f, 0.0) for f in features(word))
                return value

        known = Scores()
        for texts in batches:
            out, found = np.empty(len(texts)), []
            for i, text in enumerate(texts):
                z = bias + np.array([sum(map(known.__getitem__, words)) for words in sentences(text)])
                out[i] = -np.expm1(-np.logaddexp(0, z).sum())
                found.append(np.flatnonzero(z >= 0).astype(np.int32))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pd.DataFrame({"score": out, "offending": found})

    return score


def score(docs: DataFrame, labels: DataFrame, *, per_label: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and offending (numbers of the sentences that are toxic on their own)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_label))
    scored = docs.select("doc_id", held_out().alias("held_out"), F.pandas_udf(_scorer(sent), "score double, offending array<int>")("text").alias("s"))
    return scored.select("doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.offending")
