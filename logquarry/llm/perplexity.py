"""Quality classifier: interpolated modified Kneser-Ney over bytes, trained on trusted text.

Trusted text is every document with ``labels.quality`` 1; a quarter of it is held out of the counts. Each language gets its own model of ``ORDER``-byte grams.
Counts are gathered per task and summed by shuffles; discounts, context weights and probabilities of all orders are
DataFrame aggregates and joins over gram-keyed shards, and no model is ever collected or broadcast. For scoring, each
input split states the distinct grams it needs; these meet the probability shards in joins, one per order, backing
off where a gram is unseen; and the split's texts then meet their own answers. A document's perplexity per byte is
compared with its language's quantile over the trusted documents that were held out, and with nothing added to it.

Texts travel twice, once to meet the labels and once, compressed, to meet the answers. A split's distinct grams are bounded by
its size, so no group depends on how many documents a language or source has.

Defined cases: a null language is a language of its own; a language whose trusted text is all held out is
counted on it, and one without held-out text takes its quantile over what was counted; one without trusted text has no perplexity and its
documents are kept; a null or empty text has no perplexity and is not kept; a document labelled twice counts as trusted
if any label says so; rows that repeat a ``doc_id`` are scored separately; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import held_out, written

ORDER = 4
SLAB = 1 << 20
QUANTILE = 0.99
LEAST = 2.0**-32  # probability of a byte that discounts of zero leave none; its logarithm would be null and the text kept


def grams(text: bytes) -> np.ndarray:
    """Code of the ORDER bytes that end at each byte of the text, line breaks standing before it."""
    wide = np.frombuffer(b"\n" * (ORDER - 1) + text, np.uint8).astype(np.int64)
    code = wide[: len(text)]
    for k in range(1, ORDER):
        code = code << 8 | wide[k : len(text) + k]
    return code


def _gathered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of some texts and their counts, a bounded number of bytes at a time."""
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(grams(text))
        size += len(text)
        if size >= SLAB or i + 1 == len(texts):
            more, times = np.unique(np.concatenate(held), return_counts=True)
            code, where = np.unique(np.concatenate([code, more]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, times]), len(code)).astype(np.int64)
            held, size = [], 0
    return code, n


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for (split, lang), part in rows.groupby(["split", "lang"]):
            code, n = _gathered([t.encode("utf-8", "replace") for t in part["text"]])
            yield pd.DataFrame({"split": split, "lang": lang, "gram": code, "n": n})


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, lang (null as empty, others marked), text, and the input split a row lies in."""
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return docs.select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"), split.alias("split"))


def from_files(docs: DataFrame) -> DataFrame:
    """The frame itself if its rows know their input files, else a written copy."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    plain = bool(docs.inputFiles()) and not any(word in plan for word in ("Join", "Aggregate", "Repartition", "Sort", "Window", "Union"))
    return docs if plain else written(docs, "documents")


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: the modified discounts for counts of one, two and more."""
    tally = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    some = counts.groupBy("lang").agg(*tally).withColumn("y", F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0)))
    out = [F.col("lang")]
    for k in (1, 2, 3):
        value = k - (k + 1) * F.col("y") * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
        out.append(F.least(F.greatest(F.coalesce(value, F.lit(k / 2)), F.lit(0.0)), F.lit(float(k))).alias(f"d{k}"))
    return some.select(*out)


def train(top: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 on: (lang, gram, p) of all seen grams, and (lang, context, weight) of all contexts.

    ``top`` holds the summed counts of the full grams (lang, gram, n). Lower orders count the distinct bytes before.
    """
    counts = {ORDER: top}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << 8 * order) - 1)
        counts[order] = written(counts[order + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), f"order{order}")
    models: list[tuple[DataFrame, DataFrame]] = []
    for order in range(1, ORDER + 1):
        discounted = counts[order].join(_discounts(counts[order]), "lang")
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        discounted = discounted.withColumn("off", off).withColumn("context", F.shiftright("gram", 8))
        contexts = discounted.groupBy("lang", "context").agg(F.sum("n").alias("whole"), (F.sum("off") / F.sum("n")).alias("weight"))
        contexts = written(contexts, f"contexts{order}")
        seen = discounted.join(contexts, ["lang", "context"])
        if order == 1:
            lower = F.lit(1 / 256)
        else:
            below = models[-1][0].select("lang", F.col("gram").alias("short"), F.col("p").alias("lower"))
            seen = seen.withColumn("short", F.col("gram").bitwiseAND((1 << 8 * (order - 1)) - 1)).join(below, ["lang", "short"])
            lower = F.col("lower")
        p = (F.col("n") - F.col("off")) / F.col("whole") + F.col("weight") * lower
        models.append((written(seen.select("lang", "gram", p.alias("p")), f"p{order}"), contexts.select("lang", "context", "weight")))
    return models


def answers(asked: DataFrame, models: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """lang, gram, bits of the asked grams: the longest seen order's probability times the weights skipped."""
    found = asked
    p: Column = F.lit(1 / 256)
    for order, (seen, contexts) in enumerate(models, 1):
        mask = (1 << 8 * order) - 1
        found = found.withColumn("_g", F.col("gram").bitwiseAND(mask))
        found = found.join(seen.select("lang", F.col("gram").alias("_g"), F.col("p").alias(f"p{order}")), ["lang", "_g"], "left")
        found = found.withColumn("_c", F.shiftright("_g", 8))
        found = found.join(contexts.select("lang", F.col("context").alias("_c"), F.col("weight").alias(f"w{order}")), ["lang", "_c"], "left").drop("_g", "_c")
        p = F.coalesce(F.col(f"p{order}"), F.coalesce(F.col(f"w{order}"), F.lit(1.0)) * p)
    return found.select("lang", "gram", (-F.log2(F.greatest(p, F.lit(LEAST)))).cast("float").alias("bits"))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for rows in batches:
        yield rows[["split", "doc_id", "lang"]].assign(packed=[press.compress(t.encode("utf-8", "replace")) for t in rows["text"]])


def _score(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    press, out = zstandard.ZstdDecompressor(), []
    tables = {}
    for lang, part in told.groupby("lang"):
        part = part.sort_values("gram")
        tables[lang] = part["gram"].to_numpy(), part["bits"].to_numpy(np.float64)
    for doc_id, lang, packed in zip(texts["doc_id"], texts["lang"], texts["packed"]):
        text = press.decompress(packed) if packed else b""
        bits = None
        if text and lang in tables:
            keys, values = tables[lang]
            bits = sum(values[np.searchsorted(keys, grams(text[max(0, at - ORDER + 1) : at + SLAB])[min(at, ORDER - 1) :])].sum() for at in range(0, len(text), SLAB))
        out.append((doc_id, lang, len(text), bits))
    return pd.DataFrame(out, columns=["doc_id", "lang", "n_bytes", "bits"]).astype({"doc_id": "Int64", "n_bytes": "int64", "bits": "float64"})


def measure(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes and bits of every row; ``trusted`` holds distinct ids of trusted documents."""
    keyed = _keyed(from_files(docs))
    # labels can be as many as documents: the join is a shuffle at every size, rather than a broadcast of small ones only
    text = keyed.join(trusted.hint("merge"), "doc_id", "left_semi").withColumn("split", held_out().cast("long"))
    gathered = text.mapInPandas(_counter, "split long, lang string, gram long, n long")
    both = written(gathered.groupBy("split", "lang", "gram").agg(F.sum("n").alias("n")), "counts")
    first, rest = both.filter("split = 0").drop("split"), both.filter("split = 1").drop("split")
    top = written(first.unionByName(rest.join(first.select("lang").distinct(), "lang", "left_anti")), f"order{ORDER}")
    models = train(top)
    asked = keyed.select("split", "lang", "text").mapInPandas(_counter, "split long, lang string, gram long, n long").select("split", "lang", "gram")
    asked = written(asked.join(top.select("lang").distinct(), "lang", "left_semi").distinct(), "asked")
    told = written(answers(asked.select("lang", "gram").distinct(), models), "answers")
    each = asked.join(told, ["lang", "gram"])
    packed = keyed.mapInPandas(_packed, "split long, doc_id long, lang string, packed binary")
    scored = packed.groupBy("split").cogroup(each.groupBy("split")).applyInPandas(_score, "doc_id long, lang string, n_bytes long, bits double")
    return written(scored, "bits")


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, n_bytes, perplexity (per byte), threshold and kept of every row."""
    trusted = written(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(), "trusted")
    rate = F.col("bits") / F.nullif(F.col("n_bytes"), F.lit(0))
    bits = measure(docs, trusted)
    of = lambda value: F.percentile_approx(value, quantile, 10_000)
    limit = F.coalesce(of(F.when(held_out(), rate)), of(rate))
    limits = bits.join(trusted, "doc_id", "left_semi").groupBy("lang").agg(limit.alias("limit"))
    judged = bits.join(written(limits, "limits"), "lang", "left")
    most = F.when(F.col("n_bytes") > 0, F.col("limit"))
    kept = (F.col("n_bytes") > 0) & F.coalesce(rate <= most, F.lit(True))
    return judged.select("doc_id", "n_bytes", F.pow(F.lit(2.0), rate).alias("perplexity"), F.pow(F.lit(2.0), most).alias("threshold"), kept.alias("kept"))
