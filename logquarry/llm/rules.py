"""Quality rules with adaptive thresholds, in DataFrame operations only.

Fixed cutoffs fit one language or source and fail the next, so each (language, source) gets its own fences: mergeable
quantile sketches of three rates (symbols per word, repeated lines per word, characters per word) give the quartiles,
and a document outside ``FENCE`` interquartile ranges, plus a slack that allows for the sampling error of short
documents, is rejected. The sketches are partial aggregates of fixed size, so a hot source costs no more than others;
the fences, one row per group, are joined to the measured rows.

Defined cases: a null or empty text has no words and fails the base rule; a null language or source is a group of its
own; rows that repeat a ``doc_id`` are measured and judged separately; an empty table gives an empty result; other
columns are ignored. Two 5-word windows count as equal if their 64-bit hashes are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import BLANKS, WORD, computed, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
FENCE = 3.0  # interquartile ranges beyond a quartile
ACCURACY = 10_000  # of the sketches: rank error 1 / ACCURACY
LEAST_WORDS, MOST_REPEATED = 10, 20  # base rule: words, per cent of repeated words
#: rate: (slack for any length, slack times words for short documents, slack times sqrt(words) for means)
SLACK = {"symbol_rate": (0.1, 2.0, 0.0), "line_rate": (0.02, 2.0, 0.0), "word_length": (0.3, 0.0, 9.0)}


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = computed(
        docs,
        {
            "doc_id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source"),
            "word_chars": F.length(_without(text, BLANKS)).cast("long"),
            "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
            "lines": F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0),
            "words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        },
    )
    n = F.size("words")
    window = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    counted = computed(
        base,
        {
            **{name: F.col(name) for name in ("doc_id", "lang", "source", "word_chars", "n_symbols")},
            "n_words": n.cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "hashes": hashes,
        },
    )
    placed = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    kept = ("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    sorted_ = computed(counted, {**{name: F.col(name) for name in kept}, "placed": placed})
    same = lambda e, j: F.coalesce(F.get("placed", j)["h"] == e["h"], F.lit(False))
    repeated = F.filter("placed", lambda e, j: same(e, j - 1) | same(e, j + 1))
    at = F.sort_array(F.transform(repeated, lambda e: e["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
    )
    return sorted_.select(*kept, F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def _rates() -> dict[str, Column]:
    n = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    return {"symbol_rate": F.col("n_symbols") / n, "line_rate": F.col("n_dup_lines") / n, "word_length": F.col("word_chars") / n}


def fences(measured: DataFrame, fence: float = FENCE, accuracy: int = ACCURACY) -> DataFrame:
    """lang, source and, for each rate, low and high: the quartiles moved out by ``fence`` interquartile ranges."""
    quartiles = [F.percentile_approx(rate, [0.25, 0.75], accuracy).alias(name) for name, rate in _rates().items()]
    sketched = measured.filter(~base_failed()).groupBy("lang", "source").agg(*quartiles)
    out = []
    for name in SLACK:
        q1, q3 = F.col(name)[0], F.col(name)[1]
        out += [(q1 - fence * (q3 - q1)).alias(f"{name}_low"), (q3 + fence * (q3 - q1)).alias(f"{name}_high")]
    return sketched.select("lang", "source", *out)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed, the three rates and kept."""
    named = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in limits.columns if c not in ("lang", "source")])
    joined = measured.join(named, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    n, inside = F.nullif(F.col("n_words"), F.lit(0)).cast("double"), F.lit(True)
    for name, (flat, per_word, per_root) in SLACK.items():
        slack = flat + per_word / n + per_root / F.sqrt(n)
        inside = inside & _rates()[name].between(F.col(f"{name}_low") - slack, F.col(f"{name}_high") + slack)
    judged = joined.withColumn("base_failed", base_failed()).withColumns(_rates())
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality(docs: DataFrame, *, fence: float = FENCE, accuracy: int = ACCURACY) -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, kept and the rates."""
    measured = written(measure(docs), "measures")
    limits = written(fences(measured, fence, accuracy), "fences")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *SLACK)
    return judge(measured, limits).select(*columns)
