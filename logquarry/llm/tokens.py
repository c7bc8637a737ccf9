"""Token counts through a digest cache.

A text's count is a function of its content and of the tokenizer file, so it is stored once under both digests. A run
joins the table's distinct contents to the stored counts, encodes only the misses, appends them to the cache and joins
every document to its count by digest. Copies meet as partial aggregates, so a text that fills a third of the table is
encoded once and never gathered.

Defined cases: a null text counts as empty; an empty text has 0 tokens; rows that repeat a ``doc_id`` are counted
separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import written
from logquarry.session import shared_dir

LIMIT = 1024
LONG_RUN = re.compile(r"\s{10000}")  # the ranks' splitter goes back over blanks
CACHE = "digest string, tokenizer string, n_tokens long"


def version_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class JsonCounter:
    """Counts as the ``tokenizers`` library does for its file.

    A byte-level BPE file whose ids rise with its merges is a table of ranks; such a vocabulary is encoded by the
    faster ``tiktoken``. One text of every batch is checked against the library; should it ever differ, the library counts
    the batch and all that follow. It also counts texts that the ranks cannot encode, such as one with a blank run beyond
    what the splitter's stack holds, and all texts under other files.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.ranked = ranked_vocabulary(path)

    def __call__(self, texts: list[str]) -> list[int]:
        if self.ranked is not None and texts and self._by_ranks(texts[0]) != self._by_library(texts[0]):
            self.ranked = None
        if self.ranked is None or not texts:
            return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._by_ranks(t) for t in texts]

    def _by_library(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _by_ranks(self, text: str) -> int:
        if not LONG_RUN.search(text):
            try:
                return self.ranked.encode_to_numpy(text, allowed_special="all").size
            except ValueError:  # the splitter gives up
                pass
        return self._by_library(text)


def ranked_vocabulary(path: str):
    """The file's vocabulary as an encoding by ranks, or None where it is more than that."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = spec.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges"))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    odd = odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
    if not plain or odd or merged != sorted(merged) or -1 in merged:
        return None
    # printable bytes stand for themselves in the file, the others for the code points from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the byte-level splitter's
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class PieceCounter:
    """Counts by the ``sentencepiece`` library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]


_COUNTERS: dict[tuple[str, str], object] = {}


def counter(path: str, version: str):
    key = (path, version)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = JsonCounter(path) if path.endswith(".json") else PieceCounter(path)
    return _COUNTERS[key]


def _encoder(path: str, version: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path, version)
        for rows in batches:
            yield pd.DataFrame({"digest": rows["digest"], "tokenizer": version, "n_tokens": count(rows["text"].tolist())})

    return encode


def count_tokens(docs: DataFrame, tokenizer: str, *, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    ``tokenizer`` is a .json or .model file that every executor has; ``cache`` a folder shared by all of them, a new
    one if it is not given.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    cache = cache or shared_dir(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # makes it readable when new
    stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.sha2("text", 256))
    known = written(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored.select("digest"), "digest", "left_anti").select("digest", "text")
    misses.mapInPandas(_encoder(tokenizer, version), CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).dropDuplicates(["digest"])
    counts = written(counts.select("digest", "n_tokens"), "counts")
    joined = known.join(counts, "digest")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
