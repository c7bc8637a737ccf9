"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints are the 64-bit majority vote of the shingles' XXH64 values. Distinct fingerprints form an adaptive trie:
a node with many fingerprints is split by its next bits, a node with few is a leaf. Node pairs are traversed together,
level by level, as DataFrame joins: a pair carries the number of bits in which its two prefixes differ and is pruned as
soon as that exceeds the budget. Only surviving leaf pairs compare members, in blocks of bounded size.

Copies share a fingerprint and are one row of the trie, so a group of copies costs nothing however large it is; a
dense part of the fingerprint space only makes the trie deeper there. All tables between levels are written to the
shared folder. Defined cases: a null or empty text has fingerprint 0 and is linked like any other; rows that repeat
a ``doc_id`` stay separate rows; a null ``doc_id`` never becomes a component's name unless all its ids are null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import components, joined, located, scratch, written

SEED = 42  # of XXH64
STEP = 4  # bits per trie level
LEAF = 512  # fingerprints in a leaf at most (a full-depth node holds one)
SLAB = 1 << 16  # shingles whose bits are counted at a time


def shingles(text: str | None, width: int) -> list[bytes]:
    """Space-joined runs of ``width`` lower-cased words, repeats included; one shorter run if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def vote(hashes: np.ndarray) -> int:
    """Bits set in over half of the values, as a signed 64-bit integer; zero for no values."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLAB):
        octets = hashes[at : at + SLAB].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, width: int) -> int:
    from xxhash import xxh64_intdigest

    grams = shingles(text, width)
    return vote(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)))


def fingerprints(docs: DataFrame, width: int = 3, others: Iterable[str] = ()) -> DataFrame:
    """(doc_id, others, fp) for every row; ``fp`` is the signed form of the 64 bits."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select("doc_id", *others, prints("text").alias("fp"))


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def trie(prints: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels' nodes (family, up, node, leaf) below the roots, and the leaves (family, depth, node, members).

    ``prints`` has family (one root for each) and fp. A level only looks at the fingerprints whose parent was split.
    """
    levels, leaves, inside, depth = [], [], prints, 0
    while depth < 64:
        depth += STEP
        counted = inside.groupBy("family", _prefix(depth).alias("node")).agg(F.count("*").alias("n"))
        leaf = (F.col("n") <= LEAF) if depth < 64 else F.lit(True)
        nodes = written(counted.select("family", F.shiftrightunsigned("node", STEP).alias("up"), "node", leaf.alias("leaf")), "trie")
        keyed = inside.withColumn("node", _prefix(depth)).join(nodes.select("family", "node", "leaf"), ["family", "node"])
        held = keyed.filter("leaf").groupBy("family", "node").agg(F.collect_list("fp").alias("members"))
        leaves.append(held.withColumn("depth", F.lit(depth)))
        levels.append(nodes)
        inside = written(keyed.filter("not leaf").select("family", "fp"), "inside")
        if inside.isEmpty():
            break
    return levels, written(reduce(DataFrame.unionByName, leaves), "leaves")


def leaf_pairs(levels: list[DataFrame], budget: int) -> DataFrame:
    """(family, da, a, db, b) leaf pairs whose prefixes differ in at most ``budget`` bits, each unordered pair once."""
    node = "struct<depth:int,node:bigint,leaf:boolean>"
    root = F.expr("named_struct('depth', 0, 'node', 0L, 'leaf', false)").cast(node)
    frontier = levels[0].select("family").distinct().select("family", root.alias("a"), root.alias("b"), F.lit(0).alias("diff"))
    done = []
    for level, nodes in enumerate(levels, 1):
        child = F.struct(F.lit(level * STEP).alias("depth"), F.col("node"), F.col("leaf"))
        done.append(frontier.filter("a.leaf and b.leaf").select("family", "a", "b"))
        both = frontier.filter("not a.leaf and not b.leaf").withColumn("ua", F.col("a.node")).withColumn("ub", F.col("b.node"))
        both = both.join(nodes.select("family", F.col("up").alias("ua"), child.alias("ka")), ["family", "ua"])
        kids = nodes.select(F.col("family").alias("fb"), F.col("up").alias("vb"), child.alias("kb"))
        differ = F.col("diff") + F.bit_count(F.col("ka.node").bitwiseXOR(F.col("kb.node")).bitwiseAND((1 << STEP) - 1))
        near = (F.col("family") == F.col("fb")) & (F.col("ub") == F.col("vb")) & (differ <= budget) & (F.col("ka.node") <= F.col("kb.node"))
        both = both.join(kids, near).select("family", F.col("ka").alias("a"), F.col("kb").alias("b"), differ.cast("int").alias("diff"))
        # a leaf has no further bits to compare: it meets every child of the other node
        mixed = frontier.filter("a.leaf <> b.leaf").select(
            "family",
            F.when(F.col("a.leaf"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.when(F.col("a.leaf"), F.col("b.node")).otherwise(F.col("a.node")).alias("ub"),
            "diff",
        )
        mixed = mixed.join(nodes.select("family", F.col("up").alias("ub"), child.alias("b")), ["family", "ub"])
        frontier = written(both.unionByName(mixed.select("family", "a", "b", "diff")), "pairs")
    done.append(frontier.filter("a.leaf and b.leaf").select("family", "a", "b"))
    pairs = reduce(DataFrame.unionByName, done)
    return pairs.select("family", F.col("a.depth").alias("da"), F.col("a.node").alias("a"), F.col("b.depth").alias("db"), F.col("b.node").alias("b"))


def _compare(budget: int):
    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            families, u, v = [], [], []
            for family, same, a, b in zip(rows["family"], rows["same"], rows["left"], rows["right"]):
                a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
                near = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= budget
                i, j = np.nonzero(near)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                keys = a if same else np.concatenate([a, b])
                label = joined(i, j if same else j + len(a), len(keys))
                moved = np.flatnonzero(label != np.arange(len(keys)))
                families.append(np.full(len(moved), family))
                u.append(keys[moved])
                v.append(keys[label[moved]])
            if u:
                yield pd.DataFrame({"family": np.concatenate(families), "u": np.concatenate(u), "v": np.concatenate(v)})

    return close


def links(prints: DataFrame, budget: int) -> DataFrame:
    """(family, u, v): links that join exactly the fingerprints that differ in at most ``budget`` bits.

    ``prints`` holds the distinct (family, fp). A pair of leaves gives a link per member at most: the members that its
    own links connect are joined to the first of them, so a dense group doesn't give all its pairs.
    """
    levels, leaves = trie(prints)
    pairs = written(leaf_pairs(levels, budget), "leafpairs")
    left = leaves.select("family", F.col("depth").alias("da"), F.col("node").alias("a"), F.col("members").alias("left"))
    right = leaves.select("family", F.col("depth").alias("db"), F.col("node").alias("b"), F.col("members").alias("right"))
    met = pairs.join(left, ["family", "da", "a"]).join(right, ["family", "db", "b"])
    met = met.select("family", ((F.col("da") == F.col("db")) & (F.col("a") == F.col("b"))).alias("same"), "left", "right")
    return met.mapInPandas(_compare(budget), "family int, u long, v long")


def linked_prints(classes: DataFrame, budget: int) -> DataFrame:
    """(fp, root) of the fingerprints that are linked with another; ``root`` is the smallest of a component."""
    single = classes.select(F.lit(0).alias("family"), "fp")
    return components(links(single, budget), "u", "v").withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, *, width: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; components link fingerprints within ``budget`` bits."""
    with scratch(docs.sparkSession) as held:
        prints = held.keep(written(fingerprints(docs, width), "prints"))
        classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
        named = classes.join(linked_prints(classes, budget), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        named = written(named, "named")
        roots = written(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
        member = held.keep(written(named.join(roots, "root").select("fp", "component_id"), "members"))
    return prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, width: int = 3, budget: int = 2) -> DataFrame:
    """The documents with one row of each group of near copies, the one with the smallest id; see ``near_duplicates``.

    Every row is judged for itself, by its place in its file: a row without an id goes if it is a copy of one that has an
    id, and of rows alike in id, or all without one, the one read first stays. All columns are kept as they were.
    """
    placed, place = located(docs)
    with scratch(docs.sparkSession) as held:
        prints = written(fingerprints(placed, width, place), "prints")
        # null ids come last, and rows of one fingerprint meet as partial aggregates
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *place)).alias("first")
        classes = written(prints.groupBy("fp").agg(first), "classes")
        linked = linked_prints(classes, budget)
        best = classes.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
        kept = held.keep(written(best.select(*(F.col(f"first.{c}").alias(c) for c in place)), "kept"))
    return placed.join(kept, place, "left_semi").select(*docs.columns)
