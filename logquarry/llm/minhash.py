"""MinHash near-duplicates with b-bit signatures, verified on whole sets.

A document's set holds the 64-bit codes of its distinct word shingles; documents with the same set are one class. Each
of ``BANDS`` x ``ROWS`` orders gives a minimum. Runs of ``ROWS`` minima are hashed into band keys, and classes that
share a key are candidates. Of every minimum only the lowest ``BITS`` bits are kept, packed into 64-bit words: two
signatures are compared by bit counts, and as unequal minima agree in those bits by chance, the similarity they tell is
``(share - c) / (1 - c)`` with ``c = 2 ** -BITS``. Candidates whose signatures agree in fewer places than a pair at the
threshold does in all but ``DOUBT`` of cases are dropped; the others are confirmed on their whole sets.

Candidates are met without pairing a group. In each round one class of every bucket, a member of the bucket's largest
part, meets the bucket's classes outside its part; what is confirmed joins parts, the class leaves the bucket (it has met
everyone), and buckets of one part are done. A group of copies of one text is joined in the first rounds, at a cost in
proportion to its size. When buckets are no longer crowded, or rounds stop paying, the classes that are still apart in a
bucket meet in blocks of bounded size, where signatures, then whole sets decide every pair, and only links that connect leave the task: at most one for
each class, however many pairs are alike.

A pair at the threshold shares no band in (1 - alike^ROWS)^BANDS = 2.6e-8 of cases and is dropped by its signature in
``DOUBT``; no other step loses a link. Texts are read where they lie: a row is known by its file and its number there,
and one shuffle brings the texts of candidate classes together.

Defined cases: a null text or one without words has an empty set and is linked with nothing; a text of fewer words than
a shingle has one element; a null ``doc_id`` names a component only if it holds no other id; rows that repeat a ``doc_id``
are rows of their own; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import by_groups, components, joined, located, scratch, written

WIDTH, ALIKE = 2, 80  # words in a shingle, and per cent of the union that the intersection has to hold
BANDS, ROWS, BITS = 44, 5, 2
SEED = 42
DOUBT = 1e-9
BLOCK = 1 << 18  # codes in the sets of a block, about; two blocks meet in one task
COLUMNS = 1 << 11  # codes counted at a time where blocks meet
CROWD = 4096  # partners that share one copy of a text when pairs are confirmed
CROWDED = 1024  # open pairs for each row of a bucket from which on another round is cheaper than blocks
PAYS = 0.8  # a round pays if it leaves at most this share of the open pairs
SLAB = 1 << 12  # codes whose orders are taken at a time

_PLACES = BANDS * ROWS
_PER_WORD = 64 // BITS
_WORDS = -(-_PLACES // _PER_WORD)
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONES = sum(1 << BITS * i for i in range(_PER_WORD))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the runs of ``width`` lower-cased words; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    hashes = np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    n = max(0, len(words) - width + 1) or min(1, len(words))
    code = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        code = (code ^ (code >> np.uint64(31))) * _STEP + hashes[k : k + n]
    return np.unique((code ^ (code >> np.uint64(32))) * _STEP)


def minima(codes: np.ndarray) -> np.ndarray:
    """The least value of the set under each order. The upper half of a product decides the order; folded into the lower
    half it makes low bits that differ from order to order."""
    low = np.full(_PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), SLAB):
        low = np.minimum(low, (_FACTORS[:, None] * codes[None, at : at + SLAB]).min(axis=1))
    return low ^ (low >> np.uint64(32))


def band_keys(low: np.ndarray) -> np.ndarray:
    """A hash of each band's minima and of the band's number."""
    out = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        out = (out ^ (out >> np.uint64(29))) * _STEP + row
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest bits of all minima, side by side in 64-bit words."""
    bits = np.zeros(_WORDS * _PER_WORD, np.uint64)
    bits[:_PLACES] = low & np.uint64((1 << BITS) - 1)
    shifts = np.arange(_PER_WORD, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(bits.reshape(_WORDS, _PER_WORD) << shifts, axis=1).view(np.int64)


def agreeing(left: Column, right: Column) -> Column:
    """In how many places two packed signatures agree, by bit counts."""
    differ = []
    for k in range(_WORDS):
        both = left[k].bitwiseXOR(right[k])
        folded = reduce(Column.bitwiseOR, (F.shiftrightunsigned(both, b) for b in range(1, BITS)), both)
        differ.append(F.bit_count(folded.bitwiseAND(F.lit(_ONES if _ONES < 1 << 63 else _ONES - (1 << 64)).cast("long"))))
    return _PLACES - sum(differ[1:], differ[0])


def estimate(agree: float) -> float:
    """The similarity that ``agree`` places tell, corrected for chance agreement."""
    chance = 2.0**-BITS
    return (agree / _PLACES - chance) / (1 - chance)


def least_agreeing(alike: int, doubt: float = DOUBT) -> int:
    """The largest number of places below which a pair of ``alike`` per cent falls in at most ``doubt`` of cases."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * alike / 100
    below, k = 0.0, 0
    while (below := below + math.comb(_PLACES, k) * p**k * (1 - p) ** (_PLACES - k)) <= doubt:
        k += 1
    return k


def _profiles(width: int):
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh128_hexdigest

        for texts in batches:
            out = []
            for text in texts:
                codes = shingle_set(text, width)
                low = minima(codes) if len(codes) else None
                keys, signature = ([], []) if low is None else (band_keys(low).tolist(), packed(low).tolist())
                out.append((xxh128_hexdigest(codes.tobytes(), SEED), len(codes), keys, signature))
            yield pd.DataFrame(out, columns=["name", "n", "keys", "signature"])

    return F.pandas_udf(profile, "name string, n long, keys array<long>, signature array<long>")


def _confirmed(width: int, alike: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}  # the set of the right side last used: partners of one text lie together
        for rows in batches:
            near = np.zeros(len(rows), bool)
            for k, (v, left, right) in enumerate(zip(rows["v"], rows["left"], rows["right"])):
                if v not in held:
                    held = {v: shingle_set(right, width)}
                a, b = shingle_set(left, width), held[v]
                both = len(np.intersect1d(a, b, assume_unique=True))
                near[k] = 100 * both >= alike * (len(a) + len(b) - both)
            yield rows.loc[near, ["u", "v"]]

    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, alike: int) -> DataFrame:
    """Those of the pairs (u, v) of classes whose whole sets are alike. A text with many partners is sent once for every
    ``CROWD`` of them, so the partners of one text never meet in one task."""
    share = written(pairs.groupBy("v").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("copies")), "copies")
    salted = pairs.join(share, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("copies")).cast("int").alias("salt"))
    right = texts.join(share, texts["cls"] == share["v"]).select("v", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("text").alias("right"))
    met = salted.join(texts.select(F.col("cls").alias("u"), F.col("text").alias("left")), "u").join(right, ["v", "salt"])
    return written(met.select("u", "v", "left", "right").mapInPandas(_confirmed(width, alike), "u long, v long"), "confirmed")


def _may_be_alike(alike: int, n: str, m: str) -> Column:
    """No sets of which one is smaller than ``alike`` per cent of the other can be alike."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * alike


def _asked(pairs: DataFrame, classes: DataFrame, tried: DataFrame | None, alike: int) -> DataFrame:
    """The distinct pairs (u, v, both class numbers) that sizes and signatures leave open and that were not asked before."""
    new = pairs.distinct() if tried is None else pairs.distinct().join(tried, ["u", "v"], "left_anti")
    left = classes.select(F.col("cls").alias("u"), F.col("n"), F.col("signature").alias("a"))
    right = classes.select(F.col("cls").alias("v"), F.col("n").alias("m"), F.col("signature").alias("b"))
    both = new.join(left, "u").join(right, "v").filter(_may_be_alike(alike, "n", "m"))
    return written(both.filter(agreeing(F.col("a"), F.col("b")) >= least_agreeing(alike)).select("u", "v"), "asked")


def _open_pairs(state: DataFrame) -> tuple[int, int]:
    """How many pairs of classes share a bucket but not a part, and how many rows the buckets have."""
    per = state.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"))
    pairs, rows = per.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.sum("all")).first()
    return int(pairs or 0), int(rows or 0)


def _unsettled(state: DataFrame) -> DataFrame:
    """Buckets that hold more than one part."""
    apart = state.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return written(state.join(apart, "key", "left_semi"), "state")


def _hubs(state: DataFrame) -> DataFrame:
    """For each bucket, of its largest part the class that shares most buckets with others: (key, hub, hub_root)."""
    parts = state.groupBy("key", "root").agg(F.count("*").alias("size"), F.max_by("cls", F.col("rank")).alias("hub"))
    best = parts.groupBy("key").agg(F.max_by(F.struct("hub", "root"), F.struct("size", "root")).alias("h"))
    return written(best.select("key", F.col("h.hub").alias("hub"), F.col("h.root").alias("hub_root")), "hubs")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many codes each set on the left has in common with each set on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    codes, cell = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    border = sum(map(len, left))
    owner = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    cells = [cell[:border], cell[border:]]
    common = np.logical_and(*(np.bincount(c, minlength=len(codes)) > 0 for c in cells))
    number = np.cumsum(common) - 1
    for k in (0, 1):
        kept = common[cells[k]]
        order = np.argsort(number[cells[k][kept]], kind="stable")
        cells[k], owner[k] = number[cells[k][kept]][order], owner[k][kept][order]
    for at in range(0, int(common.sum()), COLUMNS):
        tables = []
        for k, side in ((0, left), (1, right)):
            low, high = np.searchsorted(cells[k], (at, at + COLUMNS))
            tables.append(np.zeros((len(side), COLUMNS), np.float32))
            tables[k][owner[k][low:high], cells[k][low:high] - at] = 1
        out += tables[0] @ tables[1].T
    return np.rint(out).astype(np.int64)


def _block_links(rows: pd.DataFrame, width: int, alike: int) -> pd.DataFrame:
    """Links that connect what is alike in two blocks of a bucket (or in one), at most one for each class."""
    same = rows["i"].iloc[0] == rows["j"].iloc[0]
    first = rows if same else rows[rows["own"] == rows["i"]]
    other = rows if same else rows[rows["own"] == rows["j"]]
    none = rows.iloc[:0].assign(u=[], v=[])[["u", "v"]].astype("int64")
    if first.empty or other.empty:
        return none
    (n, a, root), (m, b, top) = ((x["n"].to_numpy(), np.array(x["signature"].tolist(), np.int64).view(np.uint64), x["root"].to_numpy()) for x in (first, other))
    differ = np.zeros((len(n), len(m)), np.int64)
    for k in range(_WORDS):
        both = a[:, None, k] ^ b[None, :, k]
        differ += np.bitwise_count(reduce(np.bitwise_or, (both >> np.uint64(x) for x in range(BITS))) & np.uint64(_ONES))
    open_ = (root[:, None] != top[None, :]) & (_PLACES - differ >= least_agreeing(alike))
    open_ &= np.minimum(n[:, None], m[None, :]) * 100 >= np.maximum(n[:, None], m[None, :]) * alike
    left, right = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(left):
        return none
    sets = [[shingle_set(t, width) for t in side["text"].iloc[at]] for side, at in ((first, left), (other, right))]
    common = shared_counts(*sets)
    union = n[left][:, None] + m[right][None, :] - common
    i, j = np.nonzero(open_[np.ix_(left, right)] & (100 * common >= alike * union))
    u, v = first["cls"].to_numpy()[left[i]], other["cls"].to_numpy()[right[j]]
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = joined(place[: len(u)], place[len(u) :], len(names))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return pd.DataFrame({"u": names[moved], "v": names[label[moved]]})


def _in_blocks(state: DataFrame, classes: DataFrame, texts: DataFrame, width: int, alike: int) -> DataFrame:
    """Links among the classes that share a bucket but not a part. Pairs whose signatures agree often enough are counted
    on their whole sets where the blocks meet, and only links that connect come out, not pairs."""
    size = written(state.join(classes, "cls").groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")), "blocks")
    rows = state.join(size, "key").join(classes, "cls").join(texts, "cls")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("own")
    rows = rows.select("key", "cls", "root", "n", "signature", "text", "blocks", own)
    met = rows.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))))
    met = met.select("key", "p.i", "p.j", "own", "cls", "root", "n", "signature", "text")
    run = by_groups(["key", "i", "j"], lambda group: _block_links(group, width, alike))
    lined = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(lined.mapInPandas(run, "u long, v long").distinct(), "linked")


def links(classes: DataFrame, texts_of, width: int, alike: int) -> DataFrame | None:
    """(u, v): confirmed links that connect exactly the classes that confirmed links connect; None if there are none.

    ``classes`` has cls, n, keys and signature. ``texts_of`` gives (cls, text) of the classes it is asked for.
    """
    each = classes.select("cls", F.explode("keys").alias("key"))
    full = written(each.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1"), "full")
    each = written(each.join(full, "key"), "bucketed")
    if each.isEmpty():
        return None
    rank = written(each.groupBy("cls").agg(F.sum("held").alias("rank")), "ranks")
    texts = written(texts_of(rank.select("cls")), "texts")
    classes = written(classes.select("cls", "n", "signature").join(rank.select("cls"), "cls", "left_semi"), "candidates")
    state = written(each.select("key", "cls").join(rank, "cls").withColumn("root", F.col("cls")), "state")
    found, tried, open_now, paid = [], None, 1, True
    while open_now and paid:
        hubs = _hubs(state)
        met = state.join(hubs, "key").filter("root <> hub_root").select(F.greatest("cls", "hub").alias("u"), F.least("cls", "hub").alias("v"))
        asked = _asked(met, classes, tried, alike)
        tried = asked if tried is None else written(tried.unionByName(asked), "tried")
        found.append(confirmed(asked, texts, width, alike))
        state = state.join(hubs.select("key", F.col("hub").alias("cls")), ["key", "cls"], "left_anti")
        state = _unsettled(_joined(state, found))
        open_before, (open_now, rows) = open_now, _open_pairs(state)
        paid = open_now > CROWDED * rows and (len(found) == 1 or open_now <= PAYS * open_before)
    if open_now:
        found.append(_in_blocks(state, classes, texts, width, alike))
    return reduce(DataFrame.unionByName, found)


def _joined(state: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The state with the parts that the links found so far make."""
    roots = written(components(reduce(DataFrame.unionByName, found), "u", "v"), "roots")
    named = state.drop("root").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return named.select("key", "cls", "rank", F.coalesce("root", "cls").alias("root"))


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, alike: int = ALIKE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows are linked if their sets' intersection holds ``alike`` per cent of the union or more; ``component_id`` is the
    smallest id reachable, and the rows with that id are kept.
    """
    with scratch(docs.sparkSession) as held:
        placed, place = located(docs.select("doc_id", "text"))
        profile = _profiles(width)(F.col("text").cast("binary"))
        rows = placed.select("doc_id", *place, profile.alias("p")).select("doc_id", *place, "p.*", F.monotonically_increasing_id().alias("row"))
        rows = written(rows, "profiles")
        names = written(rows.filter("n > 0").groupBy("name").agg(F.min("row").alias("cls"), F.min("doc_id").alias("first_id")), "names")
        # of the rows with one set, the first stands for the class
        classes = written(rows.join(names.select(F.col("cls").alias("row")), "row", "left_semi").withColumnRenamed("row", "cls").drop("name", "doc_id"), "classes")

        def texts_of(asked: DataFrame) -> DataFrame:
            where = written(classes.join(asked, "cls", "left_semi").select("cls", *place), "where")
            # a shuffle at every size: what is asked for grows with the table
            return placed.join(where.hint("merge"), place).select("cls", F.col("text").cast("binary").alias("text"))

        found = links(classes, texts_of, width, alike)
        if found is None:
            member = names.select("name", F.col("first_id").alias("component_id"))
        else:
            roots = written(components(found, "u", "v").withColumnRenamed("node", "cls"), "roots")
            named = written(names.join(roots, "cls", "left").select("name", "first_id", F.coalesce("root", "cls").alias("root")), "named")
            least = written(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
            member = named.join(least, "root").select("name", "component_id")
        member = held.keep(written(member, "members"))
        rows = held.keep(written(rows.select("doc_id", "name", "n"), "rows"))
    own = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    linked = rows.filter("n > 0").join(member, "name").select("doc_id", "n", "component_id")
    out = linked.unionByName(own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
