"""b-bit MinHash groups against every pair of whole sets."""

import random

import numpy as np
import pytest

from logquarry.llm import common, minhash

SCHEMA = "doc_id long, text string, name string, cls long, key string, _file string, n int, row int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, "k", "f", 1, 2) for i, t in rows], SCHEMA)


def _set(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([b" ".join(words)] if words else [])


def _by_hand(rows, width=2, alike=80):
    sets = [_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= alike * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)]
    return sorted(((doc, n, c, doc == c) for doc, n, c in out), key=repr)


def _edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = r.randrange(len(words)), r.random()
        if kind < 0.5:
            words[at] = f"e{r.randrange(10_000)}"
        elif kind < 0.75:
            del words[at]
        else:
            words.insert(at, f"i{r.randrange(10_000)}")
    return " ".join(words)


def _rows(seed, groups, size, edits):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice((6, 30, 80)))
        rows += [_edited(r, base, r.randint(0, min(edits, len(base) // 3))) for _ in range(size)]
    r.shuffle(rows)
    return list(enumerate(rows))


CASES = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "oNE"), (905, "a b"), (906, "A  B"), (907, "É b"), (908, "é b")]


def test_groups_as_by_hand(spark):
    rows = _rows(1, 25, 12, 4) + CASES
    rows += [(None, rows[3][1]), (None, "only here twice"), (None, "only here twice"), (7, rows[20][1]), (7, "seven " * 9), (909, "x " * 200_000 + "y")]
    got = minhash.near_duplicates(_docs(spark, rows)).collect()
    assert sorted((tuple(x)[:3] + (x["doc_id"] == x["component_id"],) for x in got), key=repr) == _by_hand(rows)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


@pytest.mark.parametrize(("width", "alike"), [(3, 80), (2, 90)])
def test_other_shingles_and_thresholds(spark, width, alike):
    rows = _rows(2, 12, 12, 5) + CASES
    got = minhash.near_duplicates(_docs(spark, rows), width=width, alike=alike).collect()
    assert sorted(map(tuple, got), key=repr) == _by_hand(rows, width, alike)


@pytest.mark.parametrize("crowded", [0, 1024])
def test_a_crowd_below_the_threshold_is_settled_in_rounds_or_blocks(spark, monkeypatch, crowded):
    # chains and texts that share a template: rounds soon stop paying, blocks decide the rest
    monkeypatch.setattr(minhash, "BLOCK", 900)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    monkeypatch.setattr(minhash, "CROWD", 8)
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    r = random.Random(3)
    base = r.choices([f"w{i}" for i in range(500)], k=60)
    rows = [_edited(r, base, r.randint(4, 9)) for _ in range(150)]
    walk = list(base)
    for _ in range(60):
        walk = _edited(r, walk, 2).split()
        rows.append(" ".join(walk))
    rows = list(enumerate(rows))
    got = minhash.near_duplicates(_docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == _by_hand(rows)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    r = random.Random(6)
    left, right = ([np.unique(np.array(r.choices(range(60), k=r.randint(1, 40)), np.uint64)) for _ in range(n)] for n in (9, 13))
    assert minhash.shared_counts(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_groups_of_a_sorted_stream():
    import pandas as pd

    rows = pd.DataFrame({"k": [1, 1, 1, 2, 3, 3, 4], "i": [0, 0, 1, 1, 1, 1, 1], "x": range(7)})
    for cuts in ([0, 7], [0, 1, 2, 3, 7], [0, 2, 2, 5, 6, 7], [0, 3, 4, 7]):
        parts = [rows.iloc[a:b] for a, b in zip(cuts, cuts[1:])]
        assert [g["x"].tolist() for g in common.by_groups(["k", "i"], lambda g: g)(iter(parts))] == [[0, 1], [2], [3], [4, 5], [6]]


def test_empty_and_unlinked(spark):
    assert minhash.near_duplicates(_docs(spark, [])).collect() == []
    rows = [(1, "a b c"), (2, None), (3, "d e f")]
    assert sorted(map(tuple, minhash.near_duplicates(_docs(spark, rows)).collect())) == _by_hand(rows)


def test_signatures_estimate_similarity(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for alike in (0.1, 0.5, 0.8, 0.95):
        for _ in range(30):
            n = 400
            both = rng.integers(0, 1 << 63, round(n * alike), dtype=np.uint64)
            rest = rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)
            a, b = np.concatenate([both, rest[::2]]), np.concatenate([both, rest[1::2]])
            pairs.append((len(both) / n, *(minhash.packed(minhash.minima(x)).tolist() for x in (a, b))))
    frame = spark.createDataFrame(pairs, "alike double, a array<long>, b array<long>")
    from pyspark.sql import functions as F

    for row in frame.select("alike", minhash.agreeing(F.col("a"), F.col("b")).alias("k"), "a", "b").collect():
        places = sum((x >> 2 * k & 3) == (y >> 2 * k & 3) for x, y in zip(row["a"], row["b"]) for k in range(32)) - (7 * 32 - 220)
        assert row["k"] == places
        assert abs(minhash.estimate(row["k"]) - row["alike"]) < 0.2
        assert row["alike"] < 0.8 or row["k"] >= minhash.least_agreeing(80)
    by_alike = [np.mean([minhash.estimate(r["k"]) for r in frame.select("alike", minhash.agreeing(F.col("a"), F.col("b")).alias("k")).filter(F.col("alike") == a).collect()]) for a in (0.1, 0.5, 0.8, 0.95)]
    assert np.allclose(by_alike, (0.1, 0.5, 0.8, 0.95), atol=0.03)


def test_rows_keep_their_place_and_scratch_goes(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(20).selectExpr("id doc_id", "'t' text", "1 _FILE").write.parquet(path)
    docs = spark.read.parquet(path)
    frame, place = common.located(docs)
    assert place == ["_file_", "_at"] and frame.select(place).distinct().count() == 20
    twice = docs.unionByName(docs)
    frame, place = common.located(twice)
    assert frame.select(place).distinct().count() == 40
    frame, place = common.located(docs.selectExpr("*", "explode(array(1, 2)) as k"))
    assert frame.select(place).distinct().count() == 40
    with common.scratch(spark) as held:
        gone = common.written(docs, "gone")
        stays = held.keep(common.written(docs, "stays"))
    assert stays.count() == 20
    assert not any(spark._jvm.java.io.File(f.removeprefix("file:")).exists() for f in gone.inputFiles())
