"""Mixing: targets against an iterated reshare, words taken, positions, odd rows."""

import pytest
from pyspark.sql import functions as F

from logquarry.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def _reshared(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    whole, capped = sum(sizes.values()), set()
    while True:
        rest = whole - sum(cap * sizes[s] for s in capped)
        shared = sum(weight[s] for s in names if s not in capped)
        target = {s: cap * sizes[s] if s in capped else rest * weight[s] / shared for s in names}
        above = {s for s in names if s not in capped and target[s] > cap * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 40, None: 300}, {"a": 1, "b": 1, "c": 5000}, {"é": 7, "z": 7}, {None: 9}])
def test_targets_and_words(spark, sizes):
    rows, number = [], 0
    for source, words in sizes.items():
        left = words
        while left:
            n = min(left, 1 + (number * 7) % 60)
            rows.append((number, " ".join(["w"] * n), source, "clash"))
            number, left = number + 1, left - n
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.query(docs).collect()
    want, source = _reshared(sizes), {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert {r["doc_id"]: r["taken"] for r in mixing.query(docs).collect()} == {r["doc_id"]: r["taken"] for r in got}


def test_copies_carry_all_taken_words_in_order(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), "abc"[i % 3], "x") for i in range(300)], SCHEMA)
    copies = mixing.mix(docs).collect()
    planned = mixing.query(docs).agg(F.sum("taken")).first()[0]
    assert sum(r["mix_words"] for r in copies) == planned
    assert [r["mix_position"] for r in copies] == sorted(r["mix_position"] for r in copies)
    assert all(0 <= r["mix_position"] <= 1 and r["size"] == "x" for r in copies)


@pytest.mark.parametrize("corners", mixing.CURVES)
def test_the_inverse_of_the_schedule(spark, corners):
    def integral(t):
        done = 0.0
        for (a, w), (b, v) in zip(corners, corners[1:]):
            x = min(max(t - a, 0), b - a)
            done += x * w + x * x * (v - w) / (b - a) / 2
        return done

    demands = [i / 50 for i in range(50)]
    rows = spark.createDataFrame([(d,) for d in demands], "d double").select("d", mixing.when_reached(F.col("d"), mixing._curve(corners)).alias("t"))
    for r in rows.collect():
        assert integral(r["t"]) / integral(1.0) == pytest.approx(r["d"], abs=1e-9)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "a", None), (2, "", "a", None), (None, "x y", "a", None)], SCHEMA)
    got = mixing.query(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == [("1", 0, 0), ("2", 0, 0), ("2", 0, 0), ("None", 2, 2)]
    assert mixing.query(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.query(docs.filter("doc_id = 2")).agg(F.sum("target")).first()[0] == 0


def test_no_row_is_lost_by_its_id(spark):
    rows = [(None, "a b c", "a", "1"), (None, "d e", "a", "2"), (2, "f", "a", "3"), (2, "g h", "b", "4"), (2, "g h", "b", "5"), (None, None, "b", "6")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, weights=(1.0, 1.0)).collect()
    words = {}
    for r in got:
        words[r["size"]] = words.get(r["size"], 0) + r["mix_words"]
    planned = mixing.plan(docs, weights=(1.0, 1.0)).agg(F.sum("taken")).first()[0]
    assert sum(words.values()) == planned and set(words) == {"1", "2", "3", "4", "5"}
    assert {(r["doc_id"], r["text"], r["source"], r["size"]) for r in got} == {r for r in rows if r[1]}


def test_own_columns_of_the_copies_names_give_way(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "x")], SCHEMA).selectExpr("*", "'mine' as MIX_COPY", "7 as place", "'k' as curve")
    (row,) = mixing.mix(docs, weights=(1.0,), cap=1.0).collect()
    assert row["mix_copy"] == 0 and row["place"] == 7 and row["curve"] == "k" and row.asDict().keys() == {*docs.drop("MIX_COPY").columns, "mix_copy", "mix_words", "mix_position"}
