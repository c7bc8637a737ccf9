"""Importance resampling and centroid clustering against plain loops."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from logquarry.llm import centroids, resample

TEXTS = "doc_id long, text string, weight string, fits long, _tie string, _place int, words int, rank int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, "y", 1, 2, 3) for i, t in rows], TEXTS)


def _features(text, runs=1):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def _resampled_by_hand(rows, target, runs=1, buckets=10000, least=20, share=10):
    def counts(texts):
        held = [0] * buckets
        for text in texts:
            for f in _features(text, runs)[1]:
                held[zlib.crc32(f.encode()) % buckets] += 1
        return held

    s, t = counts(x for _, x in rows), counts(target)
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, feats = _features(text, runs)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in feats)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_crcs_by_matrices_of_equal_length():
    r = random.Random(3)
    feats = [r.randbytes(r.choice((0, 1, 2, 3, 7, 40))) for _ in range(500)] + [b"x" * 20_000]
    assert resample.crc32s(feats).tolist() == [zlib.crc32(f) for f in feats]
    assert len(resample.crc32s([])) == 0


def test_pieces_give_every_run_once(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 7)
    text = "One two,three 4four été --- " + "z" * 30 + " a b c d e f " + "中文"
    for runs in (1, 2, 3, 5):
        got = [f for _, part in resample.pieces(text.encode(), runs) for f in part]
        assert sorted(got) == sorted(f.encode() for f in _features(text, runs)[1])
        assert sum(n for n, _ in resample.pieces(text.encode(), runs)) == len(_features(text)[0])
    assert list(resample.pieces(None, 2)) == []


def test_resampling_by_hand(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLAB", 50)
    monkeypatch.setattr(resample, "KNOWN", 40)
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "B2B"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice((5, 19, 20, 40, 90))))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " ,;"), (None, rows[0][1]), (None, "w1 " * 30), (7, "w2 " * 25), (7, "w2 " * 25), (503, "q" * 5000 + " w3" * 30)]
    target = [" ".join(r.choices(vocabulary[:9], k=40)) for _ in range(5)] + [None, ""]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for runs, share in ((1, 10), (2, 35), (1, 100)):
        got = resample.resample(_docs(spark, rows), aim, runs=runs, share=share).collect()
        assert sorted(map(tuple, got), key=repr) == _resampled_by_hand(rows, target, runs=runs, share=share)


def test_resampling_of_empty_tables(spark):
    none = _docs(spark, [])
    aim = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(none, aim).collect() == []
    got = resample.resample(_docs(spark, [(1, "a " * 25)]), aim, share=100).collect()
    assert [tuple(x) for x in got] == _resampled_by_hand([(1, "a " * 25)], [], share=100)


def test_one_text_of_many_megabytes(spark):
    got = resample.resample(_docs(spark, [(1, "Ab " * 1_500_000), (2, "ab")]), _docs(spark, []).select("text")).collect()
    assert {(x["doc_id"], x["n_features"]) for x in got} == {(1, 1_500_000), (2, 1)}


def _clustered_by_hand(rows, k, rounds, size):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * Fraction(x)) for x in v]))
    first = sorted(kept, key=lambda e: (e[0] is None, hashlib.sha256(f"2:{e[0]}".encode()).hexdigest(), e[1]))[:k]
    centers = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        placed = assign()
        for j in range(len(centers)):
            own = [v for (_, v), (_, at) in zip(kept, placed) if at == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    placed = assign()
    total = sum(d for d, _ in placed)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    own = [sum(d for d, at in placed if at == j) for j in range(len(centers))]
    return sorted(((i, j, d, own[j], total, digest[j]) for (i, _), (d, j) in zip(kept, placed)), key=repr)


def test_clusters_by_hand(spark):
    r = random.Random(8)
    hubs = [[r.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in r.choice(hubs)]) for i in range(200)]
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[3][1]), (None, [0.5] * 6), (900, None), (901, [1.0] * 5), (902, [None, *[1.0] * 5])]
    rows += [(903, [float("nan"), *[1.0] * 5]), (904, [float("-inf"), *[1.0] * 5]), (905, []), (906, [900.0, -900.0, 0.0, -0.001, 1 / 256, 2.5])]
    frame = spark.createDataFrame([(i, v, 1, "c", 2.0) for i, v in rows], "vec_id long, embedding array<double>, v int, cluster string, p double")
    for k, rounds, leading in ((7, 4, 2), (3, 0, 6), (1, 2, 1), (300, 1, 4)):
        got = centroids.clusters(frame, k=k, rounds=rounds, size=6, leading=leading).collect()
        assert sorted(map(tuple, got), key=repr) == _clustered_by_hand(rows, k, rounds, 6)
    empty = centroids.clusters(frame.limit(0), size=6)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_drop_most_centroids_and_none_that_is_nearest():
    rng = np.random.default_rng(4)
    hubs = rng.normal(size=(40, 12)) @ rng.normal(size=(12, 64)) * 100  # most of the spread lies along few axes
    at = np.concatenate([np.arange(40), rng.integers(0, 40, 1960)])
    v = (hubs[at] + rng.normal(size=(2000, 64)) * 30).astype(np.int64)
    centers = v[:40].copy()
    centers[7] = centers[3]  # a tie goes to the smaller number
    mean = v.mean(axis=0)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :16]
    best, far, measured = centroids.nearest(v, centroids.rotated(v, mean, axes), centers, centroids.rotated(centers, mean, axes))
    every = ((v[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    assert measured < 0.2 * every.size
    far_out = np.array([[1 << 27] * 64, [-(1 << 27)] * 64])
    best, far, _ = centroids.nearest(far_out, centroids.rotated(far_out, mean, axes), far_out[::-1], centroids.rotated(far_out[::-1], mean, axes))
    assert best.tolist() == [1, 0] and far.tolist() == [0, 0]
