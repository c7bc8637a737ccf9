"""SimHash groups, near copies, suffix de-duplication and decontamination against plain loops."""

import hashlib
import random

import numpy as np
import pytest

from logquarry.llm import decontam, language, mixing, simhash, suffixes

SCHEMA = "doc_id long, text string, extra string, node long, fp string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, "y") for i, t in rows], SCHEMA)


def _simhash_by_hand(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [sum(h >> b & 1 for h in map(lambda r: xxh64_intdigest(r, 42), runs)) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def _groups(values, near):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 6)
    r = random.Random(5)
    base = [r.choices("the of and to in a is that for it".split(), k=60) for _ in range(12)]
    rows = []
    for i in range(240):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "zq"
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "one"), (305, "A B"), (306, rows[0][1]), (306, rows[0][1])]
    got = {(x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(_docs(spark, rows)).collect()}
    prints = [_simhash_by_hand(t) for _, t in rows]
    root = _groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == {(i, f"{p:016x}", rows[g][0]) for (i, _), p, g in zip(rows, prints, root)}


def test_trie_links_join_exactly_what_is_near(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(30)]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(0, v) for v in signed], "family int, fp long")
    pairs = [(x["u"], x["v"]) for x in simhash.links(frame, 3).collect()]
    place = {v: i for i, v in enumerate(signed)}
    linked = {(max(place[u], place[v]), min(place[u], place[v])) for u, v in pairs}
    want = _groups(values, lambda a, b: (a ^ b).bit_count() <= 3)
    assert _groups(list(range(len(values))), lambda i, j: (max(i, j), min(i, j)) in linked) == want


def _kept_by_hand(rows, budget=2):
    """One row of each group: the smallest id, no id last, then the one that comes first."""
    root = _groups([_simhash_by_hand(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= budget)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[root[k]] = min(best.get(root[k], (True, 0, k)), (i is None, i or 0, k))
    return sorted((rows[k] for _, _, k in best.values()), key=repr)


def test_near_copies_leave_one(spark):
    r = random.Random(1)
    words = ["w%d" % i for i in range(4000)]
    rows = []
    for k in range(40):
        base = r.sample(words, 150)
        rows.append((5 * k + 3, " ".join(base)))
        for j in range(4):
            near = list(base)
            for _ in range(j):
                near[r.randrange(len(near))] = "changed"
            rows.append((r.choice([5 * k + 1, 5 * k + 4, None]), " ".join(near)))
    rows += [(901, rows[0][1].upper()), (902, None), (903, ""), (None, "nowhere else"), (None, "nowhere else"), (None, "nowhere else")]
    want = _kept_by_hand(rows)
    assert 40 < len(want) < 150 and want.count((None, "nowhere else")) == 1
    got = simhash.keep_one(_docs(spark, rows))
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=repr) == want and got.columns == _docs(spark, rows).columns
    assert simhash.keep_one(_docs(spark, rows).limit(0)).count() == 0


def test_columns_named_like_helpers_stay(spark, tmp_path):
    """Every stage of the pipeline leaves the caller's columns alone, whatever they are called."""
    names = ["_row", "_file", "_AT", "_leaks", "_doc", "_sub", "_spans", "_k1", "_k2", "fp", "root", "place", "key", "n", "_metadata"]
    rows = [(i, "a text of some words " * 9 + f"number {i % 4}", "en", "s", *(f"{c}{i}" for c in names)) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names))
    path = str(tmp_path / "docs")
    frame.drop("_metadata").write.parquet(path)
    bench = spark.createDataFrame([(1, "another matter entirely, of no weight")], "item_id long, text string")
    for docs in (frame, spark.read.parquet(path)):
        for out in (simhash.keep_one(docs), suffixes.cut(docs), decontam.clean(docs, bench), language.known(docs), mixing.mix(docs).drop("mix_copy", "mix_words", "mix_position")):
            assert out.columns == docs.columns
            got = out.collect()
            assert got and all(x[c] == f"{c}{x['doc_id']}" for x in got for c in names if c in docs.columns)


def _removed_by_hand(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        octets = (text or "").encode()
        gone = bytearray(len(octets))
        for p in range(len(octets) - length + 1):
            if octets[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(octets[p : p + length])
        kept = bytes(b for b, g in zip(octets, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(octets), len(octets) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [4096, 30])
def test_repeated_strings(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    r = random.Random(3)
    parts = ["".join(r.choices("abé ", k=r.randint(60, 300))) for _ in range(6)]
    some = lambda: "".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choices("abé ", k=r.randint(1, 90))) for _ in range(r.randint(0, 6)))
    rows = [(i, some()) for i in range(150)]
    rows += [(1000, "a" * 1000), (1001, "ab" * 400), (1002, None), (1003, "a" * 99), (1004, "a" * 100), (None, parts[0])]
    got = {x["doc_id"]: tuple(x[1:]) for x in suffixes.repeats(_docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == _removed_by_hand(rows, 100)


def test_rows_alike_are_one_document(spark):
    text = "".join(random.Random(8).choices("abcdefgh ", k=400))
    got = suffixes.repeats(_docs(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((x["doc_id"], x["n_removed"]) for x in got) == [(1, 0), (1, 0), (2, 400)]
    assert suffixes.repeats(_docs(spark, [(1, text)]).limit(0)).count() == 0
    cut = suffixes.cut(_docs(spark, [(1, text), (2, "é" + text), (3, None)])).collect()
    assert {x["doc_id"]: x["text"] for x in cut} == {1: text, 2: "é", 3: None} and cut[0]["extra"] == "x"


def _edit_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def test_banded_alignment():
    r = random.Random(1)
    for _ in range(150):
        item = bytes(r.choices(b"abcd", k=r.randint(12, 40)))
        copy = bytearray(item)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(copy))
            copy[at : at + r.randint(0, 1)] = bytes(r.choices(b"abcd", k=r.randint(0, 2)))
        text = bytes(r.choices(b"abcd", k=r.randint(0, 30))) + bytes(copy) + bytes(r.choices(b"abcd", k=r.randint(0, 30)))
        got = decontam.aligned(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), -40, len(text) + 40, 6)
        want = _edit_distance(item, text)
        assert got == (want if want <= 6 else None)


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_leaks(spark, monkeypatch, block):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 8)))
    items = [" ".join(word() for _ in range(30)) for _ in range(8)] + [None, "short"]
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(200)) for i in range(30)]
    typo = items[2][:50] + "x" + items[2][51:]
    rows += [(100, text(50) + " " + items[0].upper() + "! " + text(9)), (101, typo), (102, items[3][: len(items[3]) // 2]), (103, None), (104, "")]
    rows += [(105, items[1].replace(" ", " -- ")), (100, items[0])]
    monkeypatch.setattr(decontam.blocks, "__defaults__", (decontam.BUDGET, block))
    docs, bench = _docs(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], x["edits"]) for x in decontam.leaks(docs, bench).collect())
    assert got == [(100, 0, 0), (100, 0, 0), (101, 2, 1), (105, 1, 0)]
    assert sorted(x["doc_id"] for x in decontam.clean(docs, bench).collect()) == [*range(30), 102, 103, 104]
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_rows_that_share_an_id_are_judged_for_themselves(spark):
    r = random.Random(2)
    one, two = (" ".join(r.choices(["w%d" % i for i in range(900)], k=90)) for _ in range(2))
    rows = [(1, one), (2, one.upper()), (2, two), (2, two), (None, one), (None, one)]
    kept = simhash.keep_one(_docs(spark, rows)).collect()
    assert sorted((str(x["doc_id"]), x["text"]) for x in kept) == sorted([("1", one), ("2", two)])


def test_leaks_of_short_items_and_items_without_an_id(spark):
    r = random.Random(9)
    items = ["".join(r.choices("abcdefgh", k=n)) for n in (20, 21, 22, 23, 24, 7)]
    rows = [(i, "zz " + t[: len(t) // 2] + "x" + t[len(t) // 2 + 1 :] + " zz") for i, t in enumerate(items)]
    rows += [(10, "zz" + items[5] + "zz"), (11, "zz " + "k" * 40), (12, "zz " + "n" * 39)]
    named = [(i, t) for i, t in enumerate(items)] + [(None, "k" * 40), (None, " -- ")]
    docs, bench = _docs(spark, rows), spark.createDataFrame(named, "item_id long, text string")
    got = sorted(((x["doc_id"], x["item_id"], x["edits"]) for x in decontam.leaks(docs, bench).collect()), key=str)
    assert got == sorted([*((i, i, 1) for i in range(5)), (10, 5, 0), (11, None, 0)], key=str)
    assert sorted(x["doc_id"] for x in decontam.clean(docs, bench).collect()) == [5, 12]


def test_items_match_whatever_their_punctuation(spark):
    items = ['He said "it\'s done" - and left, at noon; nobody knew why or where.', "Größe und Straße: wie heißt das Stück, das gestern im Theater lief?"]
    rows = [(1, "… he said “it’s done” — and left, at noon; nobody knew why or where…"), (2, "«größe» und straße – wie heißt das stück, das gestern im theater lief"), (3, "He said nothing at all, and stayed.")]
    docs, bench = _docs(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted((x["doc_id"], x["item_id"], x["edits"]) for x in decontam.leaks(docs, bench).collect()) == [(1, 0, 0), (2, 1, 0)]
    assert decontam.plain("A_b-Ç 2 ½") == "a b ç 2 ½".encode() and decontam.plain("日本 語") == "日本 語".encode()


def _leaks_by_hand(rows, items):
    """Edit distance of every item to every stretch of every text."""
    out = set()
    for doc, text in rows:
        low = decontam.plain(text)
        for number, item in items:
            own = decontam.plain(item)
            if own and low:
                edits = _edit_distance(own, low)
                if edits <= int(len(own) * decontam.BUDGET):
                    out.add((doc, number, edits))
    return out


def test_search_finds_what_a_plain_search_finds(spark):
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcde", k=r.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(r.randint(2, 14)))) for i in range(12)] + [(3, "repeated item id here now")]
    rows = []
    for i in range(60):
        text = [word() for _ in range(r.randint(0, 20))]
        if r.random() < 0.7:
            item = list(r.choice(items)[1])
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(item))
                item[at : at + r.randint(0, 1)] = r.choices("abcde ", k=r.randint(0, 2))
            text.insert(r.randint(0, len(text)), "".join(item))
        rows.append((i, " ".join(text)))
    docs, bench = _docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["edits"]) for x in decontam.leaks(docs, bench).collect()}
    want = _leaks_by_hand(rows, items)
    assert len(want) > 15 and {(d, i) for d, i, _ in got} == {(d, i) for d, i, _ in want} and all(any(w[:2] == g[:2] and w[2] <= g[2] for w in want) for g in got)
