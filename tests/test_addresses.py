"""IPv6 keys, the public test and the range join against Python's own addresses."""

import ipaddress
import random

from pyspark.sql import functions as F

from logquarry.functions.net import ip_number, ipv6_key, is_public_key, mapped_ipv4
from logquarry.operators import joins

ODD = [
    "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":", "1:", ":1",
    "12345::", "g::", "::ffff:8.8.8.8", "::FFFF:808:808", "::ffff:8.8.8.256", "::8.8.8.8", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
    "fe80::1%eth0", "2001:DB8::A", "", "8.8.8.8", "a.b", "1::2.3.4", ":1::2", "1::2:", "1:::2", " ::1", "2002::1", "fec0::1", "2001:1::1", "2001:4:112::9",
]


def _address(text):
    try:
        got = ipaddress.ip_address(text)
    except ValueError:
        return None
    return got if got.version == 6 and "%" not in text else None


def _forms(r, number):
    long = ipaddress.IPv6Address(number)
    return r.choice([str(long), long.exploded, str(long).upper(), ":".join(f"{number >> 16 * k & 0xFFFF:x}" for k in range(7, -1, -1))])


def test_keys_and_public_addresses(spark):
    r = random.Random(1)
    heads = [0x2001, 0x2002, 0x2A00, 0xFC00, 0xFE80, 0xFF02, 0x64, 0, 0x3FFF, 0x2400]
    texts = ODD + [_forms(r, (r.choice(heads) << 112) | (r.getrandbits(112) >> r.choice((0, 40, 90)))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "ip string").withColumn("key", ipv6_key(F.col("ip")))
    for row in frame.select("ip", "key", is_public_key(F.col("key")).alias("public"), mapped_ipv4(F.col("key")).alias("four"), ip_number(F.col("ip")).alias("n")).collect():
        want = _address(row["ip"])
        assert row["key"] == (None if want is None else f"{int(want):032x}"), row["ip"]
        if want is None:
            continue
        assert row["four"] == (None if want.ipv4_mapped is None else int(want.ipv4_mapped)) == row["n"]
        if want.ipv4_mapped is None:
            assert row["public"] == (not (want.is_private or want.is_loopback or want.is_link_local or want.is_reserved or want.is_multicast)), row["ip"]


def test_ranges_of_all_widths(spark):
    r = random.Random(2)
    base, at, ranges = 0x2A00 << 112, 0, []
    for k in range(60):  # widths from one address to a /32, unaligned, with gaps
        width = 1 << r.choice((0, 3, 16, 17, 40, 64, 80, 96))
        low = at + r.randrange(0, width + 1)
        ranges.append((base + low, base + low + r.randrange(width), f"c{k}"))
        at = ranges[-1][1] - base + 1
    table = [(f"{a:032x}", f"{b:032x}", None if k == 5 else float(k), 1.0, c) for k, (a, b, c) in enumerate(ranges)]
    six = spark.createDataFrame(table, "ip_lo string, ip_hi string, lat double, lon double, country string")
    four = spark.createDataFrame([(134744064, 134744319, 1.0, 2.0, "AA")], "ip_lo long, ip_hi long, lat double, lon double, country string")
    numbers = [e + d for a, b, _ in ranges for e in (a, b) for d in (-1, 0, 1)] + [r.randint(a, b) for a, b, _ in ranges for _ in range(3)]
    texts = [_forms(r, n) for n in numbers] + ["8.8.8.8", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "fc00::1", "nonsense", "2a00::1::2", None, None]
    df = spark.createDataFrame([(k, t, texts[-k]) for k, t in enumerate(texts)], "id long, src_ip string, dst_ip string")
    out = joins.geo_enrich(df, four, ranges_6=six)

    def place(text):
        if text in ("8.8.8.8", "::ffff:8.8.8.8"):
            return "AA"
        n = None if text is None or _address(text) is None else int(_address(text))
        return next((c for k, (a, b, c) in enumerate(ranges) if n is not None and a <= n <= b and k != 5), None)

    assert sorted((x["id"], x["src_country"], x["dst_country"]) for x in out.collect()) == [(k, place(t), place(texts[-k])) for k, t in enumerate(texts)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert joins.geo_enrich(df, four, ranges_6=six.limit(0)).filter("src_country is not null").count() == 2
    assert joins._bucketed_6(six, ["country"]).groupBy("country").count().agg(F.max("count")).first()[0] <= 16


def test_hot_addresses_are_not_gathered(spark, monkeypatch):
    """Addresses found to be few go to every executor; of many, those with many rows do, and the rows stay the same."""
    six = spark.createDataFrame([(f"2a000003{'0' * 24}", f"2a000003{'f' * 24}", 3.0, 1.0, "C")], "ip_lo string, ip_hi string, lat double, lon double, country string")
    four = spark.createDataFrame([(134744064, 134744319, 1.0, 2.0, "AA")], "ip_lo long, ip_hi long, lat double, lon double, country string")
    texts = ["2a00:3::5"] * 40 + ["8.8.8.8"] * 20 + ["fd00::1", "2a00:3::6", "2a00:4::1", "::ffff:8.8.8.8", "8.8.8.9", "nonsense", None, None]
    df = spark.createDataFrame([(k % 50, t, texts[-k]) for k, t in enumerate(texts)], "id long, src_ip string, dst_ip string")

    def enriched(**options):
        out = joins.geo_enrich(df, four, ranges_6=six, **options)
        return out, sorted(map(str, out.select("id", "src_ip", "dst_ip", "src_country", "dst_country", "src_lat", "dst_lat").collect()))

    out, want = enriched()
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" in plan
    assert len(want) == len(texts) and sum("src_country='C'" in w for w in want) == 41 and sum("src_country='AA'" in w for w in want) == 22
    for broadcast_ranges in (True, False):
        assert enriched(broadcast_ranges=broadcast_ranges)[1] == want
        monkeypatch.setattr(joins, "fits_broadcast", lambda df, *_: False)
        for rows in (10, 1000):
            monkeypatch.setattr(joins, "HOT_ROWS", rows)
            assert enriched(broadcast_ranges=broadcast_ranges)[1] == want
        monkeypatch.undo()
