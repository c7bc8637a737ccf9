"""Address arithmetic for IPv4 and IPv6, and the public-address tests."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import fixed
from logquarry.functions.text import all_of, any_of


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad as a number; null when malformed. Plain string functions keep it inside generated code."""
    texts = [
        F.substring_index(ip, ".", 1),
        F.substring_index(F.substring_index(ip, ".", 2), ".", -1),
        F.substring_index(F.substring_index(ip, ".", -2), ".", 1),
        F.substring_index(ip, ".", -1),
    ]
    octets = [text.try_cast("long") for text in texts]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(fixed.IPV4_SHAPE) & all_of([o <= 255 for o in octets]), value)


def _bounds(block: str) -> tuple[int, int]:
    network = ipaddress.ip_network(block)
    return int(network.network_address), int(network.broadcast_address)


def is_public(value: Column) -> Column:
    """True for an IPv4 number outside every private, documentation, multicast and reserved block."""
    inside = any_of([value.between(*_bounds(block)) for block in fixed.NON_PUBLIC_BLOCKS])
    exceptions = [int(ipaddress.ip_address(ip)) for ip in fixed.PUBLIC_EXCEPTIONS]
    return F.coalesce(~inside | value.isin(exceptions), F.lit(False))


def ipv6_key(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits, whose order as text is that of the addresses; null when malformed.

    Short forms (``::``, dropped zeros, capitals, a dotted IPv4 tail) give the same key as the long form. Addresses with a
    zone (``%eth0``) have none.
    """
    tail = ipv4_to_long(F.regexp_extract(ip, fixed.IPV6_V4_TAIL, 2))
    groups = F.concat(F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(0xFFFF)))
    dotted = ip.contains(".")
    text = F.when(dotted, F.concat(F.regexp_extract(ip, fixed.IPV6_V4_TAIL, 1), groups)).otherwise(ip)
    halves = F.split(F.lower(text), "::", -1)

    def words(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def key(halves: Column) -> Column:
        short = F.size(halves) == 2
        left, right = words(F.get(halves, F.lit(0))), F.when(short, words(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        given = F.size(left) + F.size(right)
        right_length = F.when(short, given <= 7).otherwise(given == 8) & (F.size(halves) <= 2)
        sound = right_length & F.forall(F.concat(left, right), lambda g: g.rlike(fixed.IPV6_GROUP))
        filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), right)
        return F.when(sound, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))

    # the halves are used many times: bound once as the variable of a one-element array
    found = F.get(F.transform(F.array(halves), key), F.lit(0))
    return F.when(text.rlike(fixed.IPV6_SHAPE), found)


def mapped_ipv4(key: Column) -> Column:
    """The IPv4 number inside an IPv4-mapped IPv6 key; null for others."""
    return F.when(key.startswith(fixed.IPV6_MAPPED), F.conv(F.substring(key, 25, 8), 16, 10).cast("long"))


def ip_number(ip: Column) -> Column:
    """The IPv4 number of an address in dotted or mapped form; null for others."""
    return F.when(ip.contains(":"), mapped_ipv4(ipv6_key(ip))).otherwise(ipv4_to_long(ip))


def key_bounds(block: str) -> tuple[str, str]:
    """First and last key of an IPv6 block."""
    network = ipaddress.ip_network(block)
    return tuple(f"{int(a):032x}" for a in (network.network_address, network.broadcast_address))


def is_public_key(key: Column) -> Column:
    """True for an IPv6 key outside every private, documentation, link-local, multicast and reserved block. Mapped IPv4
    addresses are judged as IPv4, not here."""
    inside = any_of([key.between(*key_bounds(block)) for block in fixed.NON_PUBLIC_BLOCKS_6])
    open_ = any_of([key.between(*key_bounds(block)) for block in fixed.PUBLIC_EXCEPTIONS_6])
    return F.coalesce(~inside | open_, F.lit(False))
