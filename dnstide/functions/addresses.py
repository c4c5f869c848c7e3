"""IP addresses and subnets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"


def ipv4(c: Column) -> Column:
    """A dotted quad as a number; null for anything else. Leading zeros aren't read."""
    return F.when(c.rlike(_V4), F.aggregate(F.split(c, r"\."), F.lit(0).cast("bigint"), lambda n, x: n * 256 + x.cast("bigint")))


def ipv6(c: Column | str) -> Column:
    """An IPv6 address as 16 bytes; null for anything else. Only texts with a colon are looked at."""
    text = F.lower(F.col(c) if isinstance(c, str) else c)
    dotted = F.regexp_extract(text, r"(?<=:)([^:]*\.[^:]*)$", 1)  # the last 32 bits may be a v4 address
    v4 = F.lpad(F.hex(ipv4(dotted)), 8, "0")
    plain = F.when(dotted == "", text).otherwise(F.concat(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(dotted)), F.substring(v4, 1, 4), F.lit(":"), F.substring(v4, 5, 4)))
    halves = F.split(F.lower(plain), "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":", -1), lambda x: x != "")
    hexes = lambda i: F.array_join(F.transform(groups(i), lambda x: F.lpad(x, 4, "0")), "")
    n = F.size(groups(0)) + F.size(groups(1))
    good = F.forall(halves, lambda x: x.rlike("^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*+)?$")) & F.when(F.size(halves) == 1, n == 8).otherwise((F.size(halves) == 2) & (n <= 7))
    whole = F.concat(hexes(0), F.repeat(F.lit("0"), 32 - 4 * n), hexes(1))
    return F.when(text.contains(":") & (F.char_length(text) <= 45), F.when(good, F.unhex(whole)))


def subnet(cidr: Column) -> Column:
    """``a.b.c.d/len`` as ``struct<net, len>``: the network's number, host bits cleared, and 1 to 32; else null."""
    ip, length = ipv4(F.regexp_extract(cidr, r"^([^/]*)/(\d+)$", 1)), F.regexp_extract(cidr, r"^([^/]*)/(\d{1,2})$", 2)
    size = F.when(length != "", length.cast("int"))
    return F.when(ip.isNotNull() & size.between(1, 32), F.struct(network(ip, size).alias("net"), size.alias("len")))


def network(ip: Column, size: Column) -> Column:
    """The address without its host bits."""
    return F.call_function("shiftleft", F.call_function("shiftright", ip, 32 - size), 32 - size)


def is_loopback(c: Column, packed: Column) -> Column:
    """Is it 127.0.0.1 or ::1? ``packed`` is ipv6(c)."""
    return F.coalesce((c == "127.0.0.1") | (F.hex(packed) == "0" * 31 + "1"), F.lit(False))


def same_network(a: Column, b: Column, a_mask: Column, b_mask: Column, a_packed: Column, b_packed: Column) -> Column:
    """Do two addresses of one family agree in the smaller of their masks, clamped to what the family has?"""
    x, y = ipv4(a), ipv4(b)
    mask = F.greatest(F.lit(0), F.least(a_mask, b_mask))
    m4, m6 = F.least(mask, F.lit(32)), F.least(mask, F.lit(128))
    v4 = network(x, m4) == network(y, m4)
    digits = F.floor(m6 / 4).cast("int")
    start = lambda p: F.substring(F.hex(p), F.lit(1), digits)
    rest = lambda p: F.call_function("shiftright", F.coalesce(F.conv(F.substring(F.hex(p), digits + 1, F.lit(1)), 16, 10).cast("int"), F.lit(0)), 4 - m6 % 4)
    v6 = (start(a_packed) == start(b_packed)) & ((m6 % 4 == 0) | (rest(a_packed) == rest(b_packed)))
    return F.when(x.isNotNull() & y.isNotNull(), v4).when(a_packed.isNotNull() & b_packed.isNotNull(), v6).otherwise(False)
