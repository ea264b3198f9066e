"""Literal network addresses in column expressions: every spelling becomes 32 hexadecimal digits, in which ranges are compared as text."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks whose addresses are private, loopback, link-local, multicast, reserved or unspecified, and the parts of them that are not.
NOT_PUBLIC_4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
)
PUBLIC_4 = ("192.0.0.9/32", "192.0.0.10/32")
NOT_PUBLIC_6 = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4",
    "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
PUBLIC_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

#: How many addresses the last of one to four numbers can tell apart.
_LAST = (1 << 32, 1 << 24, 1 << 16, 1 << 8)

_DIGITS = r"(?:0x[0-9a-f]{1,8}|[0-9]{1,11})"


def _let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _within(address: Column, networks: tuple[str, ...]) -> Column:
    """Whether hexadecimal digits lie in one of the networks."""
    found = [ipaddress.ip_network(n) for n in networks]
    width = found[0].max_prefixlen // 4
    spans = F.array(*[F.struct(F.lit(f"{int(n[0]):0{width}x}").alias("low"), F.lit(f"{int(n[-1]):0{width}x}").alias("high")) for n in found])
    return F.exists(spans, lambda r: address.between(r["low"], r["high"]))


def _number(part: Column) -> Column:
    return F.when(part.startswith("0x"), F.conv(F.substring(part, 3, 99), 16, 10)).when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10)).when(part.rlike("^(0|[1-9][0-9]*)$"), part).cast("long")


def ipv4(host: Column) -> Column:
    """Eight hexadecimal digits of an IPv4 address in any spelling that resolvers take, else null: one to four numbers, decimal, octal (0...) or hexadecimal (0x...), the last one filling what is left."""

    def packed(numbers: Column) -> Column:
        n = F.size(numbers)
        start, last = F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), F.element_at(numbers, -1)
        room = F.get(F.array(*map(F.lit, _LAST)), n - 1)
        fits = F.forall(start, lambda x: x.between(0, 255)) & (last < room)
        value = F.aggregate(start, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x) * room + last
        return F.when(F.coalesce(fits, F.lit(False)), F.lower(F.lpad(F.hex(value), 8, "0")))

    shape = host.rlike(rf"^{_DIGITS}(?:\.{_DIGITS}){{0,3}}$")
    return F.when(shape, _let(F.transform(F.split(host, r"\."), _number), packed))


def ipv6(host: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address without brackets, else null: :: is filled up, a dotted end counts as two groups, a zone is left out."""

    def undotted(parts: Column) -> Column:
        packed = parts["packed"]
        return F.when(packed.isNotNull(), F.concat(parts["head"], F.substring(packed, 1, 4), F.lit(":"), F.substring(packed, 5, 4))).otherwise(parts["bare"])

    def digits(halves: Column) -> Column:
        groups = lambda half: F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))
        return _let(F.struct(groups(F.get(halves, F.lit(0))).alias("left"), groups(F.get(halves, F.lit(1))).alias("right"), F.size(halves).alias("n")), filled)

    def filled(x: Column) -> Column:
        missing = F.lit(8) - F.size(x["left"]) - F.size(x["right"])
        fills = ((x["n"] == 2) & (missing >= 1)) | ((x["n"] == 1) & (missing == 0))
        return _let(F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), x["right"]), lambda all_groups: F.when(
            fills & F.forall(all_groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(all_groups, lambda g: F.lpad(g, 4, "0")), "")))

    bare = F.regexp_replace(host, "%.*$", "")
    dotted = r"^(.*:)((?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3})$"
    parts = F.struct(bare.alias("bare"), F.regexp_extract(bare, dotted, 1).alias("head"), ipv4(F.regexp_extract(bare, dotted, 2)).alias("packed"))
    return _let(F.split(_let(parts, undotted), "::"), digits)


def not_public(host: Column) -> Column:
    """Whether a lower-case host, an IPv6 one in brackets, is a literal address that isn't public; false for names. IPv4 addresses within IPv6 (::ffff:...) lie in ::/8, which is reserved as a whole."""

    def judged(x: Column) -> Column:
        four = _within(x["four"], NOT_PUBLIC_4) & ~_within(x["four"], PUBLIC_4)
        six = _within(x["six"], NOT_PUBLIC_6) & ~_within(x["six"], PUBLIC_6)
        return F.coalesce(four, F.lit(False)) | F.coalesce(six, F.lit(False))

    return _let(F.struct(ipv6(F.regexp_extract(host, r"^\[(.*)\]$", 1)).alias("six"), ipv4(host).alias("four")), judged)
