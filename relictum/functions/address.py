"""Destinations that must not be connected to.

An address is a number of 128 bits; IPv4 addresses lie among the mapped ones. Reserved blocks are prefixes of such numbers, so the
block that an address lies in is found by equality with one of its prefixes, a hash join whatever the number of blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.functions.url import host_matches, host_of

ALLOWED_PORTS = (80, 443)
# Reserved blocks with the reasons that reports give. 64:ff9b::/32 is named as its translated part.
BLOCKS = (
    ("0.0.0.0/8", "unspecified 0.0.0.0/8"),
    ("10.0.0.0/8", "private 10.0.0.0/8"),
    ("127.0.0.0/8", "loopback 127.0.0.0/8"),
    ("100.64.0.0/10", "carrier-grade NAT 100.64.0.0/10"),
    ("169.254.0.0/16", "link-local 169.254.0.0/16 (includes cloud metadata)"),
    ("172.16.0.0/12", "private 172.16.0.0/12"),
    ("192.0.0.0/24", "IETF protocol assignments 192.0.0.0/24"),
    ("192.168.0.0/16", "private 192.168.0.0/16"),
    ("198.18.0.0/15", "benchmarking 198.18.0.0/15"),
    ("224.0.0.0/3", "multicast or reserved 224.0.0.0/3"),
    ("::/128", "unspecified ::"),
    ("::1/128", "loopback ::1"),
    ("fc00::/7", "unique local fc00::/7"),
    ("fe80::/10", "link-local fe80::/10"),
    ("ff00::/8", "multicast ff00::/8"),
    ("64:ff9b::/32", "NAT64 64:ff9b::/96"),
)
NO_ADDRESS = "not an IP address"
IPV4 = r"^(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})\.(0|[1-9]\d{0,2})$"
MAPPED = "0" * 80 + "1" * 16


def blocked_ipv4_reason(address: Column) -> Column:
    """The reserved range that an IPv4 address lies in; null if it may be connected to."""
    pattern = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    a, b, c, d = (F.regexp_extract(address, pattern, i).try_cast("int") for i in range(1, 5))
    fine = F.coalesce(address.rlike(pattern) & (F.greatest(a, b, c, d) <= 255), F.lit(False))
    # Reserved ranges, in the order in which they are tried, with the reasons that reports give.
    return (
        F.when(~fine, "unparseable IPv4 address")
        .when(a == 0, "unspecified 0.0.0.0/8")
        .when(a == 10, "private 10.0.0.0/8")
        .when(a == 127, "loopback 127.0.0.0/8")
        .when((a == 100) & b.between(64, 127), "carrier-grade NAT 100.64.0.0/10")
        .when((a == 169) & (b == 254), "link-local 169.254.0.0/16 (includes cloud metadata)")
        .when((a == 172) & b.between(16, 31), "private 172.16.0.0/12")
        .when((a == 192) & (b == 0) & (c == 0), "IETF protocol assignments 192.0.0.0/24")
        .when((a == 192) & (b == 168), "private 192.168.0.0/16")
        .when((a == 198) & b.isin(18, 19), "benchmarking 198.18.0.0/15")
        .when(a >= 224, "multicast or reserved 224.0.0.0/3")
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def ipv6_groups(address: Column) -> Column:
    """The eight numbers of an IPv6 address however it is written; null if it is none."""

    def without_dots(plain: Column) -> Column:
        def hexed(tail: Column) -> Column:
            octet = lambda i: F.get(tail, F.lit(i)).try_cast("int")
            pair = lambda i: F.lower(F.hex(octet(i) * 256 + octet(i + 1)))
            return F.when(F.size(tail) == 4, F.concat(F.regexp_replace(plain, r"[\d.]+$", ""), pair(0), F.lit(":"), pair(2))).otherwise(plain)

        return bound(F.split(F.regexp_extract(plain, r"(\d{1,3}(?:\.\d{1,3}){3})$", 1), r"\."), hexed)

    def filled(halves: Column) -> Column:
        part = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        sides = F.struct(part(0).alias("left"), part(1).alias("right"), F.size(halves).alias("n"))

        def joined(s: Column) -> Column:
            missing = 8 - F.size(s["left"]) - F.size(s["right"])
            return F.when((s["n"] == 1) & (missing == 0), s["left"]).when((s["n"] == 2) & (missing >= 1), F.concat(s["left"], F.array_repeat(F.lit("0"), missing), s["right"]))

        return bound(sides, joined)

    numbers = lambda written: F.when(F.forall(written, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(written, lambda g: F.conv(g, 16, 10).cast("int")))
    whole = bound(F.regexp_extract(F.lower(address), r"^[^%]*", 0), without_dots)
    return bound(bound(F.split(whole, "::"), filled), numbers)


def blocked_ipv6_reason(address: Column) -> Column:
    """The reserved range that an IPv6 address lies in, by its numbers; null if it may be connected to."""

    def reason_of(groups: Column) -> Column:
        g = lambda i: F.get(groups, F.lit(i))
        empty = lambda n: F.forall(F.slice(groups, 1, n), lambda x: x == 0)
        embedded = F.concat_ws(".", *[x.cast("string") for i in (6, 7) for x in (F.floor(g(i) / 256), g(i) % 256)])
        reason = F.when(groups.isNull(), "not an IP address").when(empty(5) & (g(5) == 0xFFFF), bound(embedded, blocked_ipv4_reason))
        # First number and the bits of it that count, with the reasons that reports give.
        for first, mask, said in ((0xFC00, 0xFE00, "unique local fc00::/7"), (0xFE80, 0xFFC0, "link-local fe80::/10"), (0xFF00, 0xFF00, "multicast ff00::/8")):
            reason = reason.when(g(0).bitwiseAND(F.lit(mask)) == first, said)
        return reason.when((g(0) == 0x64) & (g(1) == 0xFF9B), "NAT64 64:ff9b::/96").when(empty(8), "unspecified ::").when(empty(7) & (g(7) == 1), "loopback ::1")

    return bound(ipv6_groups(address), reason_of)


def blocked_address_reason(address: Column) -> Column:
    return F.when(address.rlike(r"^\d+(\.\d+){3}$"), blocked_ipv4_reason(address)).when(address.rlike(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(%.*)?$"), blocked_ipv6_reason(address)).otherwise("not an IP address")


def address_bits(address: Column) -> Column:
    """The 128 bits of an address as text; null if it is none."""

    def of(a: Column) -> Column:
        octets = F.array(*[F.regexp_extract(a, IPV4, i).try_cast("int") for i in range(1, 5)])
        digits = lambda n, x: F.lpad(F.conv(x.cast("string"), 10, 2), n, "0")
        four = F.when(F.forall(octets, lambda x: x <= 255), F.concat(F.lit(MAPPED), F.concat_ws("", F.transform(octets, lambda x: digits(8, x)))))
        six = bound(ipv6_groups(a), lambda g: F.when(F.size(g) == 8, F.concat_ws("", F.transform(g, lambda x: digits(16, x)))))
        return F.when(a.rlike(IPV4), four).when(a.contains(":") & ~a.contains(":::"), six)

    return bound(address, of)


def block_table(spark: SparkSession, blocks: tuple[tuple[str, str], ...] = BLOCKS) -> DataFrame:
    """(prefix, reason): each block by its leading bits."""
    given = spark.createDataFrame([(*c.split("/"), r) for c, r in blocks], "address string, size string, reason string")
    size = F.col("size").cast("int") + F.when(F.col("address").contains(":"), 0).otherwise(96)
    return given.select(F.substring(address_bits(F.col("address")), F.lit(1), size).alias("prefix"), "reason")


def blocked_addresses(addresses: DataFrame, blocks: DataFrame) -> DataFrame:
    """`addresses` (address and what else they have) with the reason of the longest block that each lies in; null if it may be
    connected to. Distinct addresses meet the blocks once."""
    sizes = sorted(r.n for r in blocks.select(F.length("prefix").alias("n")).distinct().collect())  # at most 128 of them
    once = addresses.select("address").distinct().withColumn("bits", address_bits(F.col("address")))
    held = once.withColumn("prefix", F.explode(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.substring(F.col("bits"), F.lit(1), n))))
    met = held.join(blocks, "prefix").groupBy("address").agg(F.max_by("reason", F.length("prefix")).alias("reason"))
    said = once.join(met, "address", "left").select("address", F.when(F.col("bits").isNull(), NO_ADDRESS).otherwise(F.col("reason")).alias("reason"))
    return addresses.join(said, "address", "left").withColumn("reason", F.when(F.col("address").isNull(), NO_ADDRESS).otherwise(F.col("reason")))


def refused_hosts(addresses: DataFrame, blocks: DataFrame) -> DataFrame:
    """(host, refusal) of hosts by what they resolve to (host, ord, address): the first address that must not be connected to; null
    if there is none. A host whose only address is null resolved to none."""
    judged = blocked_addresses(addresses, blocks)
    bad = F.col("address").isNotNull() & F.col("reason").isNotNull()
    first = judged.groupBy(F.lower("host").alias("host")).agg(F.count("address").alias("n"), F.min_by(F.when(bad, F.struct("address", "reason")), F.when(bad, F.col("ord"))).alias("bad"))
    no_one = F.concat(F.col("host"), F.lit(" resolved to no addresses"))
    return first.select("host", F.when(F.col("n") == 0, no_one).otherwise(F.concat(F.col("host"), F.lit(" resolves to "), F.col("bad.address"), F.lit(", which is "), F.col("bad.reason"))).alias("refusal"))


LITERAL = r"^\d+(\.\d+){3}$"


def url_refusal(url: Column, allowed_hosts: list[str]) -> Column:
    """Why a URL must not be requested, whatever its host resolves to; null if nothing in it says so. Where hosts are named and none
    of them is an address, an address is not among them."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    port_text = F.regexp_extract(authority, r":([0-9]+)$", 1)
    port = F.when(port_text != "", port_text.try_cast("int")).otherwise(F.when(scheme == "https", 443).otherwise(80))
    six = F.regexp_extract(authority, r"^(?:[^@]*@)?\[([^\]]*)\](?::[0-9]*)?$", 1)
    host = F.when(six != "", F.lower(six)).otherwise(host_of(url))
    named = F.lit(not allowed_hosts)
    for h in allowed_hosts:
        named = named | host_matches(host, F.lit(h))
    literal = host.rlike(LITERAL) | host.contains(":")
    may_be_literal = not allowed_hosts or any(":" in h or re.match(LITERAL, h) for h in allowed_hosts)
    said = (
        F.when(scheme == "", F.concat(F.lit("unparseable URL "), url))
        .when(~scheme.isin("http", "https"), F.concat(F.lit("scheme "), scheme, F.lit(": is not http or https")))
        .when(authority.contains("@"), "URL carries embedded credentials")
        .when(~F.coalesce(port.isin(*ALLOWED_PORTS), F.lit(False)), F.concat(F.lit("port "), port_text, F.lit(" is not in the allowed set")))
        .when(host.isNull(), "URL has no host")
        .when(~named, F.concat(F.lit("host "), host, F.lit(" is not an allowed provider host")))
    )
    return said.when(literal, F.concat(F.lit("literal address "), host, F.lit(" is "), blocked_address_reason(host))) if may_be_literal else said


def is_literal(url: Column) -> Column:
    """Whether the host of a URL is an address."""
    return F.coalesce(host_of(url).rlike(LITERAL), F.lit(False)) | url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?\[")


def destination_refusal(url: Column, addresses: Column, allowed_hosts: list[str]) -> Column:
    """Why a URL must not be requested; null if it may be. `addresses` holds what its host resolves to."""
    host = host_of(url)
    bad = F.filter(F.transform(addresses, lambda a: F.struct(a.alias("address"), blocked_address_reason(a).alias("reason"))), lambda x: x["reason"].isNotNull())
    first = F.get(bad, 0)
    resolved = F.when(F.coalesce(F.size(addresses), F.lit(0)) <= 0, F.concat(host, F.lit(" resolved to no addresses"))).when(first.isNotNull(), F.concat(host, F.lit(" resolves to "), first["address"], F.lit(", which is "), first["reason"]))
    return F.coalesce(url_refusal(url, allowed_hosts), F.when(~is_literal(url), resolved))
