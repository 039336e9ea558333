"""IP addresses as fixed-width hex keys.

Every address becomes 32 hex digits (IPv4 in its IPv6-mapped form), so equality is a string
equality and a network is a BETWEEN on two strings. All of it stays inside Spark expressions.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelight.functions.values import holds, let

V4_PREFIX = "0" * 20 + "ffff"
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]\d|\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _hex_pair(number: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(number.cast("long"))), width, "0")


def _v4_hex(value: Column) -> Column:
    octets = F.split(value, r"\.")
    return F.when(
        value.rlike(_V4),
        F.concat(F.lit(V4_PREFIX), *[_hex_pair(F.get(octets, F.lit(i)), 2) for i in range(4)]),
    )


def _v6_hex(value: Column) -> Column:
    """32 digits for IPv6 text (``::`` and a dotted tail allowed), NULL when malformed."""

    def dotted_tail_to_groups(v: Column) -> Column:
        tail = F.regexp_extract(v, r":([0-9.]+)$", 1)
        octets = F.split(tail, r"\.")
        groups = F.concat(
            *[_hex_pair(F.get(octets, F.lit(i)), 2) for i in (0, 1)], F.lit(":"),
            *[_hex_pair(F.get(octets, F.lit(i)), 2) for i in (2, 3)],
        )
        return F.when(~v.contains("."), v).when(
            tail.rlike(_V4), F.concat(F.regexp_extract(v, r"^(.*:)[0-9.]+$", 1), groups)
        )

    def expand(v: Column) -> Column:
        halves = F.split(v, "::", -1)
        to_groups = lambda part: F.when(F.coalesce(part, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
            F.split(part, ":", -1)
        )
        head, tail = to_groups(F.get(halves, F.lit(0))), to_groups(F.get(halves, F.lit(1)))
        used = F.size(head) + F.size(tail)
        compressed = F.size(halves) == 2
        well_formed = (
            F.forall(F.concat(head, tail), lambda g: g.rlike(r"^[0-9a-f]{1,4}$"))
            & (F.size(halves) <= 2)
            & F.when(compressed, used <= 7).otherwise(used == 8)
        )
        padded = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(
            well_formed, F.concat(padded(head), F.repeat(F.lit("0000"), F.lit(8) - used), padded(tail))
        )

    return F.when(
        value.contains(":"),
        let(F.lower(value), lambda v: let(dotted_tail_to_groups(v), expand)),
    )


def strict_hex(value: Column) -> Column:
    """Key of a bare address, NULL for anything else."""
    return F.coalesce(_v4_hex(value), _v6_hex(value))


def _strip_token(value: Column) -> Column:
    stripped = F.btrim(value, F.lit(" \t\r\n"))
    for wrapper in ('"', "'", "<", ">"):
        stripped = F.btrim(stripped, F.lit(wrapper))
    return stripped


def ip_key(value: Column) -> Column:
    """Key of an address token: quotes, angle brackets, ``[v6]:port`` and ``v4:port`` accepted."""

    def parse(token: Column) -> Column:
        bracketed = F.regexp_extract(token, r"^\[([^\]]*)\]", 1)
        with_port = F.regexp_extract(token, r"^([^:]*):\d*$", 1)
        core = F.when(bracketed != "", bracketed).when(with_port != "", with_port).otherwise(token)
        return let(core, strict_hex)

    return F.when(value.isNotNull(), let(_strip_token(value), parse))


def is_v4_key(key: Column) -> Column:
    return key.startswith(V4_PREFIX)


def key_text(key: Column) -> Column:
    """Canonical address text of a key (dotted IPv4, compressed IPv6)."""
    octet = lambda i: F.conv(F.substring(key, 25 + 2 * i, 2), 16, 10)
    dotted = F.concat_ws(".", *[octet(i) for i in range(4)])
    groups = F.concat_ws(
        ":", *[F.regexp_replace(F.substring(key, 1 + 4 * i, 4), r"^0{1,3}", "") for i in range(8)]
    )

    def compress(full: Column) -> Column:
        result = full
        for length in range(2, 9):  # the longest zero run wins, so it is tested last and wrapped outermost
            run = r"(?:^|:)0(?::0){%d}(?::|$)" % (length - 1)
            result = F.when(full.rlike(run), F.regexp_replace(full, r"^(.*?)" + run + r"(.*)$", "$1::$2")).otherwise(result)
        return result

    return F.when(is_v4_key(key), dotted).otherwise(let(groups, compress))


def canonical_ip(value: Column) -> Column:
    """Canonical text of an address token; IPv4-mapped IPv6 becomes plain IPv4."""
    return let(ip_key(value), lambda k: F.when(k.isNotNull(), key_text(k)))


def is_placeholder_ip(value: Column) -> Column:
    """Empty, ``-``, ``unknown``, unspecified or unreadable addresses: they identify nobody."""
    unspecified = ["0" * 32, V4_PREFIX + "0" * 8]
    return let(ip_key(value), lambda k: k.isNull() | k.isin(*unspecified))


def comparable_ip(value: Column) -> Column:
    """Join key of an address, NULL for placeholders so that they never join."""
    unspecified = ["0" * 32, V4_PREFIX + "0" * 8]
    return let(ip_key(value), lambda k: F.when(~k.isin(*unspecified), k))


@dataclass(frozen=True)
class Network:
    """An address range as two keys; ``v4`` networks only contain IPv4 addresses."""

    low: str
    high: str
    v4: bool

    @staticmethod
    def parse(value: str) -> "Network":
        """Read ``addr`` or ``addr/prefix``; a mapped IPv6 prefix is counted from the IPv4 part."""
        text = value.strip()
        address, _, prefix = text.partition("/")
        ip = ipaddress.ip_address(address.strip())
        width = ip.max_prefixlen
        bits = int(prefix) if prefix else width
        if not 0 <= bits <= width:
            raise ValueError(f"prefix out of range in {value!r}")
        if ip.version == 4:
            number, bits = int(ip) | (0xFFFF << 32), bits + 96
        else:
            number = int(ip)
        v4 = number >> 32 == 0xFFFF and bits >= 96
        span = (1 << (128 - bits)) - 1
        return Network(f"{number & ~span:032x}", f"{number | span:032x}", v4)

    def contains(self, key: Column) -> Column:
        inside = key.between(self.low, self.high)
        return holds(inside if self.v4 else inside & ~is_v4_key(key))


def in_networks(key: Column, networks: list[Network]) -> Column:
    result = F.lit(False)
    for network in networks:
        result = result | network.contains(key)
    return result


def cidr_range(value: Column) -> Column:
    """``struct(low, high, v4)`` of network text held in a column, NULL when unreadable."""

    def build(parts: Column) -> Column:
        key = F.element_at(parts, 1)
        bits = F.element_at(parts, 2).cast("int")
        nibbles = F.floor(bits / 4).cast("int")
        rest = (bits % 4).cast("int")
        step = F.element_at(F.array(*[F.lit(v) for v in (16, 8, 4, 2)]), rest + 1)
        digit = F.conv(F.substring(key, nibbles + 1, F.lit(1)), 16, 10).cast("int")
        base = (F.floor(digit / step) * step).cast("int")
        head = F.substring(key, F.lit(1), nibbles)
        edge_low = F.when(rest > 0, F.lower(F.hex(base.cast("long")))).otherwise(F.lit(""))
        edge_high = F.when(rest > 0, F.lower(F.hex((base + step - 1).cast("long")))).otherwise(F.lit(""))
        low = F.rpad(F.concat(head, edge_low), 32, "0")
        high = F.rpad(F.concat(head, edge_high), 32, "f")
        return F.struct(low.alias("low"), high.alias("high"), (is_v4_key(key) & (bits >= 96)).alias("v4"))

    address = F.btrim(F.split_part(value, F.lit("/"), F.lit(1)), F.lit(" \t"))
    prefix = F.when(value.contains("/"), F.split_part(value, F.lit("/"), F.lit(2)))
    dotted = ~address.contains(":")

    def bounded(key: Column) -> Column:
        limit = F.when(dotted, 32).otherwise(128)
        given = F.when(prefix.isNull(), limit).when(prefix.rlike(r"^\d{1,3}$"), prefix.cast("int"))
        return F.when(
            key.isNotNull() & (given <= limit),
            let(F.array(key, (given + F.when(dotted, 96).otherwise(0)).cast("string")), build),
        )

    return F.when(value.isNotNull(), let(ip_key(address), bounded))


def _ranges(*texts: str) -> list[Network]:
    return [Network.parse(t) for t in texts]


# Address classes used by the identity policy.
LOOPBACK = _ranges("127.0.0.0/8", "::1")
PRIVATE = _ranges("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")
LINK_LOCAL = _ranges("169.254.0.0/16", "fe80::/10")
RESERVED = _ranges(
    "0.0.0.0", "255.255.255.255", "224.0.0.0/4", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24",
    "100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "::", "ff00::/8", "2001:db8::/32",
)
# What the logon policy treats as not public.
LOGON_LOCAL = _ranges(
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "255.255.255.255",
    "::1", "::", "fe80::/10", "fc00::/7",
)


def classify_ip(value: Column) -> Column:
    """public, private, loopback, linklocal, reserved or invalid (documentation and CGNAT are reserved)."""

    def by_key(key: Column) -> Column:
        return (
            F.when(key.isNull(), "invalid")
            .when(in_networks(key, LOOPBACK), "loopback")
            .when(in_networks(key, PRIVATE), "private")
            .when(in_networks(key, LINK_LOCAL), "linklocal")
            .when(in_networks(key, RESERVED), "reserved")
            .otherwise("public")
        )

    return let(ip_key(value), by_key)


def is_internal_class(ip_class: Column) -> Column:
    return ip_class.isin("private", "loopback", "linklocal")


def is_public_logon_source(value: Column) -> Column:
    """The logon policy: any strictly written address outside the local ranges."""
    return let(strict_hex(value), lambda k: holds(k.isNotNull() & ~in_networks(k, LOGON_LOCAL)))


def first_ipv4(value: Column) -> Column:
    """First dotted quad of the text whose four parts are all 0..255."""
    quads = F.regexp_extract_all(value, F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), F.lit(0))
    in_range = lambda quad: F.forall(F.split(quad, r"\."), lambda part: part.cast("int") <= 255)
    return F.get(F.filter(quads, in_range), F.lit(0))


# The socket-inventory policy (documentation and CGNAT addresses count as public).
_SOCKET_CLASSES = [
    ("loopback", _ranges("127.0.0.0/8", "::1")),
    ("private", _ranges("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")),
    ("link_local", _ranges("169.254.0.0/16", "fe80::/10")),
    ("multicast", _ranges("224.0.0.0/4", "ff00::/8")),
    ("unspecified", _ranges("0.0.0.0", "::")),
    ("reserved", _ranges("240.0.0.0/4")),
]


def socket_class(value: Column) -> Column:
    """Class of a socket's remote address in a network inventory."""

    def by_key(key: Column) -> Column:
        chain = F.when(key.isNull(), "invalid")
        for name, networks in _SOCKET_CLASSES:
            chain = chain.when(in_networks(key, networks), name)
        return chain.otherwise("public")

    return let(strict_hex(F.btrim(F.trim(value), F.lit("[]"))), by_key)
