from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tracelight.functions import net, text, times
from tracelight.functions.assess import confidence, severity


def _map(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", fn(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_canonical_addresses(spark):
    given = ["1.2.3.4", "::ffff:1.2.3.4", "[2001:DB8::1]:443", "1.2.3.4:80", '"<10.0.0.1>"', "-", "unknown", "01.2.3.4", "1:0:0:2:0:0:0:3", ":::", None]
    assert _map(spark, given, net.canonical_ip) == ["1.2.3.4", "1.2.3.4", "2001:db8::1", "1.2.3.4", "10.0.0.1", None, None, None, "1:0:0:2::3", None, None]


def test_ipv6_text_agrees_with_the_standard_library(spark):
    import ipaddress
    import random

    random.seed(5)
    numbers = [random.choice([0, 0xFFFF, random.getrandbits(16)]) for _ in range(8 * 200)]
    addresses = [ipaddress.IPv6Address(int("".join(f"{g:04x}" for g in numbers[i:i + 8]), 16)) for i in range(0, len(numbers), 8)]
    addresses = [a for a in addresses if a.ipv4_mapped is None]
    assert _map(spark, [str(a) for a in addresses], net.canonical_ip) == [str(a) for a in addresses]
    assert _map(spark, [str(a) for a in addresses], net.strict_hex) == [f"{int(a):032x}" for a in addresses]


def test_address_classes_and_placeholders(spark):
    given = ["127.0.0.1", "172.16.9.9", "169.254.1.1", "203.0.113.5", "100.64.0.1", "8.8.8.8", "fd00::1", "fe80::1", "2001:db8::1", "::ffff:10.0.0.1", "x"]
    assert _map(spark, given, net.classify_ip) == ["loopback", "private", "linklocal", "reserved", "reserved", "public", "private", "linklocal", "reserved", "private", "invalid"]
    assert _map(spark, ["", "-", "Unknown", "0.0.0.0", "::", "bad", "1.1.1.1"], net.is_placeholder_ip) == [True] * 6 + [False]
    assert _map(spark, ["203.0.113.5", "100.64.0.1", "255.255.255.255", "240.0.0.1"], net.socket_class) == ["public", "public", "reserved", "reserved"]
    assert _map(spark, ["100.64.0.1", "10.0.0.1", "::ffff:8.8.8.8", "x"], net.is_public_logon_source) == [True, False, True, False]


def test_cidr_ranges(spark):
    import ipaddress

    given = ["10.0.0.0/8", "1.2.3.129/25", "2001:db8::/33", "::ffff:10.0.0.0/120", "10.0.0.0/33", "0.0.0.0/0", "1.2.3.4"]
    got = _map(spark, given, net.cidr_range)
    assert got[4] is None
    for value, r in zip(given, got):
        if r is None:
            continue
        n = ipaddress.ip_network(value, strict=False)
        lift = (0xFFFF << 32) if n.version == 4 else 0
        assert (int(r.low, 16), int(r.high, 16)) == (int(n[0]) + lift, int(n[-1]) + lift)
    assert got[3].v4 and not got[2].v4


def test_first_ipv4(spark):
    given = ["release 3.1.300.2 up, peer 192.168.77.5", "version 700.1.1.900 gone", "no ip", "from 10.0.0.5 ok"]
    assert _map(spark, given, net.first_ipv4) == ["192.168.77.5", None, None, "10.0.0.5"]


def test_decoding_and_paths(spark):
    assert _map(spark, ["a%zz%2fb", "trailing%2", "/x+y%20z", "%C3%A9"], text.percent_decode) == ["a%zz/b", "trailing%2", "/x+y z", "é"]
    assert _map(spark, ["/a/./b", "/a//b", "/a/%62", "/a/../../c", "a/b", "/a/b"], text.normalise_path) == ["/a/b", "/a/b", "/a/b", "/c", "/a/b", "/a/b"]
    assert _map(spark, ["a/./b", "/a/../b"], text.normalise_allow_path) == ["a/b", "/b"]


def test_redaction(spark):
    line = "GET /renew?token=q9w8&seat=4 Authorization: BearerABC password=open-sesame,end"
    assert _map(spark, [line, "plain"], text.redact) == ["GET /renew?token=<redacted>&seat=4 Authorization: <redacted> password=<redacted>,end", "plain"]


def test_times(spark):
    assert _map(spark, ["15/May/2026:08:00:00 +0000", "5/May/2026:08:00:00 +0830", "15/May/2026:08:00:00", "31/Feb/2026:08:00:00 +0000", "x"], times.clf_iso) == [
        "2026-05-15T08:00:00Z", "2026-05-05T08:00:00+08:30", "2026-05-15T08:00:00Z", None, None]
    assert _map(spark, ["2026-05-15", "2026-05-15T08:00:00.120Z", "2026-05-15 08:00:00"], times.naive_iso) == [None, "2026-05-15T08:00:00.12Z", "2026-05-15T08:00:00Z"]
    now = datetime(2026, 1, 2)
    assert _map(spark, ["Dec 31 08:00:01 x", "Jan  2 08:00:01 x"], lambda c: times.syslog_iso(c, now)) == ["2025-12-31T08:00:01Z", "2026-01-02T08:00:01Z"]
    offset = _map(spark, ["2026-05-15 08:00:00"], lambda c: F.unix_seconds(times.instant(c, "+08:00")))
    assert offset == [1778803200]


def test_assessment(spark):
    rows = spark.createDataFrame([(s, q) for s in (10, 30, 50, 70, 90) for q in ("Q1", "Q2", "Q3", "Q4", "Q5")], "s int, q string")
    got = {(r.s, r.q): (r.sev, r.c) for r in rows.select("s", "q", severity(F.col("s")).alias("sev"), confidence(F.col("s"), F.col("q")).alias("c")).collect()}
    assert [got[(s, "Q1")][0] for s in (10, 30, 50, 70, 90)] == ["info", "low", "medium", "high", "critical"]
    assert [got[(50, q)][1] for q in ("Q1", "Q2", "Q3", "Q4", "Q5")] == ["medium", "high", "low", "medium", "high"]
    assert got[(90, "Q1")][1] == "high" and got[(30, "Q2")][1] == "medium"
