"""Nearest related findings, machines, salted pairs, and disjoint networks against plain versions."""

from __future__ import annotations

import datetime
import ipaddress
import random

from pyspark.sql import functions as F

from tracelight.functions import assess
from tracelight.operators import enrich, relations
from tracelight.schema import FINDING, conform

KINDS = ["access_log", "access_log", "access_log", "waf_log", "app_log", "db_log", "file", "process", "logon", "ioc"]
CATEGORIES = {"db_log": ["db_auth_failure", "db_delay"], "access_log": ["sqli", "rce", "scanner", "upload_webshell"]}


def _findings(spark, n, seconds, seed=3):
    random.seed(seed)
    rows = []
    for i in range(n):
        kind = random.choice(KINDS)
        at = datetime.datetime(2026, 5, 1) + datetime.timedelta(seconds=random.choice([random.randint(0, seconds), 100]))
        rows.append((f"F-{i:05d}", None if i % 41 == 7 else at.strftime("%Y-%m-%dT%H:%M:%SZ"), kind, random.choice(CATEGORIES.get(kind, ["other"])), random.choice(["1.1.1.1", "1.1.1.1", "2.2.2.2", None, "-"]),
                     random.choice(["/a", "/b", None]), random.choice([200, 500]), random.choice(["m1", "m2", None]), 40, f"f{i}.log", i, f"h{i}", "seen"))
    names = ("finding_id string, timestamp string, source_type string, category string, remote_ip string, uri_path string, status int, machine string, score int, source_file string, line_number long, "
             "raw_hash string, evidence_summary string")
    return conform(spark.createDataFrame(rows, names), FINDING).withColumn("score_breakdown", assess.breakdown()).withColumn("severity", F.lit("low"))


def test_nearest_partners_are_those_of_all_pairs(spark):
    findings = _findings(spark, 400, 3000)
    at = {r.id: r.at for r in relations.prepared(findings).collect()}
    machine = {r.finding_id: r.machine for r in findings.collect()}
    for hot in (20_000, 3):
        pairs = {(r.src, r.dst) for r in relations.relation_pairs(findings, hot=hot).collect()}
        if hot == 20_000:
            whole = pairs
        assert pairs == whole and len(pairs) > 1000
    assert all(machine[a] == machine[b] for a, b in whole)
    want = {}
    for a, b in whole:
        for x, y in ((a, b), (b, a)):
            want.setdefault(x, []).append((abs(at[x] - at[y]), y))
    got = {}
    near = relations.nearest_partners(relations.prepared(findings), 4)
    for r in near.collect():
        got.setdefault(r.id, {})[r.n] = (r.apart, r.partner)
    assert {k: [v[n] for n in sorted(v)] for k, v in got.items()} == {k: sorted(v)[:4] for k, v in want.items()}
    counts = {r.finding_id: r.related_count for r in relations.correlate(findings).collect()}
    assert all(counts[i] == len(want.get(i, [])) for i in counts)
    assert relations.nearest_partners(relations.prepared(findings.limit(0))).count() == 0


def test_chain_text(spark):
    findings = _findings(spark, 60, 600, seed=4)
    files = spark.createDataFrame([("F-00003", 1, "file_context: Web file x"), ("F-00003", 2, "file_context: Web file y")], "id string, n int, note string")
    near = {}
    for r in relations.nearest_partners(relations.prepared(findings)).collect():
        near.setdefault(r.id, []).append((r.n, r.partner))
    rows = {r.finding_id: r for r in relations.evidence_chains(findings, files=files).collect()}
    kinds = {r.finding_id: r for r in findings.collect()}
    assert len(rows) == 60
    for i, r in rows.items():
        ids = [p for _, p in sorted(near.get(i, []))]
        assert r.nearest_ids == ids
        parts = r.evidence_chain.split(" | ")
        number = int(i[2:])
        assert parts[:2] == ["primary: seen", f"source: f{number}.log line {number} hash h{number}"] and parts[-1].startswith("a lead")
        assert parts[2 : 2 + len(ids)] == [f"related {p}: {kinds[p].source_type} {kinds[p].category} score 40" for p in ids]
        notes = parts[2 + len(ids) : -1]
        assert len(notes) == min(6, len(ids) + (2 if i == "F-00003" else 0))
        if i == "F-00003":
            assert notes[:2] == ["file_context: Web file x", "file_context: Web file y"]


def test_first_network_over_nested_ones(spark):
    random.seed(6)
    networks = []
    for i in range(150):
        if i % 3:
            base = ipaddress.ip_address(random.choice([0x0A000000, 0x0A010000, 0xC0A80000, 0]) + random.randint(0, 0x1FFFF))
            bits = random.choice([0, 8, 9, 15, 16, 20, 24, 27, 31, 32]) if i > 10 else 32
        else:
            base = ipaddress.ip_address((0x20010DB8 << 96) + random.choice([0, 1 << 64]) + random.randint(0, 1 << 20))
            bits = random.choice([0, 3, 32, 48, 63, 64, 100, 112, 128]) if i > 10 else 128
        networks.append((str(ipaddress.ip_network((base, bits), strict=False)), (i * 37) % 150, f"C{i}"))
    networks += [("255.255.255.255/32", 900, "last"), ("ffff:ffff:ffff:ffff:ffff:ffff:ffff:fff0/124", 901, "end"), ("not a network", 0, "bad"), ("10.0.0.0/33", 0, "bad")]
    addresses = [str(ipaddress.ip_address(random.choice([0x0A000000, 0x0A010000, 0xC0A80000]) + random.randint(0, 0x2FFFF))) for _ in range(300)]
    addresses += [str(ipaddress.ip_address((0x20010DB8 << 96) + random.choice([0, 1 << 64]) + random.randint(0, 1 << 21))) for _ in range(200)]
    addresses += ["255.255.255.255", "0.0.0.0", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "::ffff:10.0.0.1", "garbage", None, "10.0.0.1", "10.0.0.1"]
    for some in (networks, [n for n in networks if n[1] % 5 == 0 and not n[0].startswith(("0.0.0.0/0", "::/0"))]):
        table = spark.createDataFrame(some, "network string, file_order long, country string")
        got = {r.a: (r.network, r.country) for r in enrich.first_network(spark.createDataFrame([(a,) for a in addresses], "a string"), "a", table).collect()}
        want = {}
        for a in set(addresses) - {None, "garbage"}:
            ip = ipaddress.ip_address(a)
            ip = getattr(ip, "ipv4_mapped", None) or ip
            inside = [(order, n, c) for n, order, c in some if c != "bad" and ip.version == ipaddress.ip_network(n).version and ip in ipaddress.ip_network(n)]
            if inside:
                want[a] = min(inside)[1:]
        assert got == want and len(want) > 100
        low = [r.low for r in enrich.flattened(table).collect()]
        assert len(low) == len(set(low))
    empty = enrich.first_network(spark.createDataFrame([("1.1.1.1",)], "a string"), "a", table.limit(0))
    assert empty.count() == 0
