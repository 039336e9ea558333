"""Byte ranges, committed files, literal search and values carried inside splits."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, StringEndsWith

from tracelight.sinks import committed
from tracelight.sources import app, host_config, ranges, signatures, web
from tracelight.sources.lines import read_log_lines


def _read(reader):
    return [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]


@pytest.mark.parametrize("range_bytes", [1, 2, 7, 64, 1000, 1 << 20])
def test_terminated_records(tmp_path, range_bytes):
    random.seed(range_bytes)
    files = {}
    for no in range(6):
        parts = ["".join(random.choice("ab\n<e>/") for _ in range(random.randint(0, 30))) for _ in range(random.randint(0, 12))]
        text = "</e>".join(parts) + random.choice(["", "</e>", "\n", "</e", "</e></e>"])
        (tmp_path / f"f{no}.xml").write_text(text)
        files[f"f{no}.xml"] = text
    want = []
    for name, text in files.items():
        pieces = text.split("</e>")
        at = 0
        for i, piece in enumerate(pieces):
            if i + 1 < len(pieces) or piece:
                want.append((name, at, text.count("\n", 0, at), piece))
            at += len(piece) + 4
    reader = ranges.RangeReader({"paths": str(tmp_path), "mode": "terminated", "terminator": b"</e>".hex(), "rangeBytes": str(range_bytes)})
    before = {(r["path"], r["range_start"]): r["lines_before"] for r in _read(ranges.RangeReader({"paths": str(tmp_path), "mode": "newlines", "rangeBytes": str(range_bytes)}))}
    got = []
    for r in _read(reader):
        earlier = sum(n for (path, start), n in before.items() if path == r["path"] and start < r["range_start"])
        got.append((r["name"], r["offset"], earlier + r["lines_before"], r["content"].decode()))
    assert sorted(got) == sorted(want)


def test_chunks_records_and_pruning(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 10)
    (tmp_path / "sub" / "b.bin").write_bytes(b"x" * 1000)
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "_hidden.bin").write_bytes(b"x")
    for r in ranges.read_chunks(spark, str(tmp_path), chunk=300, overlap=20, range_bytes=700).collect():
        data = (tmp_path / "a.bin").read_bytes() if r.name == "a.bin" else b"x" * 1000
        assert r.offset % 300 == 0 and bytes(r.content) == data[r.offset : r.offset + 320] and r.size == len(data)
    found = ranges.read_records(spark, str(tmp_path), 384, range_bytes=500)
    assert sorted((r.name, r.record_no, bytes(r.content)[:1]) for r in found.collect()) == [("a.bin", i, bytes([384 * i % 256])) for i in range(6)] + [("b.bin", i, b"x") for i in range(2)]
    few = ranges.read_chunks(spark, str(tmp_path), chunk=300).where("size > 1500").where(F.col("name").startswith("a"))
    assert {r.name for r in few.collect()} == {"a.bin"} and "Filter" not in few._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    reader = ranges.RangeReader({"paths": str(tmp_path)})
    left = list(reader.pushFilters([GreaterThan(("size",), 1500), EqualTo(("offset",), 0), StringEndsWith(("name",), ".bin"), IsNotNull(("size",))]))
    assert [type(f) for f in left] == [EqualTo] and [p[0][0].rsplit("/", 1)[-1] for p in (x.pieces for x in reader.partitions())] == ["a.bin"]
    with pytest.raises(ValueError):
        ranges.RangeReader({"paths": "/", "mode": "terminated", "terminator": b"aba".hex()})
    assert len(ranges.cut([(f"f{i}", 10, 0.0) for i in range(5000)], 1 << 20)) > 100  # opening files counts, too


def test_committed_lines(spark, tmp_path):
    path = str(tmp_path / "out")
    assert committed.read_lines(spark, path).count() == 0
    rows = spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("value"))
    committed.write_lines(rows, path)
    first = committed.read_manifest(path)
    assert first["rows"] == 1000 and len(first["files"]) == 4
    text = "".join((tmp_path / "out" / f["file"]).read_text() for f in first["files"])
    assert text == "".join(f"{i}\n" for i in range(1000))  # partition order

    @F.udf("string")
    def fails(value):
        if value == "777":
            raise RuntimeError("lost")
        return value

    with pytest.raises(PySparkException):
        committed.write_lines(rows.select(fails("value").alias("value")), path)
    assert committed.read_manifest(path) == first and committed.read_lines(spark, path).count() == 1000
    (tmp_path / "out" / "part-000009-attempt.txt").write_text("of an attempt that died\n")
    assert committed.read_lines(spark, path).count() == 1000 and any("attempt" in f for f in committed.unlisted_files(path))
    committed.write_lines(rows.where("value < 10"), path, append=True)
    assert committed.read_lines(spark, path).count() == 1000 + rows.where("value < 10").count()
    committed.write_lines(rows.limit(3), path)
    assert committed.read_lines(spark, path).count() == 3 and not [f for f in first["files"] if (tmp_path / "out" / f["file"]).exists()]
    files = committed.committed_files(spark, path).collect()
    assert sum(f.rows for f in files) == 3 and all(len(f.sha256) == 64 for f in files)
    odd = spark.createDataFrame([("a\nb", None, [1.5]), (None, 2, None)], "t string, n int, xs array<double>")
    committed.write_jsonl(odd, path)
    assert sorted(committed.read_jsonl(spark, path, odd.schema).collect(), key=str) == sorted(odd.collect(), key=str)
    assert json.loads(committed.read_lines(spark, path).where("value like '%1.5%'").head()[0]) == {"t": "a\nb", "n": None, "xs": [1.5]}


_RULE_FILE = r'''
/* rule commented : out { strings: $a = "never" condition: any of them } */
rule next_line : web shell
{
    meta:
        note = "rule inner { strings: $x = \"no\" }"
    strings:
        $a = "eval(" nocase   // not "this" one
        $b = "condition: }" wide
        $h = { 4d 5a ?? [2-4] }
        $r = /ab{2}c\/"d/ i
    condition:
        any of them
}
private global rule one_line{strings:$x="a\"b" $y = "\\x" nocase condition:$x or $y}
rule empty { condition: true }
rule last : t { strings: $z = "tail"'''


def test_rule_files():
    rules = signatures.parse_literal_rules(_RULE_FILE + "}", "ns")
    assert [(r.name, r.tags, r.literals) for r in rules] == [
        ("next_line", ("web", "shell"), (("eval(", True), ("condition: }", False))), ("one_line", (), (('a"b', False), ("\\x", True))), ("last", ("t",), (("tail", False),))]
    assert signatures.parse_literal_rules("", "n") == []


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 20])
def test_literals_at_once(spark, chunk):
    random.seed(chunk)
    rules = [signatures.LiteralRule("n", "a", (), (("aba", False), ("ab", True), ("BA", True))), signatures.LiteralRule("n", "b", ("t",), (("a", False), ("é", False), ("b" * 30, True)))]
    files = {f"f{i}": "".join(random.choice("aAbB é\0") for _ in range(random.randint(0, 200))).encode() + b"b" * 31 for i in range(8)}
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()] + [("none", bytearray())], "path string, content binary")
    want = {}
    for path, data in files.items():
        for rule in rules:
            at = {m.start() for v, fold in rule.literals for m in re.finditer(b"(?=" + re.escape(v.encode()) + b")", data, re.I if fold else 0)}
            if at:
                want[path, rule.name] = sorted(at)
    if chunk == 1:
        df, want = df.where("path = 'f0'"), {k: v for k, v in want.items() if k[0] == "f0"}
    got = {}
    for r in signatures.signature_offsets(df, rules, chunk=chunk).collect():
        got.setdefault((r.path, r.rule_name), []).append(r.offset)
    assert {k: sorted(v) for k, v in got.items()} == want
    matches = {(r.path, r.rule_name): (r.match_count, r.matched_offsets_summary) for r in signatures.signature_matches(df, rules, chunk=chunk).collect()}
    assert matches == {k: (len(v), ";".join(f"0x{o:x}" for o in v[:8])) for k, v in want.items()}


@pytest.fixture
def small_splits(spark):
    """Splits of a few lines, several files to a task."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if re.search(r"\bExchange\b", line)]


def test_headers_carried_inside_splits(spark, tmp_path, small_splits):
    random.seed(8)
    want = []
    for no in range(5):
        out, fields = [], None
        for line in range(1, 120):
            pick = random.random()
            if line == 1 and no == 3:
                out.append("2020-01-01 before any header")
            elif pick < 0.06 or (line == 1 and no != 4):
                fields = random.choice([["date", "time", "c-ip", "cs-method"], ["cs-method", "c-ip", "date", "time"], ["c-ip", "cs-method"]])
                out.append("#Fields: " + " ".join(fields))
            elif pick < 0.1:
                out.append("")
            else:
                values = {"date": "2024-05-01", "time": "00:00:01", "c-ip": f"10.0.{no}.{line}", "cs-method": "GET"}
                out.append(" ".join(values[f] for f in fields or ["c-ip", "cs-method"]))
                if fields:
                    want.append((no, line, f"10.0.{no}.{line}", "GET"))
        (tmp_path / f"u_ex{no}.log").write_text("\n".join(out) + "\n")
    lines = read_log_lines(spark, str(tmp_path))
    assert lines.select("source_file", "_split").distinct().count() > 20
    number = F.regexp_extract("source_file", r"u_ex(\d)", 1).cast("int")
    for parsed in (web.parse_iis(lines), web.parse_web(lines)):
        assert sorted(tuple(r) for r in parsed.events.select(number, "line_number", "remote_ip", "method").collect()) == sorted(want)
        assert not _exchanges(parsed.events) and not _exchanges(parsed.rejects)
    plain = lines.drop("_split")  # the same through blocks of line numbers
    assert sorted(tuple(r) for r in web.parse_iis(plain).events.select(number, "line_number", "remote_ip", "method").collect()) == sorted(want)


def test_history_and_traces_inside_splits(spark, tmp_path, small_splits):
    random.seed(9)
    for no in range(4):
        out = [random.choice([f"#{1700000000 + i}", f"run {no} {i}", f"part {no} {i} \\", f": {1600000000 + i}:0;zsh {no} {i}", ""]) for i in range(150)]
        (tmp_path / f"h{no}").write_text("\n".join(out) + "\n")
    lines = read_log_lines(spark, str(tmp_path))
    inside = host_config.parse_shell_history(lines)
    assert not _exchanges(inside)
    blocks = host_config.parse_shell_history(lines.drop("_split"))
    assert sorted(inside.collect()) == sorted(blocks.collect()) and inside.where("timestamp <> ''").count() > 100
    logs = tmp_path / "logs"
    logs.mkdir()
    for no in range(3):
        (logs / f"app{no}.log").write_text("\n".join(random.choice(["2024-05-01 00:00:01 ERROR boom {}", "  at frame({});", "plain words {};"]).format(i) for i in range(200)) + "\n")
    lines = read_log_lines(spark, str(logs))
    pick = lambda lines: sorted(tuple(r) for r in app.parse_app(lines).events.select("source_file", "line_number", "message_summary").collect())
    assert pick(lines) == pick(lines.drop("_split"))


def test_carry_without_broadcast(spark, tmp_path, small_splits, monkeypatch):
    """Beyond the checked size both sides are shuffled, and the result is the same."""
    from tracelight.functions import frames
    from tracelight.operators import splits

    for no in range(3):
        (tmp_path / f"f{no}").write_text("\n".join(f"{'#' if i % 17 == 3 else ''}{i}" for i in range(400)))
    lines = read_log_lines(spark, str(tmp_path))
    mark = {"last": F.when(F.col("text").startswith("#"), F.col("text"))}
    want = sorted(splits.carry_in_splits(lines, mark).select("source_file", "line_number", "last").collect(), key=str)
    assert [r.last for r in want if r.line_number == 400] == ["#394"] * 3
    monkeypatch.setattr(splits, "joined_narrow", lambda df, narrow, on: frames.joined_narrow(df, narrow, on, most_rows=0))
    moved = splits.carry_in_splits(lines, mark)
    assert sorted(moved.select("source_file", "line_number", "last").collect(), key=str) == want
    before = splits.carry_in_splits(lines, mark, before=True).where("line_number = 4").select("last").distinct().collect()
    assert [r.last for r in before] == [None]
