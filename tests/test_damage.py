"""Damaged, packed, mixed, two-byte and very long input."""

import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from loglathe.operators.multiline import assemble_multiline, continuations, trace_to_record
from loglathe.operators.ordered import chunk_of, running_depth, running_state
from loglathe.options import ParseOptions
from loglathe.plans.parse import parse_lines, parse_logs
from loglathe.sources import streams
from loglathe.sources.csv import read_csv_logs
from loglathe.sources.json import read_json_logs
from loglathe.sources.lines import listed, read_files
from loglathe.sources.session import inline


def rows_of(df, *order):
    return [json.loads(r[0]) for r in df.orderBy(*order).select(F.to_json("fields")).collect()]


def files_of(spark, texts):
    """One file for each text."""
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), [inline(spark, t, f"f{i}") for i, t in enumerate(texts)])


CSV = {
    'a,b\n1,x 5" disk\n2,y\n3,z\n': [["1", 'x 5" disk'], ["2", "y"], ["3", "z"]],
    'a,b\n"open,b\n2,y\n3,"m\nn"\n4,z\n': [['"open', "b"], ["2", "y"], ["3", "m\nn"], ["4", "z"]],
    'a,b\n1,"two\nlines, one cell\n"\n"q""q","x"\n': [["1", "two\nlines, one cell\n"], ['q"q', "x"]],
    'a,b\n1,"holds\nc,d\nrows"\n2,y\n': [["1", "holds\nc,d\nrows"], ["2", "y"]],
    'a,b\n1,"lost\nrest\n2,y\n3,"q"\n': [["1", '"lost\nrest'], ["2", "y"], ["3", "q"]],
    'a,b\n"lost,1\n2,"m\nn"\n3,z\n': [['"lost', "1"], ["2", "m\nn"], ["3", "z"]],
}


@pytest.mark.parametrize("rows", [65536, 2])
def test_csv_damage_stays_in_its_row(spark, rows):
    found = read_csv_logs(files_of(spark, CSV), rows=rows).cache()
    for i, expected in enumerate(CSV.values()):
        assert [list(r.values()) for r in rows_of(found.where(f"file_id = 'f{i}'"), "line_no")] == expected


JSON = {
    '{\n"a":1\n}\n}\n{\n"a":2\n}\n{\n"a":3\n}': [{"a": 1}, {"message": "}"}, {"a": 2}, {"a": 3}],
    '{\n "a":{\n  "b":1\n }\n{\n "a":2\n}\n{\n "a":[{\n"c":3}]\n}': [
        {"message": '{\n "a":{\n  "b":1\n }'}, {"a": 2}, {"a": [{"c": 3}]}],
    '[\n  {\n    "a": 1,\n    "s": "}{"\n  },\n  {\n    "a": 2\n  }\n]': [{"a": 1, "s": "}{"}, {"a": 2}],
}


@pytest.mark.parametrize("rows", [65536, 3])
def test_json_damage_stays_in_its_object(spark, rows):
    found = read_json_logs(files_of(spark, JSON), layout="spread", rows=rows).cache()
    for i, expected in enumerate(JSON.values()):
        assert rows_of(found.where(f"file_id = 'f{i}'"), "line_no", "part") == expected


def test_objects_of_many_texts_keep_their_order(spark):
    lines = spark.createDataFrame([("f", 1 << 50, "{"), ("f", (1 << 50) + 1, '"a":1}, {"a":2'), ("f", (1 << 50) + 2, "}")],
                                  "file_id string, line_no bigint, raw_line string")
    got = read_json_logs(lines, layout="spread").orderBy("line_no", "part")
    assert [(r.line_no - (1 << 50), r.part) for r in got.collect()] == [(0, 0), (1, 1)]
    assert rows_of(got, "line_no", "part") == [{"a": 1}, {"a": 2}]


@pytest.mark.parametrize("rows", [3, 1])
def test_running_state_and_depth(spark, rows):
    import random
    rng = random.Random(rows)
    data = [("ab"[i % 2], i, rng.random() < 0.4, rng.random() < 0.6, *(lambda low: (low + rng.randrange(4), low))(-rng.randrange(3)))
            for i in range(60)]
    df = spark.createDataFrame(data, "f string, i bigint, z boolean, o boolean, t bigint, low bigint").withColumn("c", chunk_of(F.col("i"), rows))
    states = {r.i: r._state for r in running_state(df, ["f"], "c", "i", F.col("z"), F.col("o")).collect()}
    depths = {r.i: r._depth for r in running_depth(df, ["f"], "c", "i", F.col("t"), F.col("low")).collect()}
    for f in "ab":
        state = depth = 0
        for _, i, z, o, t, low in (x for x in data if x[0] == f):
            assert (states[i], depths[i]) == (state, depth)
            state, depth = int(o if state else z), max(depth + low, 0) + t - low


def cut_gz(lines):
    packed = gzip.compress("".join(f"{x}\n" for x in lines).encode(), compresslevel=1)
    return packed[:len(packed) // 2]


LOG = [f"2031-02-03 04:05:{i % 60:02} {'ERROR' if i % 9 == 0 else 'INFO'} gate line {i}" for i in range(20_001)]


def test_a_broken_file_is_reported_and_the_others_go_on(spark, tmp_path):
    (tmp_path / "cut.log.gz").write_bytes(cut_gz(LOG))
    (tmp_path / "no.log.gz").write_bytes(b"plain text\n")
    (tmp_path / "good.log.gz").write_bytes(gzip.compress(("\n".join(LOG[:9]) + "\n").encode()) + gzip.compress(LOG[9].encode()))
    (tmp_path / "good.log.bz2").write_bytes(bz2.compress("\n".join(LOG[:7]).encode()))
    (tmp_path / "plain.log").write_text("\n".join(LOG[:5]))
    p = parse_logs(spark, [str(tmp_path), str(tmp_path / "gone.log")], ParseOptions(remove_duplicates=False))
    by = {r.file_id.rsplit("/", 1)[1]: r for r in p.report.collect()}
    assert {n: (r.status, r.total_lines) for n, r in by.items()} == {
        "cut.log.gz": ("error", 0), "no.log.gz": ("error", 0), "good.log.gz": ("ok", 10), "good.log.bz2": ("ok", 7),
        "plain.log": ("ok", 5), "gone.log": ("error", 0)}
    assert "ends too early" in by["cut.log.gz"].error and by["no.log.gz"].error.startswith("DAMAGED_FILE: not gzip")
    assert p.records.count() == 22
    partial = parse_logs(spark, str(tmp_path / "cut.log.gz"), ParseOptions(remove_duplicates=False), keep_partial=True)
    row = partial.report.first()
    assert row.status == "error" and 5_000 < row.total_lines < 20_001 and partial.records.count() == row.total_lines


def test_packed_files_are_scanned_once(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"one\r\ntwo\rthree\n\n" + b"x" * 3_000_000 + b"\nend"))
    rows = streams.scan_packed(spark, listed(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [r.raw_line[:5] for r in rows] == ["one", "two", "three", "", "xxxxx", "end"] and len(rows[4].raw_line) == 3_000_000
    assert [r.line_no for r in rows] == list(range(6)) and all(r.error is None for r in rows)


def test_lines_across_chunks():
    text = b"a\r\nb\rc\n\r\nd\r"
    for size in range(1, 8):
        chunks = [text[i:i + size] for i in range(0, len(text), size)]
        assert list(streams.lines_of(chunks)) == [b"a", b"b", b"c", b"", b"d"]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("codec,mark", [("utf-16-le", "﻿"), ("utf-16-be", "﻿"), ("utf-16-le", ""), ("utf-16-be", "")])
def test_two_byte_files_give_the_same_records(spark, tmp_path, codec, mark, packed):
    lines = [f"2031-02-03 04:05:06 ERROR Сбой {i} ĊਊĀਅ 漢字" for i in range(400)]
    text = "\r\n".join(lines) + "\n"
    name = "w.log.gz" if packed else "w.log"
    data = (mark + text).encode(codec)
    (tmp_path / name).write_bytes(gzip.compress(data) if packed else data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1001")
    try:
        found, broken = read_files(spark, listed(spark, str(tmp_path)))
        got = found.orderBy("line_no").collect()
        assert broken.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.raw_line for r in got] == lines and [r.line_no for r in got] == list(range(400))
    assert {(r.encoding, r.fallback) for r in got} == {(codec, True)}


def test_east_asian_charsets(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("ERROR 障害\nINFO 表示\n".encode("shift_jis"))
    (tmp_path / "b.log").write_bytes("ERROR ошибка\n".encode("cp1251") + b"\xff\x98\n")
    found, _ = read_files(spark, listed(spark, str(tmp_path)), "shift_jis")
    assert {r.raw_line for r in found.where("encoding = 'shift_jis'").collect()} == {"ERROR 障害", "INFO 表示"}
    assert {r.encoding for r in found.where("fallback").collect()} <= {"cp1251", "koi8-r", "latin-1"}
    with pytest.raises(ValueError):
        ParseOptions.of(encoding="utf-7")


def test_formats_of_one_file(spark):
    trace = ["Traceback (most recent call last):", '  File "/srv/a.py", line 3, in f', "    g()", "KeyError: 'k'"]
    lines = ['{"level":"INFO","n":1}', *trace, '{"level":"INFO","n":2}', "2031-02-03 04:05:06 WARN plain", '{"n":3}, {"n":4}',
             *trace[:2], '{"n":5}', "  indented", "ERROR last"]
    p = parse_lines(inline(spark, "\n".join(lines)), ParseOptions(remove_duplicates=False))
    got = rows_of(p.records, "rec_no")
    assert [r.get("n") for r in got if "n" in r] == [1, 2, 3, 4, 5]
    assert [r["type"] for r in got if "traceback" in r and "type" in r] == ["KeyError"]
    assert [r["raw"] for r in got if "raw" in r] == ["2031-02-03 04:05:06 WARN plain", "ERROR last"]
    assert p.formats.first()["mixed"]


def test_a_record_of_any_length_is_one(spark):
    dump = ["panic: out of range", "goroutine 7 [running]:"]
    dump += [x for i in range(50_020) for x in (f"main.f{i}(0x1)", "\t/app/a.go:1 +0x2")][:100_039]
    lines = [(0, "INFO before"), *((1 + i, x) for i, x in enumerate(dump)), (100_042, "INFO after")]
    df = spark.createDataFrame([("f", n, x) for n, x in lines], "file_id string, line_no bigint, raw_line string")
    found = assemble_multiline(df).cache()
    records = trace_to_record(found).select("line_no", F.to_json("fields").alias("j"), "kind").orderBy("line_no").collect()
    assert [(r.line_no, r.kind) for r in records] == [(0, "text"), (1, "go_panic"), (100_042, "text")]
    assert json.loads(records[1].j)["goroutine"] == 7
    more = continuations(found).collect()
    assert [(r.line_no, r.cont, r.raw.count("\n") + 1) for r in more] == [(1, 1, 41)]
    p = parse_lines(df, ParseOptions(remove_duplicates=False))
    assert p.records.count() == 3 and [(r.line_no, r.cont) for r in p.continuations.collect()] == [(1, 1)]
