"""Sources, assembly, rewrites, search, traces, pages, reports and export."""

import json

import pytest
from pyspark.sql import functions as F

from loglathe.functions.axes import with_axes
from loglathe.functions.fields import parse_object
from loglathe.functions.recover import recover_object
from loglathe.operators import counts, rewrite, search, trace, windows
from loglathe.operators.multiline import assemble_multiline, trace_to_record
from loglathe.operators.normalize import normalize_export
from loglathe.operators.ordered import with_rec_no
from loglathe.operators.sizes import join_small
from loglathe.options import ParseOptions
from loglathe.plans.parse import parse_lines, parse_logs
from loglathe.sinks.ndjson import export
from loglathe.sources.json import read_json_logs
from loglathe.sources.lines import number_lines, scan_text
from loglathe.sources.session import failed_files, inline

PLAIN = """2031-07-08 01:00:00 WARN disk sda1 is 91% full
2031-07-08 01:00:09 ERROR mount of /backup refused
2031-07-08 01:02:10 INFO nightly copy started
2031-07-08 01:02:11 DEBUG queue length 14
2031-07-08 01:40:00 ERROR checksum differs for part 7
2031-07-08 01:40:02 WARN part 7 is sent again
2031-07-08 01:59:59 INFO nightly copy done
"""
TRACES = {
    "header": (
        "2031-07-08 02:00:00,004 ERROR in billing: Exception on /invoices/77 [POST]\n"
        "Traceback (most recent call last):\n"
        '  File "/srv/billing/views.py", line 31, in create\n    total = sum_of(rows)\n'
        '  File "/srv/billing/sums.py", line 9, in sum_of\n    return rows[0] + rows[1]\n'
        "IndexError: list index out of range",
        "python_traceback",
        {"level": "ERROR", "type": "IndexError", "message": "list index out of range",
         "url": "/invoices/77", "method": "POST"}),
    "bare": (
        "Traceback (most recent call last):\n"
        '  File "/srv/mail/send.py", line 5, in flush\n    box.close()\n'
        "mail.box.BoxClosed: the box was closed twice",
        "python_traceback",
        {"type": "mail.box.BoxClosed", "message": "the box was closed twice"}),
    "dump": (
        "goroutine 88 [running]:\nmain.loop()\n\t/src/loop.go:12 +0x1f\n"
        "main.step(0x3, {0xc1?, 0x2?})\n\t/src/step.go:40 +0x77\nmain.(*Wheel).turn(0xd2)\n"
        "\t/src/wheel.go:3 +0x10", "go_panic", {"level": "FATAL", "goroutine": 88}),
    "panic": (
        "2031/07/08 02:10:00 http: panic serving 192.0.2.7:1200: division by zero\n"
        "goroutine 91 [running]:\nmain.share(0x0)\n\t/src/share.go:8 +0x2d",
        "go_panic", {"type": "panic", "message": "division by zero"}),
    "group": (
        "ExceptionGroup: two jobs failed (1 sub-exception)\n"
        "  + Exception Group Traceback (most recent call last):\n"
        '  |   File "/srv/jobs/run.py", line 70, in gather\n  |     await job\n'
        "  | TimeoutError: job 4 took too long\n  +------------------------------------",
        "exception_group", {"type": "ExceptionGroup"}),
    "lone": ("ValueError: seven is not a colour", "text", {"message": "ValueError: seven is not a colour"}),
}


def records(spark, *rows, file_id="f"):
    return spark.createDataFrame(
        [(file_id, i, json.dumps(r)) for i, r in enumerate(rows)], "file_id string, rec_no bigint, raw string"
    ).withColumn("fields", parse_object(F.col("raw")))


def fields_of(df, order="rec_no"):
    return [json.loads(r["j"]) for r in df.orderBy(order).select(F.to_json("fields").alias("j")).collect()]


def test_plain_log_metrics(spark):
    p = parse_lines(inline(spark, PLAIN))
    row = p.report.first()
    assert (row["total_lines"], row["filtered"], row["errors"], row["warnings"]) == (7, 7, 2, 2)
    assert row["status"] == "ok" and p.diagnostics.first()["code"] == "FORMAT_DETECTED"
    only = parse_lines(inline(spark, PLAIN), ParseOptions.of(log_levels=["error "])).report.first()
    assert only["errors"] == only["filtered"] == 2 and only["warnings"] == 0


def test_blank_input_has_no_records(spark):
    p = parse_lines(inline(spark, "   \n  \n"))
    assert p.records.count() == 0
    assert "NO_RECORDS" in {r["code"] for r in p.diagnostics.collect()}


@pytest.mark.parametrize("rows", [65536, 2, 3])
def test_traces_become_one_record(spark, rows):
    text = "\n".join(t for t, _, _ in TRACES.values())
    one = trace_to_record(assemble_multiline(inline(spark, text), rows)).orderBy("line_no")
    got = one.select("kind", F.to_json("fields").alias("j"), "raw").collect()
    assert [g["kind"] for g in got] == [k for _, k, _ in TRACES.values()]
    assert [g["raw"] for g in got] == [t for t, _, _ in TRACES.values()]
    for g, (_, _, expected) in zip(got, TRACES.values()):
        found = json.loads(g["j"])
        assert {k: found.get(k) for k in expected} == expected
    assert len(json.loads(got[0]["j"])["frames"]) == 2
    assert json.loads(got[4]["j"])["sub_exceptions"][0]["type"] == "TimeoutError"


def test_csv_with_json_and_line_breaks(spark):
    text = (
        '"@timestamp","zone","message"\n'
        '"2031-07-08T03:00","north","{""level"": ""ERROR"", ""why"": ""first:\n  second\n  third""}"\n'
        '"2031-07-08T03:05","south","{""level"": ""INFO"", ""status"": 204, ""msg"": ""one, two [three]""}"\n'
    )
    p = parse_lines(inline(spark, text))
    got = fields_of(p.records)
    assert p.formats.first()["format"] == "csv" and len(got) == 2
    assert got[1] == {"zone": "south", "level": "INFO", "status": 204, "msg": "one, two [three]",
                      "timestamp": "2031-07-08T03:05"}


@pytest.mark.parametrize("text,expected", [
    ('{"a":1}\n{"a":"}, {"}\n{"cut": \n{"a":2}', [{"a": 1}, {"a": "}, {"}, {"message": '{"cut":'}, {"a": 2}]),
    ('[{"a":1}, {"a":{"b":[{"x":1}, {"x":2}]}},{"a":3}]', [{"a": 1}, {"a": {"b": [{"x": 1}, {"x": 2}]}}, {"a": 3}]),
    ('[\n {\n  "a": 1,\n  "b": [1,\n2]\n }, {\n "a": {"c": "{"}\n }\n]', [{"a": 1, "b": [1, 2]}, {"a": {"c": "{"}}]),
])
@pytest.mark.parametrize("rows", [65536, 2])
def test_json_layouts(spark, text, expected, rows):
    assert fields_of(read_json_logs(inline(spark, text), rows=rows), "line_no") == expected


def test_files_with_splits_charsets_and_a_missing_file(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("2031-07-08 04:00:00 ERROR Ошибка\n".encode("cp1251") * 2)
    (tmp_path / "b.jsonl").write_text('{"level":30,"msg":"x","req_id":"A1"}\n{"level":50,"msg":"{\\"a\\":\\"b"}\n')
    p = parse_logs(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.jsonl")])
    by = {r["file_id"].rsplit("/", 1)[1]: r for r in p.report.collect()}
    assert by["a.log"]["fallback"] and by["a.log"]["encoding"] == "cp1251" and by["a.log"]["filtered"] == 1
    assert (by["b.jsonl"]["format"], by["b.jsonl"]["errors"], by["b.jsonl"]["unexpanded"]) == ("jsonl", 1, 1)
    assert "Ошибка" in p.records.filter("level = 'ERROR'").orderBy("file_id").first()["msg"]
    asked = spark.createDataFrame([(r["file_id"],) for r in p.report.collect()] + [("gone",)], "file_id string")
    assert [r["file_id"] for r in failed_files(asked, p.lines).collect()] == ["gone"]


def test_line_numbers_over_many_splits(spark, tmp_path):
    for name, n in (("a.log", 3000), ("b.log", 700)):
        (tmp_path / name).write_text("".join(f"{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        scanned = scan_text(spark, str(tmp_path))
        assert scanned.select("split").distinct().count() > 5
        assert number_lines(scanned).filter("line_no <> cast(raw_line as bigint)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_normalize_is_idempotent_for_plain_exports(spark):
    df = records(
        spark, {"sql": "S", "_meta.event_original.sql": "T", "_meta.event_original.u": 1, "_meta.id": "x",
                "_meta.z": 2, "@timestamp": "t", "@version": 1},
        {"_meta": {"event_original": {"k": 1}, "id": 3, "w": 2}, "a": 1}, {"q": 1}, {"@timestamp": None},
    )
    once = normalize_export(df)
    assert fields_of(once) == [{"sql": "S", "u": 1, "z": 2, "timestamp": "t"}, {"a": 1, "k": 1, "w": 2}, {"q": 1}, {}]
    assert fields_of(normalize_export(once)) == fields_of(once)


def test_flatten_goes_as_deep_as_the_record(spark):
    nested = {"leaf": 1, "arr": [{"k": 1}]}
    for i in range(12):
        nested = {f"n{i}": nested, "side": i}
    got = fields_of(rewrite.flatten(records(spark, nested, {"flat": "{{{"})))
    path = ".".join(f"n{i}" for i in reversed(range(12)))
    assert got[0][f"{path}.leaf"] == 1 and got[0][f"{path}.arr"] == [{"k": 1}] and got[0]["side"] == 11
    assert got[1] == {"flat": "{{{"}


@pytest.mark.parametrize("text,expected", [
    ('{"a":"x "y" z","b":1,"c":{"d":2}}', ({"a": '"x "y" z"', "b": 1, "c": {"d": 2}}, True)),
    ('{"a":1}', ({"a": 1}, False)),
    ('{"u":[1,2}, "v":3', ({"u": "[1,2"}, True)),
    ('{"k\\"q":1,,}', ({'k"q': "1,,"}, True)),
    ("[1", (None, False)), ("{x}", (None, False)), ("{", (None, False)),
])
def test_recover(text, expected):
    assert recover_object(text) == expected


def test_search_and_trace(spark):
    r = with_axes(records(spark, {"level": "ERROR", "service": "api-gateway", "req_id": "A1", "message": "timeout boom"}))
    hit = lambda **q: search.search(r, **q).count() == 1
    assert hit(levels=["ERROR"]) and hit(srcs=["api"]) and hit(reqs=["a1"]) and hit(words=["timeout", "BOOM"])
    assert not hit(reqs=["A"]) and not hit(words=["timeout", "nope"]) and not hit(levels=["warn"])
    both = with_axes(
        records(spark, {"req_id": "A1", "message": "in"}, {"req_id": "B2"}, {"req_id": "A1", "message": "out"}, file_id="f1")
        .unionByName(records(spark, {"trace_id": "A1", "message": "job"}, {"message": "no id"}, file_id="f2"))
    )
    key = lambda df: [(x["file_id"], x["rec_no"]) for x in trace.in_order(df).collect()]
    assert key(trace.trace(both, "A1")) == [("f1", 0), ("f1", 2), ("f2", 0)]
    assert key(trace.trace(both, "")) == [] and key(trace.trace(both, "ZZ")) == []
    anchors = spark.createDataFrame([("f2", 0), ("f2", 1)], "file_id string, rec_no bigint")
    assert key(trace.trace_of(both, anchors)) == [("f1", 0), ("f1", 2), ("f2", 0)]


def test_salted_join_equals_broadcast_join(spark):
    big = spark.range(1000).selectExpr("id AS rec_no", "id % 3 AS k")
    small = spark.range(2).selectExpr("id AS k", "id * 10 AS v")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = (sorted(map(tuple, join_small(big, small, ["k"], how, max_rows=m).collect()), key=repr) for m in (10, 1))
        assert a == b and a


def test_facets_without_filters_are_plain_counts(spark):
    r = with_axes(records(spark, {"level": "ERROR", "service": "a"}, {"level": "INFO", "service": "a"}, {"msg": "x"}))
    f = {(x["facet"], x["name"]): x["n"] for x in counts.facets(r).collect()}
    assert {n: v for (k, n), v in f.items() if k == "bucket"} == {x["bucket"]: x["n"] for x in counts.bucket_counts(r).collect()}
    assert [(x["source"], x["n"]) for x in counts.source_counts(r).collect()] == [("a", 2), ("", 1)]
    assert f["source", ""] == 1 and f["bucket", "WARN"] == 0


def test_positions_pages_and_duplicates(spark):
    df = spark.range(22).selectExpr("'f' AS file_id", "id AS line_no", "'ERROR' AS bucket")
    numbered = with_rec_no(df, rows=5)
    assert numbered.filter("line_no <> rec_no").count() == 0
    bins = [r["n"] for r in counts.level_histogram(numbered, "ERROR").orderBy("bin").collect()]
    assert sum(bins) == 22 and bins[0] == bins[10] == 2
    pages = [r["rec_no"] for o in range(0, 22, 7) for r in windows.page(numbered, o, 7).orderBy("rec_no").collect()]
    assert pages == list(range(22))
    assert windows.check_page(0, 50_000) == (0, 10_000)
    for bad in ((0, 0), (-1, 5), (0, True)):
        with pytest.raises(ValueError):
            windows.check_page(*bad)
    twice = records(spark, {"a": 1, "b": "x"}, {"b": "x", "a": 1}, {"a": "1", "b": "x"})
    assert sorted(r["rec_no"] for r in windows.dedup(twice).collect()) == [0, 2]


def test_options_are_checked():
    for bad in ({"remove_ansi": "yes"}, {"encoding": "no-such"}, {"log_levels": "ERROR"}, {"cap": 0}, {"x": 1}):
        with pytest.raises(ValueError):
            ParseOptions.of(**bad)


@pytest.mark.parametrize("gzip", [False, True])
def test_export_round_trip(spark, tmp_path, gzip):
    r = records(spark, {"level": "INFO", "n": None, "o": {"k": [1]}}, {"level": "ERROR", "code": 5})
    export(r, str(tmp_path / "out"), gzip=gzip, per_file=True, flat=True)
    back = spark.read.text(str(tmp_path / "out/records")).collect()
    assert sorted((json.loads(x["value"]) for x in back), key=str) == sorted(
        [{"level": "INFO", "n": None, "o.k": [1]}, {"level": "ERROR", "code": 5}], key=str)
    assert {x["file_id"] for x in back} == {"f"}
    meta = spark.read.json(str(tmp_path / "out/meta")).first()
    assert (meta["exported"], meta["truncated"]) == (2, False)
