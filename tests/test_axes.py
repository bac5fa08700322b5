"""Single records and the axes they must give."""

import json

import pytest
from pyspark.sql import functions as F

from loglathe.functions.axes import fmt_nanos, with_axes
from loglathe.functions.fields import parse_object
from loglathe.functions.highlight import highlight

TS = "2031-08-09 05:06:07"
WIDE_SQL = ("\n  select\n\tp.shelf_no,  p.weight_g\n  from depot.pallet p\n\tjoin depot.shelf s "
            "on s.shelf_no = p.shelf_no\n  where s.level_no > 4 and p.open")


def raw(text):
    return {"raw": text, "timestamp_iso": TS}


CASES = [
    # level: names, numbers of both scales, text, what isn't one
    ("level", {"level": "critical"}, "CRITICAL"),
    ("level", {"severity": "Information"}, ""),
    ("level", {"lvl": "err"}, ""),
    ("level", raw("<7> WARN pump dry"), "WARN"),
    ("level", {"handler": "warn_hook", "message": "tank full"}, ""),
    ("level", {"severity": 1}, "FATAL"),
    ("level", {"severity": 7}, "DEBUG"),
    ("level", {"level": 40}, "WARN"),
    ("level", {"level": 10}, "TRACE"),
    ("level", {"level": 999}, ""),
    ("level", {"level": False}, ""),
    ("level", {"level": "50"}, ""),
    ("level", {"level": "DEBUG", "severity": 2}, "DEBUG"),
    ("bucket", {"level": "critical"}, "ERROR"),
    ("bucket", {"severity": 5}, "INFO"),
    ("bucket", {"level": "trace"}, "DEBUG"),
    ("bucket", {"message": "tank full"}, "OTHER"),
    # source
    ("source", {"service": "pump-7"}, "pump-7"),
    ("source", {"service_name": "valve"}, "valve"),
    ("source", raw("2031 WARN boiler-room steam"), "boiler-room"),
    ("source", raw("2031 ERROR DELETE /tanks/3 404"), ""),
    ("source", {"message": "tank full"}, ""),
    ("source", {"log": "up", "_meta": {"kubernetes_labels_service_name": "k9"}}, "k9"),
    ("source", {"service_name": "outer", "_meta": {"kubernetes_labels_service_name": "in"}}, "outer"),
    # request id
    ("req_id", {"trace_id": "0b-55e"}, "0b-55e"),
    ("req_id", {"requestId": "Q4"}, "Q4"),
    ("req_id", raw("<7> req_id=Z8 opened"), "Z8"),
    ("req_id", raw("<7> trace_id: c0ffee12 closed"), "c0ffee12"),
    ("req_id", raw("<7> nothing to follow"), ""),
    # time text
    ("ts_text", {"timestamp_iso": TS}, "05:06:07"),
    ("ts_text", {"timestamp": "Mar 2, 2031 @ 21:10:09.004"}, "21:10:09.004"),
    ("ts_text", {"timestamp": "Mar 2, 2031 @ 21:10:09.004", "time": "2031-03-02T18:10:09.120+0000"}, "18:10:09.120"),
    # message
    ("msg", raw("2031 WARN pump dry"), "2031 WARN pump dry"),
    ("msg", {"crew": "olga", "bay": 12}, "crew=olga · bay=12"),
    ("msg", {"p": None, "q": {"y": [2]}, "r": "u  v\n w", "col_8": "x", "_meta": {"z": 2}}, 'p=null · q={"y":[2]} · r=u v w'),
    # summary, HTTP context, SQL, line
    ("summary", {"msg": "Valve opened", "method": "PUT", "url": "/valves/9"}, "PUT /valves/9 · Valve opened"),
    ("summary", {"msg": "Valve shut", "method": "PUT", "url": "/v", "status": 503, "request_time": 41300000},
     "PUT /v · → 503 · 41ms · Valve shut"),
    ("summary", {"msg": "done", "request_time": 615300}, "615µs · done"),
    ("summary", {"msg": "bare"}, "bare"),
    ("summary", {"method": "HEAD", "url": "/v"}, "HEAD /v"),
    ("summary", {"msg": "reading", "sql": "select level_no from depot.shelf"},
     "reading · sql: select level_no from depot.shelf"),
    ("sql_snip", {"sql": "DELETE\nFROM depot\nWHERE n=4"}, "DELETE FROM depot WHERE n=4"),
    ("sql_snip", {"query": "SELECT 77"}, "SELECT 77"),
    ("sql_snip", {"msg": "tank full"}, ""),
    ("http", {"msg": "Shut", "method": "put", "url": "/v", "status": 503, "request_time": 41300000},
     ("PUT", "/v", "503", "41ms")),
    ("http", {"msg": "bare"}, ("", "", "", "")),
    ("line", {"level": "WARN", "service": "pump-7", "message": "dry"}, "WARN  pump-7  dry"),
]


@pytest.fixture(scope="module")
def axes(spark):
    df = spark.createDataFrame(
        [(i, json.dumps(r, ensure_ascii=False)) for i, (_, r, _) in enumerate(CASES)],
        "i int, raw string",
    ).withColumn("fields", parse_object(F.col("raw")))
    return {r["i"]: r for r in with_axes(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_axis(axes, i):
    axis, _, expected = CASES[i]
    got = axes[i][axis]
    assert (tuple(got) if axis == "http" else got) == expected


def test_long_sql_is_cut(spark):
    df = spark.createDataFrame([(json.dumps({"sql": WIDE_SQL}),)], "raw string")
    snip = with_axes(df.withColumn("fields", parse_object(F.col("raw"))), "sql_snip").first()["sql_snip"]
    assert snip.startswith("select p.shelf_no, p.weight_g from depot.pallet p")
    assert len(snip) <= 81 and snip.endswith("…")


def test_fmt_nanos(spark):
    cases = {500: "500ns", 1500: "2µs", 41300000: "41ms", 2_500_000_000: "2.50s",
             999_999_999: "1000ms", 90_000_000_000: "1.5min", -1: ""}
    df = spark.createDataFrame([(k,) for k in cases], "n bigint")
    assert {r["n"]: r["t"] for r in df.select("n", fmt_nanos(F.col("n")).alias("t")).collect()} == cases


def test_repeated_key_keeps_the_last(spark):
    df = spark.createDataFrame([('{"a":1,"b":2,"a":3}',), ("[1]",), ('{"a":1} x',)], "raw string")
    got = [r[0] for r in df.select(F.to_json(parse_object(F.col("raw")))).collect()]
    assert got == ['{"a":3,"b":2}', None, None]


@pytest.mark.parametrize("text,terms,expected", [
    ("Connection refused", ["refused"], [("Connection ", False), ("refused", True)]),
    ("abcabc", ["ab", "bc"], [("abcabc", True)]),
    ("plain", [], [("plain", False)]),
    ("aaa", ["aa"], [("aa", True), ("a", False)]),
    ("a.b.c", ["."], [("a", False), (".", True), ("b", False), (".", True), ("c", False)]),
])
def test_highlight(spark, text, terms, expected):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(highlight(F.col("t"), terms).alias("h")).first()["h"]
    assert [(s["t"], s["hit"]) for s in got] == expected
