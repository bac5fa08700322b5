"""Damaged and mixed input through the chain, and the smaller helpers around it."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from loglathe.functions.axes import fmt_nanos
from loglathe.functions.fields import parse_object
from loglathe.functions.highlight import highlight
from loglathe.functions.recover import recover_fields
from loglathe.operators import rewrite, search, trace, windows
from loglathe.options import ParseOptions
from loglathe.plans.parse import parse_lines, parse_logs
from loglathe.sinks.ndjson import export
from loglathe.sources.csv import cells_of, read_csv_logs
from loglathe.sources.json import read_json_logs
from loglathe.sources.session import inline


def test_durations_round_the_binary_value(spark):
    cases = {1_005_000_000: "1.00s", 1_015_000_000: "1.01s", 1_125_000_000: "1.13s", 8_345_000_000: "8.35s",
             59_999_000_000: "60.00s", 63_000_000_000: "1.1min", 69_000_000_000: "1.1min", 75_000_000_000: "1.3min"}
    df = spark.createDataFrame([(k,) for k in cases], "n bigint")
    got = {r.n: r.t for r in df.select("n", fmt_nanos(F.col("n")).alias("t")).collect()}

    def expected(n):                         # exact value of the double, nearest, ties upwards
        from decimal import ROUND_HALF_UP, Decimal
        x, step, unit = (n / 6e10, "0.1", "min") if n >= 6e10 else (n / 1e9, "0.01", "s")
        return str(Decimal(x).quantize(Decimal(step), ROUND_HALF_UP)) + unit

    assert got == {n: expected(n) for n in cases}
    assert got[1_005_000_000] == "1.00s" and got[1_125_000_000] == "1.13s"


@pytest.mark.parametrize("record,cells", [
    ('a,"b"x,c,d', ["a", "bx", "c", "d"]), ('a,"b" ,c', ["a", "b ", "c"]), ('1,x 5" disk,2', ["1", 'x 5" disk', "2"]),
    ('"say ""hi"", now",', ['say "hi", now', ""]), ('"open,b', ['"open', "b"]), ("", [""]),
])
def test_every_cell_is_kept(spark, record, cells):
    df = spark.createDataFrame([(record,)], "r string")
    assert df.select(cells_of(F.col("r"))).first()[0] == cells


def test_repeated_header_names_keep_their_cells(spark):
    got = read_csv_logs(inline(spark, "aa,bb,aa,\n1,2,3,4\n5,6,7,8,9\n"))
    rows = [json.loads(r[0]) for r in got.orderBy("line_no").select(F.to_json("fields")).collect()]
    assert rows[0] == {"aa": "1", "bb": "2", "col_3": "3", "col_4": "4"} and rows[1]["col_5"] == "9"


def test_a_trace_among_json_lines_leaves_the_file_json(spark):
    lines = [json.dumps({"level": "INFO", "n": i}) for i in range(20)]
    lines[7:7] = ["Traceback (most recent call last):", '  File "/srv/x.py", line 3, in f', "KeyError: 'k'"]
    p = parse_lines(inline(spark, "\n".join(lines)))
    assert p.formats.first()["format"] == "jsonl"
    assert p.records.filter("level = 'INFO'").count() == 20


def test_windows_1251_with_an_unassigned_byte(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("2031-02-03 04:05:06 ERROR Сбой".encode("cp1251") + b" \x98\n")
    p = parse_logs(spark, str(tmp_path / "a.log"), ParseOptions.of(encoding="auto"))
    assert "Сбой \x98" in p.lines.first()["raw_line"]


def test_every_file_asked_for_is_reported(spark, tmp_path):
    (tmp_path / "z.log").write_text("2031-02-03 04:05:06 INFO req_id=Q7 one\n")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "a.log").write_text("2031-02-03 04:05:06 ERROR req_id=Q7 two\n")
    gone = str(tmp_path / "gone.log")
    p = parse_logs(spark, [str(tmp_path / "z.log"), str(tmp_path / "empty.log"), gone, str(tmp_path / "a.log")])
    by = {r["file_id"].rsplit("/", 1)[1]: r for r in p.report.collect()}
    assert {n: r["status"] for n, r in by.items()} == {"z.log": "ok", "empty.log": "ok", "gone.log": "error", "a.log": "ok"}
    codes = {(r["file_id"].rsplit("/", 1)[1], r["code"]) for r in p.diagnostics.collect()}
    assert ("empty.log", "NO_RECORDS") in codes and ("gone.log", "PATH_NOT_FOUND") in codes
    found = trace.in_order(trace.trace(p.records, "Q7")).collect()
    assert [r["file_id"].rsplit("/", 1)[1] for r in found] == ["z.log", "a.log"]


def test_records_scan_their_input_a_few_times_only(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.writelines(json.dumps({"level": "INFO", "n": i % 90}) + "\n" for i in range(400))
    p = parse_logs(spark, str(tmp_path / "a.jsonl.gz"))
    plan = p.records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert p.records.count() == 90 and [r[0] for r in p.records.select("rec_no").orderBy("rec_no").collect()] == list(range(90))


def test_objects_of_one_line_keep_their_places(spark):
    text = '[{"a":1}, {"a":2}]\n{"a":3}'
    got = read_json_logs(inline(spark, text)).orderBy("line_no", "part").select("line_no", "part").collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 1), (1, 0)]


def test_many_anchors_of_one_request_give_one_trace(spark):
    r = spark.range(300).selectExpr("'f' AS file_id", "id AS rec_no", "IF(id < 200, 'Q', '') AS req_id")
    anchors = r.select("file_id", "rec_no")
    assert trace.trace_of(r, anchors).count() == 200 and trace.anchor_ids(r, anchors).count() == 200


def test_search_text():
    assert search.parse_query("Lvl:WARN src:Gate req_id:Q7 trace:z9 plain host:x lvl: two") == {
        "levels": ["warn"], "srcs": ["gate"], "reqs": ["q7", "z9"], "words": ["plain", "host:x", "lvl:", "two"]}
    assert search.parse_query(None) == {"levels": [], "srcs": [], "reqs": [], "words": []}


def test_line_breaks_in_sql_values_only(spark):
    line = r'{"SQL": "select\n\t1 \"x\"","msg":"a\nb","query_text":"p\\n"}'
    df = spark.createDataFrame([(line,)], "t string")
    got = df.select(rewrite.readable_sql(F.col("t"))).first()[0]
    assert got == '{"SQL": "select\n\t1 \\"x\\"","msg":"a\\nb","query_text":"p\\\\n"}'


def test_recovered_fields(spark):
    rows = ['{"a":1}', '{"a":"say "no"","b":2}', "[1]", "{", None, '{"in":"{\\"k\\":1}"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = {r.i: (r.partial, json.loads(r.j)) for r in recover_fields(df).select("i", "partial", F.to_json("fields").alias("j")).collect()}
    assert got == {0: (False, {"a": 1}), 1: (True, {"a": '"say "no""', "b": 2}), 5: (False, {"in": {"k": 1}})}


def test_window_of_a_capped_page(spark):
    r = spark.range(30).selectExpr("'f' AS file_id", "id AS rec_no")
    row = windows.page_window(windows.cap(r, 20), 15, 10, windows.cap_signal(r, 20)).first()
    assert (row["returned"], row["total_records"], row["has_more"], row["truncated"]) == (5, 20, False, True)


def test_bookmarked_records(spark):
    r = spark.range(5).selectExpr("'f' AS file_id", "id AS rec_no")
    marks = spark.createDataFrame([(1, "f", 3), (2, "f", 3), (3, "gone", 1)], "seq int, file_id string, rec_no bigint")
    assert [x["rec_no"] for x in trace.bookmarked(r, marks).collect()] == [3]


def test_hits_without_end_are_marked_in_one_pass(spark):
    df = spark.range(1).select(F.repeat(F.lit("ab x"), 100_000).alias("t"))
    parts = df.select(highlight(F.col("t"), ["AB", "b", "zz"]).alias("h")).first().h
    assert len(parts) == 200_000 and all(p.hit == (p.t == "ab") for p in parts)
    odd = spark.createDataFrame([("a\ue000b\U0001F600Ab",), ("",), ("aAa",)], "t string")
    got = [[tuple(p) for p in r.h] for r in odd.select(highlight(F.col("t"), ["ab", "\U0001F600", "aa"]).alias("h")).collect()]
    assert got == [[("a\ue000b", False), ("\U0001F600Ab", True)], [], [("aA", True), ("a", False)]]


def test_found_by_id_before_the_line_is_made(spark):
    lines = [f"2031-02-03 04:05:06 INFO gate req_id=K{i % 5} n{i}" for i in range(50)]
    records = parse_lines(inline(spark, "\n".join(lines)), ParseOptions(remove_duplicates=False)).records
    bare = records.select("file_id", "rec_no", "fields")
    got = search.find(bare, "line", reqs=["k3"], words=["N1"])
    assert sorted(r.rec_no for r in got.collect()) == [13, 18] and got.columns == ["file_id", "rec_no", "fields", "line"]
    found = trace.find_trace(bare, "K3", "line").collect()
    assert [r.rec_no for r in found] == list(range(3, 50, 5)) and "K3" in found[0].line


def test_sql_for_people(spark, tmp_path):
    rows = ['{"sql":"select 1,\\n\\t2","msg":"a\\nb"}', '{"QUERY":"x\\\\n","n":null}']
    df = spark.createDataFrame([("f", r) for r in rows], "file_id string, raw string").select("file_id", parse_object(F.col("raw")).alias("fields"))
    export(df.coalesce(1), str(tmp_path / "o"), readable=True)
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(str(tmp_path / "o/records")).collect())
    back = [x.replace("\n", "\\n").replace("\t", "\\t") for x in text.strip().split("\n{")]
    assert [json.loads(x if x.startswith("{") else "{" + x) for x in back] == [json.loads(r) for r in rows]
    assert "select 1,\n\t2" in text and "a\\nb" in text
