"""Queries over damaged, mixed, packed and two-byte logs, composed from whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.operators.materialize import shared_folder
from loglathe.operators.multiline import assemble_multiline
from loglathe.options import ParseOptions
from loglathe.plans import ducksql as d
from loglathe.plans import views
from loglathe.plans.catalog import query
from loglathe.plans.parse import parse_lines, parse_logs
from loglathe.plans.record_queries import FILE3, STRIDE, event_lines
from loglathe.sources.csv import read_csv_logs
from loglathe.sources.json import read_json_logs
from loglathe.sources.lines import listed, read_files

# A quote amid a cell, cells over two lines, and a quote that is never closed (every fiftieth row).
STRAY_TEXT = (
    "CASE WHEN event_id < 3 THEN 'id,env,note' || chr(10) ELSE '' END || "
    f"{views.EVENT} || CASE WHEN event_id % 50 = 11 THEN ',\"' || event_type || ',lost' "
    "WHEN event_id % 7 = 3 THEN ',' || event_type || ',x 5\" disk' "
    "WHEN event_id % 7 = 5 THEN ',' || event_type || ',\"a, \"\"b\"\"' || chr(10) || '(c)\"' "
    "ELSE ',' || event_type || ',plain' END"
)


@query("scan_csv_stray_quote", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id,
  CASE WHEN event_id % 50 = 11 THEN '"' ELSE '' END || event_type AS env,
  CASE WHEN event_id % 50 = 11 THEN 'lost' WHEN event_id % 7 = 3 THEN 'x 5" disk'
       WHEN event_id % 7 = 5 THEN 'a, "b"' || chr(10) || '(c)' ELSE 'plain' END AS note
FROM events""")
def scan_csv_stray_quote(spark, sf):
    f = F.col("fields")
    return read_csv_logs(event_lines(spark, sf, STRAY_TEXT)).select(
        "file_id", f["id"].cast("bigint").alias("event_id"), f["env"].cast("string").alias("env"), f["note"].cast("string").alias("note"))


# Objects over several lines; some lack their last brace, some have one too many.
def _spread(last: str) -> str:
    return (f"'{{' || chr(10) || ' \"event\": ' || {views.EVENT} || ',' || chr(10) || ' \"in\": {{\"t\": \"}}{{\",' || chr(10) || "
            f"'  \"a\": [{{' || chr(10) || '   \"u\": ' || {views.USER} || '}}]}}' || {last}").replace("{{", "{").replace("}}", "}")


DAMAGED_TEXT = _spread(
    "CASE WHEN event_id % 40 = 20 THEN '' WHEN event_id % 40 = 8 THEN chr(10) || '}' || chr(10) || '}' ELSE chr(10) || '}' END")


@query("scan_json_damaged", f"""
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, CASE WHEN event_id % 40 <> 20 THEN event_id END AS event_id,
  CASE WHEN event_id % 40 <> 20 THEN user_id END AS user_id, CASE WHEN event_id % 40 = 20 THEN {_spread("''")} END AS message
FROM events
UNION ALL SELECT 'f' || CAST(event_id % 3 AS VARCHAR), NULL, NULL, '}}' FROM events WHERE event_id % 40 = 8""")
def scan_json_damaged(spark, sf):
    f = F.col("fields")
    return read_json_logs(event_lines(spark, sf, DAMAGED_TEXT)).select(
        "file_id", f["event"].cast("bigint").alias("event_id"), F.try_variant_get(f["in"], "$.a[0].u", "bigint").alias("user_id"),
        f["message"].cast("string").alias("message"))


# Every file has traces, JSON lines and plain lines.
ANY_TEXT = (f"CASE event_id @div@ 3 % 3 WHEN 0 THEN {views.TRACE_TEXT['text']} WHEN 1 THEN {views.JSON['raw']} "
            f"ELSE {views.TEXT['raw']} END")


@query("detect_mixed", d.select(views.duck_view("c", {
    "file_id": f"'f' || {FILE3}", "event_id": "event_id", "event_type": "event_type", "raw": ANY_TEXT}), """
SELECT file_id, event_id, raw, CASE WHEN event_id // 3 % 3 = 1 THEN 'json'
  WHEN event_id // 3 % 3 = 0 AND event_type IN ('error', 'purchase', 'signup') THEN 'trace' ELSE 'text' END AS what FROM c"""))
def detect_mixed(spark, sf):
    records = parse_lines(event_lines(spark, sf, ANY_TEXT), ParseOptions(remove_duplicates=False)).records
    f = F.col("fields")
    what = F.when(f["traceback"].isNotNull(), "trace").when(f["event"].isNotNull(), "json").otherwise("text")
    return records.select("file_id", F.expr(f"line_no div {STRIDE}").alias("event_id"), "raw", what.alias("what"))


@query("mline_long", d.select(views.duck_view("c", {
    "file_id": f"'f' || {FILE3}", "event_id": "event_id", "event_type": "event_type", "text": views.TRACE_TEXT["text"]}), """, cut AS (
  SELECT *, string_split(text, chr(10)) AS lines FROM c)
SELECT file_id, event_id, CAST(part AS INTEGER) AS cont, array_to_string(lines[part * 3 + 1:part * 3 + 3], chr(10)) AS raw,
  CASE event_type WHEN 'error' THEN 'python_traceback' WHEN 'purchase' THEN 'go_panic' WHEN 'signup' THEN 'exception_group' ELSE 'text' END AS kind
FROM cut, range(0, 3) AS r(part) WHERE part * 3 < len(lines)"""))
def mline_long(spark, sf):
    """Records of more than three lines go on in further rows here."""
    found = assemble_multiline(event_lines(spark, sf, views.TRACE_TEXT["text"]), max_lines=3)
    return found.select("file_id", F.expr(f"line_no div {STRIDE}").alias("event_id"), "cont", "raw", "kind")


# --- files -------------------------------------------------------------------------------
def _written(spark, sf, name: str) -> tuple[DataFrame, str]:
    """The text log and a new folder in the shared one for files of it."""
    logs = views.spark_view(spark, sf, {"file": f"'f' || {FILE3}", "raw": views.TEXT["raw"]})
    return logs, f"{shared_folder(spark)}/loglathe/{name}-{uuid.uuid4().hex}"


def _file(column: str = "file_id"):
    return F.regexp_extract(column, r"file=(f\d)", 1)


@query("parse_failures", d.select(d.TEXT, """
SELECT file_id AS file, CASE file_id WHEN 'f2' THEN 'error' ELSE 'ok' END AS status,
  CASE file_id WHEN 'f2' THEN 'DAMAGED_FILE' ELSE '' END AS code,
  CAST(CASE file_id WHEN 'f2' THEN 0 ELSE count(*) END AS BIGINT) AS total_lines FROM log_text GROUP BY file_id
UNION ALL SELECT 'gone', 'error', 'PATH_NOT_FOUND', CAST(0 AS BIGINT)"""))
def parse_failures(spark, sf):
    """Packed files, some of which are not what their names say, and one that isn't there."""
    logs, folder = _written(spark, sf, "packed")
    logs.where("file <> 'f2'").write.partitionBy("file").option("compression", "gzip").text(f"{folder}/good")
    logs.where("file = 'f2'").write.partitionBy("file").text(f"{folder}/bad")
    run = parse_logs(
        spark, [f"{folder}/good", f"{folder}/bad", f"{folder}/gone"], ParseOptions(remove_duplicates=False),
        codecs={".gz": "gzip", ".txt": "gzip"})
    name = F.when(F.endswith("file_id", F.lit("/gone")), "gone").otherwise(_file())
    code = F.coalesce(F.regexp_extract("error", r"^(\w+)", 1), F.lit(""))
    return run.report.groupBy(name.alias("file"), "status", code.alias("code")).agg(F.sum("total_lines").alias("total_lines"))


#: Characters of which halves of neighbours look like a line break in one of the two byte orders.
LOOKALIKE = "chr(266) || chr(2570) || chr(256) || chr(2565)"


@query("decode_wide", d.select(d.TEXT, f"""
SELECT file_id AS file, raw || ' ' || {LOOKALIKE} AS line,
  CASE file_id WHEN 'f0' THEN 'utf-16-le' WHEN 'f1' THEN 'utf-16-be' ELSE 'utf-8' END AS encoding FROM log_text"""))
def decode_wide(spark, sf):
    """Files of both byte orders, without a mark, next to files of UTF-8."""
    logs, folder = _written(spark, sf, "wide")
    lines = logs.withColumn("raw", F.concat("raw", F.lit(" " + "".join(map(chr, (266, 2570, 256, 2565))))))
    for file, order, separator in (("f0", "UTF-16LE", "\n\0"), ("f1", "UTF-16BE", "\0\n"), ("f2", "UTF-8", "\n")):
        lines.where(F.col("file") == file).select("file", F.encode("raw", order).cast("string").alias("raw")).write.partitionBy(
            "file").mode("append").option("lineSep", separator).text(folder)
    found, _ = read_files(spark, listed(spark, folder))
    return found.select(_file().alias("file"), F.col("raw_line").alias("line"), "encoding")
