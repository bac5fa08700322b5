"""Queries for sources, assembly, rewrites, reports and export.

Their inputs are composed from whole tables by the same SQL in both engines, so the answer
is known by construction and the oracle states it directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.functions import axes as ax
from loglathe.functions import recover
from loglathe.functions.axes import with_axes
from loglathe.functions.fields import parse_object, text
from loglathe.functions.highlight import highlight
from loglathe.operators import counts, rewrite, search
from loglathe.operators.multiline import assemble_multiline, trace_columns, trace_to_record
from loglathe.operators.normalize import normalize_export
from loglathe.operators.ordered import with_rec_no
from loglathe.operators.report import diagnostics, full_report
from loglathe.operators.windows import cap, cap_signal
from loglathe.options import ParseOptions
from loglathe.plans import ducksql as d
from loglathe.plans import views
from loglathe.plans.catalog import query
from loglathe.plans.parse import parse_lines
from loglathe.plans.queries import VIEW_SQL, all_axes, all_logs, json_logs, text_logs
from loglathe.sources.csv import read_csv_logs
from loglathe.sources.detect import detect_format
from loglathe.sources.json import read_json_logs
from loglathe.sources.lines import decode_lines, split_texts, without_blank
from loglathe.sources.session import session, session_overview

FILE3 = "CAST(event_id % 3 AS STRING)"


def composed(spark, sf, text_sql: str, **more: str) -> DataFrame:
    view = {"event_id": "event_id", "file_id": f"'f' || {FILE3}", "rec_no": "event_id @div@ 3", **more}
    return views.spark_view(spark, sf, {**view, "raw": text_sql})


def duck(text_sql: str) -> str:
    return views.duck_view("composed", {
        "event_id": "event_id", "file_id": f"'f' || {FILE3}", "rec_no": "event_id @div@ 3",
        "event_type": "event_type", "user_id": "user_id", "raw": text_sql,
    })


def with_fields(spark, sf, text_sql: str) -> DataFrame:
    return composed(spark, sf, text_sql).select(
        "file_id", "rec_no", parse_object(F.col("raw")).alias("fields")
    )


def unpivot(records: DataFrame, *keep: str) -> DataFrame:
    """One row per field: the value as text and whether it is a string."""
    return records.select(
        *(keep or ("file_id", "rec_no")), F.explode_outer("fields").alias("key", "_v")
    ).select(
        *(keep or ("file_id", "rec_no")), "key", text(F.col("_v")).alias("value"),
    )


STRIDE = 16  # no composed text has more lines


def event_lines(spark, sf, text_sql: str) -> DataFrame:
    """Composed texts as the lines of their files; ``line_no div STRIDE`` is the event."""
    return split_texts(
        composed(spark, sf, text_sql), "raw", F.col("file_id"), F.col("event_id"), STRIDE
    )


# --- sources -------------------------------------------------------------------
@query("scan_lines", """
WITH pieces AS (
  SELECT source AS file_id, doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS raw_line,
         generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), 1) AS pos FROM documents)
SELECT file_id, line_no, raw_line FROM (
  SELECT file_id, raw_line, row_number() OVER (PARTITION BY file_id ORDER BY doc_id, pos) - 1 AS line_no FROM pieces)
WHERE NOT regexp_matches(raw_line, '^\\s*$')""")
def scan_lines(spark, sf):
    docs = views.spread(views.table(spark, sf, "documents").select("doc_id", "source", "text"))
    lines = split_texts(docs, "text", F.col("source"), F.col("doc_id"))
    # 1024 documents to a chunk.
    numbered = with_rec_no(lines, "file_id", "line_no", "_dense", 1024 << 20).select(
        "file_id", F.col("_dense").alias("line_no"), "raw_line"
    )
    return without_blank(numbered)


# File f0 has one object per line, f1 spreads each object over lines of one array, f2 has
# several objects of an array on each line.
OBJECT = f"'\"event\":' || {views.EVENT} || ',\"tag\":\"}}, {{\",\"in\":[{{\"a\":1}},{{\"a\":' || {views.USER} || '}}]'"
JSON_TEXT = (
    f"CASE event_id % 3 WHEN 0 THEN '{{' || {OBJECT} || '}}' "
    f"WHEN 1 THEN CASE WHEN event_id = 1 THEN '[' || chr(10) ELSE '' END || '{{' || chr(10) || {OBJECT} || chr(10) || '}},' "
    f"ELSE '[{{' || {OBJECT} || '}}, {{\"copy\":' || {views.EVENT} || '}}],' END"
)


@query("scan_json", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, 'event' AS k, event_id AS v, user_id AS a FROM events
UNION ALL
SELECT 'f2', 'copy', event_id, NULL FROM events WHERE event_id % 3 = 2""")
def scan_json(spark, sf):
    found = read_json_logs(event_lines(spark, sf, JSON_TEXT))
    f = F.col("fields")
    return found.select(
        "file_id", F.when(f["event"].isNotNull(), "event").otherwise("copy").alias("k"),
        F.coalesce(f["event"], f["copy"]).cast("bigint").alias("v"),
        F.try_variant_get(f["in"], "$[1].a", "bigint").alias("a"),
    )


CSV_TEXT = (
    "CASE WHEN event_id < 3 THEN '\"@timestamp\",env,message' || chr(10) ELSE '' END || "
    "@ts@ || ',' || event_type || ',\"{\"\"level\"\": \"\"WARNING\"\", \"\"u\"\": ' || "
    f"{views.USER} || ', \"\"message\"\": \"\"a, b' || chr(10) || '(c)\"\"}}\"' || "
    "CASE WHEN event_id % 5 = 0 THEN ',over' ELSE '' END"
)


@query("scan_csv", d.select(views.duck_view("c", {
    "file_id": f"'f' || {FILE3}", "rec_no": "event_id @div@ 3", "stamp": "@ts@", "event_id": "event_id",
    "event_type": "event_type", "u": views.USER}), """
SELECT file_id, rec_no, '@timestamp' AS key, stamp AS value FROM c
UNION ALL SELECT file_id, rec_no, 'env', event_type FROM c
UNION ALL SELECT file_id, rec_no, 'message', '{"level": "WARNING", "u": ' || u || ', "message": "a, b' || chr(10) || '(c)"}' FROM c
UNION ALL SELECT file_id, rec_no, 'col_4', 'over' FROM c WHERE event_id % 5 = 0"""))
def scan_csv(spark, sf):
    records = read_csv_logs(event_lines(spark, sf, CSV_TEXT.replace("}}", "}")))
    # The header takes a line number of its own, so a record's event gives its row.
    return unpivot(records.withColumn("rec_no", F.expr(f"line_no div {STRIDE} div 3")))


@query("session_union", d.select(f"{d.TEXT}, {d.JSON}", """
SELECT 0 AS file_ord, 'text' AS session_name, file_id, rec_no, raw FROM log_text
UNION ALL SELECT 1, 'json', file_id, rec_no, raw FROM log_json"""))
def session_union(spark, sf):
    return session({"text": text_logs(spark, sf), "json": json_logs(spark, sf)}).select(
        "file_ord", "session_name", "file_id", "rec_no", "raw"
    )


# f0 is UTF-8, f1 windows-1251, f2 KOI8-R with a byte that windows-1251 does not have.
BYTES = (
    "CASE event_id % 3 WHEN 0 THEN concat(cast(cast(event_id AS STRING) AS BINARY), X'20D09ED188') "
    "WHEN 1 THEN concat(cast(cast(event_id AS STRING) AS BINARY), X'20CEF8') "
    "ELSE concat(cast(cast(event_id AS STRING) AS BINARY), X'20EFDB98') END"
)


@query("decode", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id,
       CAST(event_id AS VARCHAR) || CASE event_id % 3 WHEN 2 THEN ' Ош≤' ELSE ' Ош' END AS line,
       CASE event_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'cp1251' ELSE 'koi8-r' END AS encoding,
       event_id % 3 > 0 AS fallback
FROM events""")
def decode(spark, sf):
    raw = views.table(spark, sf, "events").selectExpr(
        f"concat('f', {FILE3}) AS file_id", f"cast({BYTES} AS STRING) AS raw_line"
    )
    return decode_lines(raw).select("file_id", F.col("raw_line").alias("line"), "encoding", "fallback")


MIXED_TEXT = f"CASE event_id % 3 WHEN 0 THEN {views.TRACE_TEXT['text']} WHEN 1 THEN {views.JSON['raw']} ELSE {CSV_TEXT.replace('}}', '}')} END"


@query("detect_format", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id,
       CASE event_id % 3 WHEN 0 THEN 'exception_group' WHEN 1 THEN 'jsonl' ELSE 'csv' END AS format
FROM events GROUP BY event_id % 3""")
def detect(spark, sf):
    return detect_format(event_lines(spark, sf, MIXED_TEXT)).select("file_id", "format")


# --- assembly --------------------------------------------------------------------
def traces(spark, sf) -> DataFrame:
    lines = event_lines(spark, sf, views.TRACE_TEXT["text"])
    return assemble_multiline(lines).withColumn("event_id", F.expr(f"line_no div {STRIDE}"))


@query("mline_python", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id, 'ERROR' AS level,
       'app.errors.BadValue' AS type, 'value ' || CAST(user_id AS VARCHAR) || ' is bad' AS message,
       'PUT' AS method, '/api/v' || CAST(user_id AS VARCHAR) AS url, 2 AS n_frames,
       '/opt/app/main.py:' || CAST(event_id AS VARCHAR) || ' handle' AS first_frame
FROM events WHERE event_type = 'error'""")
def mline_python(spark, sf):
    first = F.get(F.col("frames"), F.lit(0))
    return trace_columns(traces(spark, sf)).filter("kind = 'python_traceback'").select(
        "file_id", "event_id", "level", "type", "message", "method", "url",
        F.size("frames").alias("n_frames"),
        F.concat(first["file"], F.lit(":"), first["line"].cast("string"), F.lit(" "), first["function"])
        .alias("first_frame"),
    )


@query("mline_go", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id, 'FATAL' AS level, 'panic' AS type,
       'runtime error: index ' || CAST(user_id AS VARCHAR) AS message, event_id AS goroutine
FROM events WHERE event_type = 'purchase'""")
def mline_go(spark, sf):
    return trace_columns(traces(spark, sf)).filter("kind = 'go_panic'").select(
        "file_id", "event_id", "level", "type", "message", "goroutine"
    )


@query("mline_group", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id, 'ExceptionGroup' AS type,
       'unhandled errors (2 sub-exceptions)' AS message,
       'PermissionError=denied for u' || CAST(user_id AS VARCHAR) || ';KeyError=k' || CAST(event_id AS VARCHAR) AS subs
FROM events WHERE event_type = 'signup'""")
def mline_group(spark, sf):
    subs = F.transform("sub_exceptions", lambda s: F.concat(s["type"], F.lit("="), s["message"]))
    return trace_columns(traces(spark, sf)).filter("kind = 'exception_group'").select(
        "file_id", "event_id", "type", "message", F.array_join(subs, ";").alias("subs")
    )


@query("mline_all", d.select(d.TRACE, """
SELECT file_id, event_id, text AS raw FROM trace_text"""))
def mline_all(spark, sf):
    return traces(spark, sf).select("file_id", "event_id", "raw")


@query("text_record", d.select(d.TEXT, """
SELECT file_id, rec_no, 'raw' AS key, raw AS value FROM log_text
UNION ALL SELECT file_id, rec_no, 'timestamp_iso', substr(raw, 1, 19) FROM log_text"""))
def text_records(spark, sf):
    return unpivot(text_logs(spark, sf))


@query("frames", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id, idx,
  CASE idx WHEN 0 THEN CASE event_type WHEN 'error' THEN '/opt/app/main.py:' || CAST(event_id AS VARCHAR) ELSE '/opt/core/engine.py:54' END
    ELSE '/opt/app/run.py:7' END AS location,
  CASE WHEN event_type = 'signup' THEN 'start' WHEN idx = 0 THEN 'handle' ELSE 'run' END AS function
FROM events, (VALUES (0), (1)) AS i(idx)
WHERE event_type = 'error' OR (event_type = 'signup' AND idx = 0)""")
def frames(spark, sf):
    return rewrite.frames(trace_to_record(traces(spark, sf)).select("file_id", "event_id", "fields"))


@query("exc_type", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id,
  CASE event_type WHEN 'error' THEN 'BadValue' WHEN 'purchase' THEN 'panic' WHEN 'signup' THEN 'ExceptionGroup' ELSE '' END AS exc,
  CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS n_frames,
  event_type IN ('error', 'purchase', 'signup') AS traced
FROM events""")
def exc_type(spark, sf):
    f = F.col("fields")
    return trace_to_record(traces(spark, sf)).select(
        "file_id", "event_id", ax.exc_type(f).alias("exc"), ax.frame_count(f).alias("n_frames"),
        (ax.trace_text(f) != "").alias("traced"),
    )


# --- rewrites ----------------------------------------------------------------------
ANSI_TEXT = "chr(27) || '[1;31m' || event_type || chr(27) || '[0m ' || chr(27) || '[2K' || props"


@query("strip_ansi", "SELECT event_id, event_type || ' ' || props AS clean FROM events")
def strip_ansi(spark, sf):
    return composed(spark, sf, ANSI_TEXT).select("event_id", rewrite.strip_ansi(F.col("raw")).alias("clean"))


Q = "chr(92) || '\"'"  # an escaped quote inside a JSON string
MESSAGE_TEXT = (
    "CASE WHEN event_id % 2 = 0 THEN '{\"env\":\"prod\",\"x\":\"outer\",\"message\":\"{' || "
    f"{Q} || 'level' || {Q} || ':' || {Q} || 'INFO' || {Q} || ',' || {Q} || 'x' || {Q} || ':1,' || "
    f"{Q} || 'status' || {Q} || ':200,' || {Q} || 'message' || {Q} || ':' || {Q} || 'hi ' || {views.EVENT} || {Q} || '}}\"}}' "
    f"ELSE '{{\"env\":\"prod\",\"message\":\"plain {{' || {views.EVENT} || '\"}}' END"
).replace("}}", "}").replace("{{", "{")


@query("expand_message", d.select(duck(MESSAGE_TEXT), """
SELECT file_id, rec_no, 'env' AS key, 'prod' AS value FROM composed
UNION ALL SELECT file_id, rec_no, k, v FROM composed, (VALUES ('x', 'outer'), ('level', 'INFO'), ('status', '200')) AS t(k, v)
  WHERE event_id % 2 = 0
UNION ALL SELECT file_id, rec_no, 'message',
  CASE WHEN event_id % 2 = 0 THEN 'hi ' || CAST(event_id AS VARCHAR) ELSE 'plain {' || CAST(event_id AS VARCHAR) END FROM composed"""))
def expand_message(spark, sf):
    return unpivot(rewrite.expand_message(with_fields(spark, sf, MESSAGE_TEXT)))


META_TEXT = (
    "CASE event_id % 4 "
    "WHEN 0 THEN '{\"sql\":\"top\",\"_meta.event_original.sql\":\"low\",\"_meta.event_original.u\":' || "
    f"{views.USER} || ',\"_meta.u\":\"weak\",\"_meta.id\":\"doc\",\"_meta.z\":2,\"_meta.event_original\":\"whole\",\"@timestamp\":\"t0\",\"@version\":1,\"@other\":2}}' "
    "WHEN 1 THEN '{\"a\":1,\"_meta\":{\"event_original\":{\"k\":\"deep\",\"a\":9},\"id\":3,\"w\":' || "
    f"{views.EVENT} || ',\"k\":\"shallow\"}},\"timestamp\":\"mine\",\"@timestamp\":\"theirs\"}}' "
    "WHEN 2 THEN '{\"_meta\":{\"event_original\":\"text\",\"tags\":1},\"b\":true}' "
    f"ELSE '{{\"plain\":' || {views.EVENT} || ',\"id\":\"kept\"}}' END"
).replace("}}", "}").replace("{{", "{")


@query("normalize_meta", d.select(duck(META_TEXT), """
SELECT file_id, rec_no, k AS key, v AS value FROM composed, (VALUES
  (0, 'sql', 'top'), (0, 'z', '2'), (0, 'timestamp', 't0'),
  (1, 'a', '1'), (1, 'k', 'deep'), (1, 'timestamp', 'mine'),
  (2, 'event_original', 'text'), (2, 'b', 'true'), (3, 'id', 'kept')) AS t(m, k, v) WHERE event_id % 4 = m
UNION ALL SELECT file_id, rec_no, 'u', CAST(user_id AS VARCHAR) FROM composed WHERE event_id % 4 = 0
UNION ALL SELECT file_id, rec_no, 'w', CAST(event_id AS VARCHAR) FROM composed WHERE event_id % 4 = 1
UNION ALL SELECT file_id, rec_no, 'plain', CAST(event_id AS VARCHAR) FROM composed WHERE event_id % 4 = 3"""))
def normalize_meta(spark, sf):
    return unpivot(normalize_export(with_fields(spark, sf, META_TEXT)))


K8S_TEXT = (
    "CASE WHEN event_id % 2 = 0 THEN '{\"msg\":\"m\",\"kubernetes_pod_name\":\"pod' || "
    f"{views.USER} || '\",\"container_name\":\"c\",\"_meta\":{{\"old\":1}}}}' "
    f"ELSE '{{\"msg\":\"n' || {views.USER} || '\"}}' END"
)


@query("strip_k8s", d.select(duck(K8S_TEXT), """
SELECT file_id, rec_no, 'msg' AS key, CASE WHEN event_id % 2 = 0 THEN 'm' ELSE 'n' || CAST(user_id AS VARCHAR) END AS value FROM composed
UNION ALL SELECT file_id, rec_no, '_meta', '{"container_name":"c","kubernetes_pod_name":"pod' || CAST(user_id AS VARCHAR) || '","old":1}'
FROM composed WHERE event_id % 2 = 0"""))
def strip_k8s(spark, sf):
    return unpivot(rewrite.strip_k8s(with_fields(spark, sf, K8S_TEXT)))


SQL_TEXT = (
    f"'{{\"sql\":\"select $1, $2 from t where a = $10 or b = $' || CAST(event_id % 3 + 1 AS STRING) || "
    f"'\",\"args\":[\"it''s $2\",' || {views.USER} || ',null]}}'"
).replace("}}", "}").replace("{{", "{")


@query("bind_sql", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id // 3 AS rec_no,
  'select ''it''''s $2'', ' || CAST(user_id AS VARCHAR) || ' from t where a = $10 or b = ' ||
  CASE event_id % 3 WHEN 0 THEN '''it''''s $2''' WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE 'NULL' END AS bound
FROM events""")
def bind_sql(spark, sf):
    # Spark takes '' inside a literal as two adjacent literals; say the quote by its code.
    sql = SQL_TEXT.replace("it''s", "it' || chr(39) || 's")
    return rewrite.bind_sql(with_fields(spark, sf, sql)).select(
        "file_id", "rec_no", text(F.col("fields")["sql"]).alias("bound")
    )


NESTED_TEXT = (
    f"'{{\"a\":{{\"b\":{{\"c\":' || {views.USER} || '}},\"d\":[1,2]}},\"a.d\":\"later\",\"e\":' || props || ',\"f\":null}}'"
).replace("}}", "}").replace("{{", "{")


@query("flatten", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id // 3 AS rec_no, k AS key,
  CASE k WHEN 'a.b.c' THEN CAST(user_id AS VARCHAR) WHEN 'a.d' THEN 'later' WHEN 'e.k' THEN json_extract_string(props, '$.k') END AS value
FROM events, (VALUES ('a.b.c'), ('a.d'), ('e.k'), ('f')) AS t(k)""")
def flatten(spark, sf):
    return unpivot(rewrite.flatten(with_fields(spark, sf, NESTED_TEXT)))


BROKEN_TEXT = (
    "CASE event_id % 4 WHEN 0 THEN '{\"msg\":\"say \"hi\" now\",\"n\":' || "
    f"{views.USER} || ',\"o\":{{\"k\":1}},\"z\":true}}' "
    f"WHEN 1 THEN '{{\"n\":' || {views.USER} || '}}' WHEN 2 THEN '[broken \":' ELSE 'plain text' END"
).replace("}}", "}").replace("{{", "{")


@query("recover_fields", d.select(duck(BROKEN_TEXT), """
SELECT file_id, rec_no, event_id % 4 = 0 AS partial, k AS key,
  CASE k WHEN 'msg' THEN '"say "hi" now"' WHEN 'n' THEN CAST(user_id AS VARCHAR) WHEN 'o' THEN '{"k":1}' ELSE 'true' END AS value
FROM composed, (VALUES (0, 'msg'), (0, 'n'), (0, 'o'), (0, 'z'), (1, 'n')) AS t(m, k) WHERE event_id % 4 = m"""))
def recover_fields(spark, sf):
    found = recover.recover_fields(composed(spark, sf, BROKEN_TEXT))
    return unpivot(found.select("file_id", "rec_no", "partial", "fields"), "file_id", "rec_no", "partial")


BACK = "chr(92)"


@query("unescape_sql", f"""
SELECT event_id, 'SELECT' || chr(10) || CAST(user_id AS VARCHAR) || chr(9) || {BACK} || {BACK} || 'n' || {BACK} || '"x' AS sql_text
FROM events""")
def unescape_sql(spark, sf):
    sql = f"'SELECT' || {BACK} || 'n' || {views.USER} || {BACK} || 't' || {BACK} || {BACK} || 'n' || {BACK} || '\"x'"
    return composed(spark, sf, sql).select("event_id", rewrite.unescape_sql(F.col("raw")).alias("sql_text"))


NET_TEXT = (
    "CASE event_id % 4 WHEN 0 THEN '{\"error_addr\":\"10.0.0.1\",\"error_port\":' || "
    f"{views.USER} || ',\"error_type\":\"time_out\"}}' WHEN 1 THEN '{{\"error_type\":\"conn_reset_by_peer\",\"rpc_code\":14}}' "
    "WHEN 2 THEN '{{\"error_addr\":\"db\",\"rpc_code\":\"Unavailable\"}}' ELSE '{{\"rpc_code\":0}}' END"
).replace("}}", "}").replace("{{", "{")


@query("net_error", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id // 3 AS rec_no,
  CASE event_id % 4 WHEN 0 THEN '10.0.0.1' || CASE WHEN user_id = 0 THEN '' ELSE ':' || CAST(user_id AS VARCHAR) END
  WHEN 1 THEN 'conn reset by peer · rpc:14' WHEN 2 THEN 'db · rpc:Unavailable' ELSE '' END AS net
FROM events""")
def net_error(spark, sf):
    return with_fields(spark, sf, NET_TEXT).select(
        "file_id", "rec_no", ax.net_error(F.col("fields")).alias("net")
    )


@query("highlight", d.select(d.TEXT, """, marked AS (
  SELECT file_id, rec_no, raw, p AS pos, lower(raw) AS low FROM log_text, range(1, 200) AS r(p) WHERE p <= length(raw)),
hits AS (SELECT file_id, rec_no, pos, substr(raw, pos, 1) AS c,
  substr(low, pos, 3) = 'err' OR substr(low, pos - 1, 3) = 'err' AND pos > 1 OR substr(low, pos - 2, 3) = 'err' AND pos > 2
  OR substr(low, pos, 4) = 'rror' OR substr(low, pos - 1, 4) = 'rror' AND pos > 1 OR substr(low, pos - 2, 4) = 'rror' AND pos > 2
  OR substr(low, pos - 3, 4) = 'rror' AND pos > 3 AS hit FROM marked),
edges AS (SELECT *, CASE WHEN lag(hit) OVER w IS DISTINCT FROM hit THEN 1 ELSE 0 END AS edge FROM hits
  WINDOW w AS (PARTITION BY file_id, rec_no ORDER BY pos)),
runs AS (SELECT *, sum(edge) OVER (PARTITION BY file_id, rec_no ORDER BY pos) - 1 AS seg FROM edges)
SELECT file_id, rec_no, CAST(seg AS INT) AS seg, string_agg(c, '' ORDER BY pos) AS t, any_value(hit) AS hit
FROM runs GROUP BY file_id, rec_no, seg"""))
def highlighted(spark, sf):
    return text_logs(spark, sf).select(
        "file_id", "rec_no", F.posexplode(highlight(F.col("raw"), ["Err", "rror"])).alias("seg", "_s")
    ).select("file_id", "rec_no", "seg", "_s.t", "_s.hit")


# --- reports and export ---------------------------------------------------------------
PAYLOAD_TEXT = (
    "CASE event_id % 5 WHEN 0 THEN '{\"a\":' || props || '}' WHEN 1 THEN '{\"a\":\"x\"y\",\"b\":1}' "
    "WHEN 2 THEN '[note] plain' WHEN 3 THEN '  [\"a\",\"b\"' ELSE event_type END"
)


def payload_records(spark, sf) -> DataFrame:
    return composed(spark, sf, PAYLOAD_TEXT).select(
        "file_id", "rec_no",
        F.create_map(F.lit("payload"), F.col("raw").cast("variant")).alias("fields"),
    )


@query("unexpanded", d.select(duck(PAYLOAD_TEXT), """
SELECT file_id, count(*) AS unexpanded FROM composed
WHERE substr(ltrim(raw), 1, 1) IN ('{', '[') AND NOT json_valid(ltrim(raw))
  AND (contains(raw, '":') OR contains(raw, '","')) GROUP BY file_id"""))
def unexpanded(spark, sf):
    return counts.unexpanded_count(payload_records(spark, sf))


@query("session_overview", d.select(d.ALL_AXES, """
SELECT file_id, file_id || '.log' AS file_name, sum(octet_length(encode(raw)) + 1)::BIGINT AS file_size,
  CASE WHEN file_id LIKE 'j%' THEN 'jsonl' ELSE 'text' END AS format,
  count(*) FILTER (WHERE level IN ('ERROR','FATAL','CRITICAL')) AS errors, 'parsed' AS status
FROM (SELECT file_id, rec_no, raw FROM log_text UNION ALL SELECT file_id, rec_no, raw FROM log_json)
JOIN (SELECT file_id, rec_no, level FROM axes) USING (file_id, rec_no) GROUP BY file_id
UNION ALL SELECT 'gone', 'gone.log', CAST(0 AS BIGINT), NULL, CAST(0 AS BIGINT), 'error' """))
def overview(spark, sf):
    # lines without the axes, which three looks at the lines would compute again
    lines = all_logs(spark, sf).select("file_id", F.col("rec_no").alias("line_no"), F.col("raw").alias("raw_line"))
    logs = all_axes(spark, sf, "level").select("file_id", "rec_no", "level")
    files = lines.groupBy("file_id").agg(
        F.sum(F.octet_length("raw_line") + 1).cast("bigint").alias("file_size")
    ).unionByName(spark.createDataFrame([("gone", 0)], "file_id string, file_size bigint")).withColumn(
        "file_name", F.concat("file_id", F.lit(".log"))
    ).join(detect_format(lines), "file_id", "left")
    return session_overview(files, counts.run_report(lines, logs))


@query("diagnostics", d.select(d.TEXT_ONLY + ", " + duck(PAYLOAD_TEXT), """, n AS (
  SELECT file_id, count(*) AS total FROM axes GROUP BY file_id),
broken AS (SELECT file_id, count(*) AS bad FROM composed
  WHERE substr(ltrim(raw), 1, 1) IN ('{', '[') AND NOT json_valid(ltrim(raw))
    AND (contains(raw, '":') OR contains(raw, '","')) GROUP BY file_id)
SELECT file_id, 0 AS seq, 'info' AS severity, 'FORMAT_DETECTED' AS code, 'text' AS detail FROM n
UNION ALL SELECT file_id, 1, 'warn', 'TRUNCATED', '1000 of ' || CAST(total AS VARCHAR) FROM n WHERE total > 1000
UNION ALL SELECT file_id, CASE WHEN total > 1000 THEN 2 ELSE 1 END, 'warn', 'PARTIAL_EXPAND', CAST(bad AS VARCHAR)
FROM n JOIN broken USING (file_id)
UNION ALL SELECT 'gone', 0, 'error', 'FileNotFound', 'input could not be read or parsed'"""))
def diagnosed(spark, sf):
    plain = text_logs(spark, sf)
    lines = plain.select("file_id", F.col("rec_no").alias("line_no"), F.col("raw").alias("raw_line"))
    logs = with_axes(plain, "level").select("file_id", "rec_no", "level")
    failed = spark.createDataFrame([("gone", "FileNotFound")], "file_id string, error string")
    report = full_report(
        counts.run_report(lines, cap(logs, 1000)), formats=detect_format(lines),
        capped=cap_signal(plain, 1000), unexpanded=counts.unexpanded_count(payload_records(spark, sf)),
        failed=failed,
    )
    return diagnostics(report)


@query("export_view", d.select(d.TEXT_ONLY, f"""
SELECT file_id, rec_no, '{{"timestamp_iso":"' || substr(msg, 1, 19) || '","raw":"' || msg || '"}}' AS line FROM axes
WHERE {VIEW_SQL.split(" AND contains")[0]}"""))
def export_view(spark, sf):
    # Exporting all files keeps the switches and leaves the search out.
    shown = search.view(
        with_axes(text_logs(spark, sf), "bucket", "source"), off_buckets=["DEBUG"], off_sources=["cache"]
    )
    return shown.select("file_id", "rec_no", F.to_json("fields").alias("line"))


# --- the whole chain --------------------------------------------------------------------
def parsed_text(spark, sf):
    logs = text_logs(spark, sf)
    lines = logs.select("file_id", F.col("rec_no").alias("line_no"), F.col("raw").alias("raw_line"))
    return parse_lines(lines, ParseOptions(remove_duplicates=False))


@query("parse_records", d.select(d.TEXT_ONLY, "SELECT file_id, rec_no, level, bucket, source, req_id, ts_text, line FROM axes"))
def parse_records(spark, sf):
    return parsed_text(spark, sf).records.select(
        "file_id", "rec_no", "level", "bucket", "source", "req_id", "ts_text", "line")


@query("parse_report", d.select(d.TEXT_ONLY, """
SELECT file_id, 'text' AS format, count(*) AS total_lines, count(*) AS filtered,
  count(*) FILTER (WHERE level IN ('ERROR','FATAL','CRITICAL')) AS errors,
  count(*) FILTER (WHERE level IN ('WARN','WARNING')) AS warnings, 'ok' AS status FROM axes GROUP BY file_id"""))
def parse_report(spark, sf):
    return parsed_text(spark, sf).report.select(
        "file_id", "format", "total_lines", "filtered", "errors", "warnings", "status")
