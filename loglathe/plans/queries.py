"""One named query per operator, each over whole tables, with the SQL that states its answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.functions import axes as ax
from loglathe.functions import fixed
from loglathe.functions.axes import with_axes
from loglathe.operators import counts, search, trace, windows
from loglathe.operators.materialize import cut
from loglathe.operators.multiline import text_record
from loglathe.operators.ordered import with_rec_no
from loglathe.plans import ducksql as d
from loglathe.plans import views
from loglathe.plans.catalog import query
from loglathe.sources.json import json_records

A, T, J = d.ALL_AXES, d.TEXT_ONLY, d.JSON_ONLY


# --- inputs ------------------------------------------------------------------
def text_logs(spark: SparkSession, sf: str) -> DataFrame:
    return text_record(views.spark_view(spark, sf, views.TEXT).drop("event_id"))


def json_logs(spark: SparkSession, sf: str) -> DataFrame:
    return json_records(views.spark_view(spark, sf, views.JSON).drop("event_id"))


def all_logs(spark: SparkSession, sf: str) -> DataFrame:
    return text_logs(spark, sf).unionByName(json_logs(spark, sf))


def text_axes(spark: SparkSession, sf: str, *wanted: str) -> DataFrame:
    return with_axes(text_logs(spark, sf), *wanted)


def all_axes(spark: SparkSession, sf: str, *wanted: str) -> DataFrame:
    return with_axes(all_logs(spark, sf), *wanted)


def kept_axes(spark: SparkSession, sf: str, *wanted: str) -> DataFrame:
    """Places and axes of all records, written so that queries that look at them several times compute them once."""
    return cut(all_axes(spark, sf, *wanted).select("file_id", "rec_no", *wanted), "axes")


# --- axes --------------------------------------------------------------------
@query("level_of", d.select(A, "SELECT file_id, rec_no, level FROM axes"))
def level_of(spark, sf):
    return all_axes(spark, sf, "level").select("file_id", "rec_no", "level")


@query("level_numeric", f"""
SELECT event_id, n, coalesce({d.level_number('n')}, '') AS level
FROM (SELECT event_id, event_id % 75 - 3 AS n FROM events)""")
def level_numeric(spark, sf):
    n = F.col("event_id") % 75 - 3
    return views.table(spark, sf, "events").select(
        "event_id", n.alias("n"), F.coalesce(ax.level_from_number(n), F.lit("")).alias("level")
    )


@query("bucket_of", d.select(A, "SELECT file_id, rec_no, bucket FROM axes"))
def bucket_of(spark, sf):
    return all_axes(spark, sf, "bucket").select("file_id", "rec_no", "bucket")


@query("source_of", d.select(A, "SELECT file_id, rec_no, source FROM axes"))
def source_of(spark, sf):
    return all_axes(spark, sf, "source").select("file_id", "rec_no", "source")


@query("req_id_of", d.select(A, "SELECT file_id, rec_no, req_id FROM axes"))
def req_id_of(spark, sf):
    return all_axes(spark, sf, "req_id").select("file_id", "rec_no", "req_id")


@query("ts_of", d.select(A, "SELECT file_id, rec_no, ts_text FROM axes"))
def ts_of(spark, sf):
    return all_axes(spark, sf, "ts_text").select("file_id", "rec_no", "ts_text")


@query("msg_of", d.select(A, "SELECT file_id, rec_no, msg FROM axes"))
def msg_of(spark, sf):
    return all_axes(spark, sf, "msg").select("file_id", "rec_no", "msg")


@query("http_ctx", d.select(J, "SELECT file_id, rec_no, method, url, status, dur FROM axes"))
def http_ctx(spark, sf):
    return with_axes(json_logs(spark, sf), "http").select("file_id", "rec_no", "http.*")


@query("fmt_nanos", f"""
SELECT event_id, nanos, {d.nanos('nanos')} AS shown
FROM (SELECT event_id, {views.NANOS} AS nanos FROM events)""")
def fmt_nanos(spark, sf):
    return views.table(spark, sf, "events").selectExpr("event_id", f"{views.NANOS} AS nanos").withColumn(
        "shown", ax.fmt_nanos(F.col("nanos"))
    )


@query("sql_snippet", d.select(J, "SELECT file_id, rec_no, sql_snip FROM axes"))
def sql_snippet(spark, sf):
    return with_axes(json_logs(spark, sf), "sql_snip").select("file_id", "rec_no", "sql_snip")


@query("summary_of", d.select(A, "SELECT file_id, rec_no, summary FROM axes"))
def summary_of(spark, sf):
    return all_axes(spark, sf, "summary").select("file_id", "rec_no", "summary")


@query("record_line", d.select(A, "SELECT file_id, rec_no, line FROM axes"))
def record_line(spark, sf):
    return all_axes(spark, sf, "line").select("file_id", "rec_no", "line")


@query("http_class", d.select(J, """
SELECT file_id, rec_no,
  CASE method WHEN 'GET' THEN 'get' WHEN 'POST' THEN 'post' WHEN 'PUT' THEN 'put' WHEN 'PATCH' THEN 'put'
    WHEN 'DELETE' THEN 'del' WHEN 'HEAD' THEN 'meta' WHEN 'OPTIONS' THEN 'meta' ELSE 'other' END AS method_class,
  CASE WHEN status = '' THEN 'other' WHEN CAST(status AS INT) < 300 THEN 'ok'
    WHEN CAST(status AS INT) < 400 THEN 'redir' WHEN CAST(status AS INT) < 500 THEN 'warn' ELSE 'err' END AS status_class
FROM (SELECT file_id, rec_no, method, status FROM axes)"""))
def http_class(spark, sf):
    http = F.col("http")
    return with_axes(json_logs(spark, sf), "http").select(
        "file_id", "rec_no", ax.method_class(http["method"]).alias("method_class"),
        ax.status_class(http["status"]).alias("status_class"),
    )


@query("fingerprint", "SELECT doc_id, substr(sha1(text), 1, 12) AS fingerprint FROM documents")
def fingerprint(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", ax.fingerprint(F.col("text")).alias("fingerprint")
    )


# --- filters and search --------------------------------------------------------
@query("filter_levels", d.select(A, """
SELECT file_id, rec_no, level FROM axes WHERE level IN ('ERROR', 'WARN')"""))
def filter_levels(spark, sf):
    return search.filter_levels(all_axes(spark, sf, "level"), [" error", "WARNING"]).select(
        "file_id", "rec_no", "level"
    )


@query("hide_buckets", d.select(A, """
SELECT file_id, rec_no, bucket FROM axes WHERE bucket NOT IN ('INFO', 'OTHER')"""))
def hide_buckets(spark, sf):
    return search.hide_buckets(all_axes(spark, sf, "bucket"), ["INFO", "OTHER"]).select(
        "file_id", "rec_no", "bucket"
    )


@query("hide_sources", d.select(A, """
SELECT file_id, rec_no, source FROM axes WHERE source NOT IN ('', 'cache')"""))
def hide_sources(spark, sf):
    return search.hide_sources(all_axes(spark, sf, "source"), ["", "cache"]).select(
        "file_id", "rec_no", "source"
    )


@query("hide_sources_table", d.select(A, f""", logged AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE bucket = 'ERROR') AS bad FROM axes GROUP BY source)
SELECT file_id, rec_no, source FROM axes
WHERE source NOT IN (SELECT source FROM logged WHERE bad * 5 < n)"""))
def hide_sources_table(spark, sf):
    logs = kept_axes(spark, sf, "source", "bucket")
    quiet = logs.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("bucket") == "ERROR").alias("bad")
    ).filter("bad * 5 < n")
    return search.hide_sources(logs, quiet).select("file_id", "rec_no", "source")


SEARCH_SQL = """level IN ('ERROR', 'WARN') AND (contains(lower(source), 'api') OR contains(lower(source), 'work'))
  AND contains(lower(line), 'r1') AND contains(lower(line), 'error')"""


@query("search", d.select(A, f"SELECT file_id, rec_no, line FROM axes WHERE {SEARCH_SQL}"))
def search_all(spark, sf):
    return search.find(
        all_logs(spark, sf), "line", levels=["error", "warn"], srcs=["API", "work"], words=["r1", "Error"]
    ).select("file_id", "rec_no", "line")


@query("search_req", d.select(A, "SELECT file_id, rec_no, line FROM axes WHERE lower(req_id) = 'r7'"))
def search_req(spark, sf):
    return search.find(all_logs(spark, sf), "line", reqs=["R7"]).select("file_id", "rec_no", "line")


VIEW_SQL = "bucket <> 'DEBUG' AND source <> 'cache' AND contains(lower(line), 'r2')"


@query("view", d.select(A, f"SELECT file_id, rec_no, line FROM axes WHERE {VIEW_SQL}"))
def view(spark, sf):
    return search.find(
        all_logs(spark, sf), "line", off_buckets=["DEBUG"], off_sources=["cache"], words=["r2"]
    ).select("file_id", "rec_no", "line")


@query("view_counter", d.select(T, f"""
SELECT count(*) FILTER (WHERE {VIEW_SQL}) AS visible, count(*) AS in_window,
       (SELECT count(*) FROM log_text WHERE trim(raw) <> '') AS total_lines FROM axes"""))
def view_counter(spark, sf):
    shown = (
        search.bucket_shown(["DEBUG"]) & search.source_shown(["cache"]) & search.matches(words=["r2"])
    )
    lines = views.spark_view(spark, sf, views.TEXT).withColumnRenamed("raw", "raw_line")
    return counts.view_counter(text_axes(spark, sf, "bucket", "source", "line"), shown, lines)


# --- counts --------------------------------------------------------------------
@query("bucket_counts", d.select(A, """
SELECT b.bucket, count(axes.bucket) AS n
FROM (VALUES ('ERROR'), ('WARN'), ('INFO'), ('DEBUG'), ('OTHER')) AS b(bucket)
LEFT JOIN axes ON axes.bucket = b.bucket GROUP BY b.bucket"""))
def bucket_counts(spark, sf):
    return counts.bucket_counts(all_axes(spark, sf, "bucket"))


@query("source_counts", d.select(A, "SELECT source, count(*) AS n FROM axes GROUP BY source"))
def source_counts(spark, sf):
    return counts.source_counts(all_axes(spark, sf, "source"))


@query("facets", d.select(A, """, found AS (SELECT * FROM axes WHERE contains(lower(line), 'r1'))
SELECT 'bucket' AS facet, b.bucket AS name, count(f.bucket) AS n
FROM (VALUES ('ERROR'), ('WARN'), ('INFO'), ('DEBUG'), ('OTHER')) AS b(bucket)
LEFT JOIN (SELECT * FROM found WHERE source NOT IN ('cache')) f ON f.bucket = b.bucket GROUP BY b.bucket
UNION ALL
SELECT 'source', s.source, count(f.source) FROM (SELECT DISTINCT source FROM axes) s
LEFT JOIN (SELECT * FROM found WHERE bucket NOT IN ('INFO', 'ERROR')) f ON f.source = s.source GROUP BY s.source"""))
def facets(spark, sf):
    return counts.facets(
        all_axes(spark, sf, "bucket", "source", "line"), off_buckets=["INFO", "ERROR"], off_sources=["cache"], words=["r1"]
    )


@query("run_metrics", d.select(A, """
SELECT t.file_id, t.total_lines, coalesce(filtered, 0) AS filtered, coalesce(errors, 0) AS errors,
       coalesce(warnings, 0) AS warnings
FROM (SELECT file_id, count(*) AS total_lines FROM axes GROUP BY file_id) t
LEFT JOIN (SELECT file_id, count(*) AS filtered,
    count(*) FILTER (WHERE level IN ('ERROR','FATAL','CRITICAL')) AS errors,
    count(*) FILTER (WHERE level = 'WARN') AS warnings
  FROM axes WHERE level IN ('ERROR', 'WARN', 'FATAL') GROUP BY file_id) r USING (file_id)"""))
def run_metrics(spark, sf):
    logs = all_axes(spark, sf, "level")
    lines = all_logs(spark, sf).select("file_id", F.col("raw").alias("raw_line"))
    return counts.run_report(lines, search.filter_levels(logs, ["ERROR", "WARN", "FATAL"]))


@query("trace_summary", d.select(A, """
SELECT req_id, count(*) AS row_count, count(DISTINCT file_id) AS file_count,
       count(DISTINCT file_id) > 1 AS multi_file
FROM axes WHERE req_id <> '' GROUP BY req_id"""))
def trace_summary(spark, sf):
    return trace.trace_summary(all_axes(spark, sf, "req_id"))


@query("trace_summary_turns", """
SELECT CAST(conv_id AS VARCHAR) AS req_id, count(*) AS row_count, count(DISTINCT role) AS file_count,
       count(DISTINCT role) > 1 AS multi_file
FROM conversations GROUP BY conv_id""")
def trace_summary_turns(spark, sf):
    turns = views.table(spark, sf, "conversations").select(
        F.col("role").alias("file_id"), F.col("conv_id").cast("string").alias("req_id")
    )
    return trace.trace_summary(turns)


@query("histogram", d.select(A, """, totals AS (SELECT file_id, count(*) AS total FROM axes GROUP BY file_id),
placed AS (SELECT file_id, CAST(least(19, floor(CAST(rec_no AS DOUBLE) / CAST(total AS DOUBLE) * 20)) AS INT) AS bin
  FROM axes JOIN totals USING (file_id) WHERE bucket = 'ERROR')
SELECT t.file_id, CAST(b.bin AS INT) AS bin, count(p.bin) AS n
FROM totals t CROSS JOIN range(20) AS b(bin) LEFT JOIN placed p ON p.file_id = t.file_id AND p.bin = b.bin
GROUP BY t.file_id, b.bin"""))
def histogram(spark, sf):
    return counts.level_histogram(all_axes(spark, sf, "bucket"), "ERROR", totals=counts.file_totals(all_logs(spark, sf)))


@query("histogram_bin", d.select(A, """, totals AS (SELECT file_id, count(*) AS total FROM axes GROUP BY file_id),
chosen AS (SELECT file_id, max(rec_no) AS rec_no FROM axes WHERE bucket = 'ERROR' GROUP BY file_id, source)
SELECT file_id, rec_no, CAST(least(19, floor(CAST(rec_no AS DOUBLE) / CAST(total AS DOUBLE) * 20)) AS INT) AS bin
FROM chosen JOIN totals USING (file_id)"""))
def histogram_bin(spark, sf):
    logs = kept_axes(spark, sf, "bucket", "source")
    chosen = logs.filter("bucket = 'ERROR'").groupBy("file_id", "source").agg(
        F.max("rec_no").alias("rec_no")
    ).select("file_id", "rec_no")
    return counts.bin_of_records(logs, chosen)


# --- traces and bookmarks --------------------------------------------------------
@query("trace_one", d.select(A, "SELECT file_id, rec_no, line FROM axes WHERE req_id = 'r8'"))
def trace_one(spark, sf):
    return trace.find_trace(all_logs(spark, sf), "r8", "line").select("file_id", "rec_no", "line")


FIRST_ERRORS_SQL = """anchors AS (
  SELECT file_id AS anchor_file_id, min(rec_no) AS anchor_rec_no FROM axes WHERE bucket = 'ERROR' GROUP BY file_id)"""


def first_errors(logs: DataFrame) -> DataFrame:
    return logs.filter("bucket = 'ERROR'").groupBy("file_id").agg(F.min("rec_no").alias("rec_no"))


@query("trace_anchor", d.select(A, f""", {FIRST_ERRORS_SQL}, ids AS (
  SELECT anchor_file_id, anchor_rec_no, req_id FROM anchors
  JOIN axes ON file_id = anchor_file_id AND rec_no = anchor_rec_no WHERE req_id <> '')
SELECT file_id, rec_no, req_id, level FROM axes WHERE req_id IN (SELECT req_id FROM ids)"""))
def trace_anchor(spark, sf):
    logs = kept_axes(spark, sf, "req_id", "level", "bucket")
    return trace.trace_of(logs, first_errors(logs)).drop("bucket")


@query("trace_many", d.select(A, """
SELECT file_id, rec_no, req_id FROM axes WHERE req_id <> '' AND req_id IN (
  SELECT req_id FROM axes WHERE level IN ('FATAL', 'CRITICAL'))"""))
def trace_many(spark, sf):
    logs = kept_axes(spark, sf, "req_id", "level")
    worst = logs.filter(F.col("level").isin("FATAL", "CRITICAL")).select("req_id")
    return trace.trace_many(logs, worst).drop("level")


def last_errors(logs: DataFrame) -> DataFrame:
    """Marks: the last error of each source in each file, and one that is gone per file."""
    last = logs.filter("bucket = 'ERROR'").groupBy("file_id", "source").agg(
        F.max("rec_no").alias("rec_no")
    ).select(F.col("rec_no").alias("seq"), "file_id", "rec_no")
    gone = logs.groupBy("file_id").agg((F.max("rec_no") + 1).alias("rec_no")).select(
        F.col("rec_no").alias("seq"), "file_id", "rec_no"
    )
    return last.unionByName(gone)


MARKS_SQL = """marks AS (
  SELECT max(rec_no) AS seq, file_id, max(rec_no) AS rec_no FROM axes WHERE bucket = 'ERROR' GROUP BY file_id, source
  UNION ALL SELECT max(rec_no) + 1, file_id, max(rec_no) + 1 FROM axes GROUP BY file_id)"""


@query("bookmarks", d.select(A, f""", {MARKS_SQL}
SELECT seq, m.file_id, CASE WHEN a.rec_no IS NULL THEN '—' ELSE CAST(m.rec_no + 1 AS VARCHAR) END AS row_label,
       a.level, a.summary, m.file_id || '.log' AS file_name
FROM marks m LEFT JOIN axes a ON a.file_id = m.file_id AND a.rec_no = m.rec_no"""))
def bookmarks(spark, sf):
    logs = kept_axes(spark, sf, "bucket", "source", "level", "summary")
    files = logs.select("file_id").distinct().withColumn(
        "file_name", F.concat("file_id", F.lit(".log"))
    )
    return trace.bookmarks(logs, last_errors(logs), files).select(
        "seq", "file_id", "row_label", "level", "summary", "file_name"
    ).orderBy("seq", "file_id")


@query("bookmarks_anti", d.select(A, f""", {MARKS_SQL}
SELECT seq, file_id, rec_no FROM marks WHERE file_id NOT IN ('f1', 'j0')"""))
def bookmarks_anti(spark, sf):
    return trace.drop_file(last_errors(kept_axes(spark, sf, "bucket", "source")), ["f1", "j0"])


@query("bookmark_summary", d.select(A, f""", {MARKS_SQL}
SELECT count(*) AS marks, count(DISTINCT file_id) AS files FROM marks"""))
def bookmark_summary(spark, sf):
    return trace.bookmark_summary(last_errors(kept_axes(spark, sf, "bucket", "source"))).select(
        F.col("marks").cast("bigint").alias("marks"), "files"
    )


# --- positions, caps, pages, duplicates ---------------------------------------------
@query("rec_no", """
SELECT 'f' || CAST(event_id % 3 AS VARCHAR) AS file_id, event_id,
       row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS rec_no FROM events""")
def rec_no(spark, sf):
    events = views.spark_view(spark, sf, {k: views.TEXT[k] for k in ("file_id", "event_id")})
    return with_rec_no(events, "file_id", "event_id")


@query("cap", d.select(d.TEXT, """, totals AS (SELECT file_id, count(*) AS total FROM log_text GROUP BY file_id)
SELECT file_id, rec_no, raw FROM log_text WHERE rec_no < 1000"""))
def cap(spark, sf):
    return windows.cap(text_logs(spark, sf), 1000).select("file_id", "rec_no", "raw")


@query("cap_signal", d.select(d.TEXT, """
SELECT file_id, count(*) AS total, least(count(*), 1000) AS kept, count(*) > 1000 AS truncated
FROM log_text GROUP BY file_id"""))
def cap_signal(spark, sf):
    return windows.cap_signal(text_logs(spark, sf), 1000).withColumn("kept", F.col("kept").cast("bigint"))


@query("page", d.select(d.TEXT, "SELECT file_id, rec_no, raw FROM log_text WHERE rec_no >= 50 AND rec_no < 90"))
def page(spark, sf):
    return windows.page(text_logs(spark, sf), 50, 40).select("file_id", "rec_no", "raw")


@query("page_window", d.select(d.TEXT, """
SELECT file_id, CAST(50 AS BIGINT) AS "offset", CAST(40 AS BIGINT) AS "limit",
       greatest(0, least(count(*) - 50, 40)) AS returned, count(*) AS total_records,
       count(*) > 90 AS has_more
FROM log_text GROUP BY file_id"""))
def page_window(spark, sf):
    return windows.page_window(text_logs(spark, sf), 50, 40)


@query("dedup", """
SELECT source AS file_id, min(doc_id) AS rec_no, text FROM documents GROUP BY source, text""")
def dedup(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        F.col("source").alias("file_id"), F.col("doc_id").alias("rec_no"), "text"
    )
    return windows.dedup(docs, key=F.col("text"))


@query("dedup_fields", """
SELECT 'p' AS file_id, min(event_id) AS rec_no FROM events
GROUP BY event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT)""")
def dedup_fields(spark, sf):
    # The same fields in two key orders are the same record.
    raw = (
        "CASE WHEN event_id % 2 = 0 "
        "THEN concat('{\"t\":\"', event_type, '\",\"u\":', user_id, ',\"p\":', props, '}') "
        "ELSE concat('{\"p\":', props, ',\"u\":', user_id, ',\"t\":\"', event_type, '\"}') END"
    )
    logs = views.table(spark, sf, "events").selectExpr("'p' AS file_id", "event_id AS rec_no", f"{raw} AS raw")
    return windows.dedup(json_records(logs)).select("file_id", "rec_no")


@query("text_search_documents", """
SELECT source AS file_id, doc_id AS rec_no FROM documents
WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')""")
def text_search_documents(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        F.col("source").alias("file_id"), F.col("doc_id").alias("rec_no"), F.col("text").alias("line")
    )
    return search.search(docs, words=["THE", "and"]).select("file_id", "rec_no")


__all__ = ["all_axes", "all_logs", "fixed", "json_logs", "text_axes", "text_logs"]
