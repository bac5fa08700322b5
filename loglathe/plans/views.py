"""Log-shaped views over the given tables.

Each view is one SQL expression list that Spark and DuckDB both understand, apart from
``@ts@`` (time as text) and ``@div@`` (integer division), so both engines see the same log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"ts": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "div": "div"}
DUCK = {"ts": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "div": "//"}

LEVEL = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' "
    "WHEN 'signup' THEN 'Info' WHEN 'click' THEN 'DEBUG' ELSE 'note' END"
)
COMPONENT = (
    "CASE event_id % 4 WHEN 0 THEN 'api-gateway' WHEN 1 THEN 'worker-3' "
    "WHEN 2 THEN 'cache' ELSE 'POST' END"
)
USER = "CAST(user_id AS STRING)"
EVENT = "CAST(event_id AS STRING)"
CENTS = "CAST(round(value * 100) AS BIGINT)"
URL = f"'/api/' || event_type || '/' || {USER}"
STATUS = "CASE event_id % 4 WHEN 0 THEN '200' WHEN 1 THEN '302' WHEN 2 THEN '404' ELSE '500' END"
NANOS = (
    f"{CENTS} * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 123 "
    "WHEN 2 THEN 1234567 ELSE 234567890 END"
)

TEXT = {
    "event_id": "event_id",
    "file_id": "'f' || CAST(event_id % 3 AS STRING)",
    "rec_no": "event_id @div@ 3",
    "raw": (
        f"@ts@ || ' ' || {LEVEL} || ' ' || {COMPONENT} || ' ' || event_type || "
        f"CASE WHEN event_id % 11 = 0 THEN '' ELSE ' req_id=r' || {USER} END"
    ),
}

JSON = {
    "event_id": "event_id",
    "file_id": "'j' || CAST(event_id % 3 AS STRING)",
    "rec_no": "event_id @div@ 3",
    "raw": (
        "'{\"time\":\"' || @ts@ || '\",' || "
        "CASE event_id % 5 "
        f"WHEN 0 THEN '\"level\":\"' || {LEVEL} || '\",' "
        "WHEN 1 THEN '\"level\":' || CAST(event_id % 9 AS STRING) || ',' "
        "WHEN 2 THEN '\"level\":' || CAST(event_id % 71 AS STRING) || ',' "
        "WHEN 3 THEN '\"level\":true,' ELSE '\"severity\":\"warn\",' END || "
        "CASE WHEN event_id % 6 = 0 "
        f"THEN '\"_meta\":{{\"kubernetes_container_name\":\"' || {COMPONENT} || '\"}},' "
        f"ELSE '\"service\":\"' || {COMPONENT} || '\",' END || "
        "'\"method\":\"' || CASE event_id % 7 WHEN 0 THEN 'get' WHEN 1 THEN 'PUT' "
        "WHEN 2 THEN 'HEAD' WHEN 3 THEN 'BREW' ELSE 'POST' END || '\",' || "
        f"'\"url\":\"' || {URL} || '\",\"status\":' || {STATUS} || ',' || "
        f"'\"request_time\":' || CAST({NANOS} AS STRING) || ',' || "
        "CASE event_id % 4 WHEN 0 THEN '\"trace_id\":\"r' WHEN 1 THEN '\"rid\":\"' "
        f"ELSE '\"req_id\":\"r' END || {USER} || '\",' || "
        "CASE event_id % 3 WHEN 0 THEN '' "
        f"WHEN 1 THEN '\"msg\":\"Handled ' || {URL} || ' done\",' "
        f"ELSE '\"msg\":\"Failed with ' || {STATUS} || '\",' END || "
        "CASE WHEN event_id % 7 = 0 THEN '\"sql\":\"SELECT *' || chr(92) || 'n  FROM ' || event_type || "
        "CASE WHEN event_id % 2 = 0 THEN ' WHERE a_rather_long_column_name = 1 "
        "AND another_rather_long_column_name = 2' ELSE '' END || '  \",' ELSE '' END || "
        f"'\"event\":' || {EVENT} || ',\"user\":\"u' || {USER} || '\",\"props\":' || props || '}}'"
    ),
}

# One text per event, of one to eight lines: three kinds of traces and plain lines.
TRACE_TEXT = {
    "event_id": "event_id",
    "file_id": "'f' || CAST(event_id % 3 AS STRING)",
    "text": (
        "CASE event_type "
        f"WHEN 'error' THEN @ts@ || ' ERROR in app: Exception on /api/v' || {USER} || ' [PUT]' || chr(10) || "
        "'Traceback (most recent call last):' || chr(10) || "
        f"'  File \"/opt/app/main.py\", line ' || {EVENT} || ', in handle' || chr(10) || "
        "'    return run()' || chr(10) || "
        "'  File \"/opt/app/run.py\", line 7, in run' || chr(10) || "
        f"'app.errors.BadValue: value ' || {USER} || ' is bad' "
        f"WHEN 'purchase' THEN @ts@ || ' http: panic serving 10.0.0.1:80: runtime error: index ' || {USER} || chr(10) || "
        f"'goroutine ' || {EVENT} || ' [running]:' || chr(10) || "
        "'net/http.(*conn).serve.func1()' || chr(10) || chr(9) || '/usr/go/server.go:1947 +0xbe' || chr(10) || "
        "'main.(*Server).handle(0xc000)' || chr(10) || chr(9) || '/app/server.go:142 +0x3a8' "
        "WHEN 'signup' THEN 'ExceptionGroup: unhandled errors (2 sub-exceptions)' || chr(10) || "
        "'  + Exception Group Traceback (most recent call last):' || chr(10) || "
        "'  |   File \"/opt/core/engine.py\", line 54, in start' || chr(10) || "
        f"'  | PermissionError: denied for u' || {USER} || chr(10) || "
        "'  +---------------- 2 ----------------' || chr(10) || "
        f"'  | KeyError: k' || {EVENT} || chr(10) || '  +------------------------------------' "
        f"ELSE @ts@ || ' ' || {LEVEL} || ' ' || {COMPONENT} || ' ' || event_type END"
    ),
}


def _in(expression: str, dialect: dict[str, str]) -> str:
    for name, text in dialect.items():
        expression = expression.replace(f"@{name}@", text)
    return expression


def columns(view: dict[str, str], dialect: dict[str, str]) -> str:
    return ", ".join(f"{_in(e, dialect)} AS {name}" for name, e in view.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table in one task of per-record work.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for per-record work, in tasks of about ``TASK_ROWS`` rows, when the input has fewer splits.

    A split of a table of short rows holds millions of them, so splits alone bound no task. The rows are
    counted from the file's footers. Inputs with enough splits pass through without a shuffle.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    wanted = max(cores, -(-df.count() // TASK_ROWS))
    return df.repartition(wanted) if splits < wanted else df


def spark_view(spark: SparkSession, sf_dir: str, view: dict[str, str], name: str = "events") -> DataFrame:
    """The view over a table; rows are dealt to tasks before texts are made of them, while they are short."""
    return spread(table(spark, sf_dir, name)).selectExpr(
        *[f"{_in(e, SPARK)} AS {alias}" for alias, e in view.items()]
    )


def duck_view(alias: str, view: dict[str, str], name: str = "events") -> str:
    """A CTE body for the oracle."""
    return f"{alias} AS (SELECT {columns(view, DUCK)} FROM {name})"
