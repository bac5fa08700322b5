"""SQL text blocks the oracles are put together from (DuckDB dialect)."""

from __future__ import annotations

from loglathe.functions import fixed
from loglathe.plans import views

LEVEL_RX = r"(?i)\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)\b"
REQ_RX = (
    r"(?i)\b(?:req(?:uest)?[_-]?id|correlation[_-]?id|corr[_-]?id|trace[_-]?id|rid)\b"
    r'\s*[=:]?\s*"?([0-9a-zA-Z._-]{2,})"?'
)
VERBS = ", ".join(f"'{v}'" for v in fixed.HTTP_VERBS)


def level(x: str) -> str:
    return f"replace(upper(regexp_extract({x}, '{LEVEL_RX}', 1)), 'WARNING', 'WARN')"


def level_number(n: str) -> str:
    syslog = ", ".join(f"'{x}'" for x in fixed.SYSLOG_SEVERITY)
    tens = ", ".join(f"'{x}'" for x in fixed.PINO_LEVELS)
    return (
        f"CASE WHEN {n} BETWEEN 0 AND 7 THEN ([{syslog}])[{n} + 1] "
        f"WHEN {n} BETWEEN 10 AND 60 THEN ([{tens}])[least(6, CAST(round_even({n} / 10.0, 0) AS BIGINT))] END"
    )


def bucket(lv: str) -> str:
    return (
        f"CASE WHEN {lv} IN ('FATAL','CRITICAL','ERROR') THEN 'ERROR' WHEN {lv} IN ('WARN','INFO') "
        f"THEN {lv} WHEN {lv} IN ('DEBUG','TRACE') THEN 'DEBUG' ELSE 'OTHER' END"
    )


def component(x: str) -> str:
    word = f"regexp_extract({x}, '{LEVEL_RX}\\s*(\\S*)', 2)"
    return (
        f"CASE WHEN regexp_matches({word}, '^[A-Za-z][\\w.\\-]{{1,30}}$') "
        f"AND upper({word}) NOT IN ({VERBS}) THEN {word} ELSE '' END"
    )


def fixed_digits(x: str, digits: int) -> str:
    """printf rounds the exact binary value, ties to even; exact ties are moved off the tie upwards."""
    exact_tie = f"({x}) * 8 = floor(({x}) * 8) AND ({x}) * {2 * 10**digits} % 2 = 1"
    return f"printf('%.{digits}f', CASE WHEN {exact_tie} THEN ({x}) + 0.0001 ELSE ({x}) END)"


def nanos(n: str) -> str:
    d = f"CAST({n} AS DOUBLE)"
    return (
        f"CASE WHEN {d} >= 6e10 THEN {fixed_digits(f'{d} / 6e10', 1)} || 'min' "
        f"WHEN {d} >= 1e9 THEN {fixed_digits(f'{d} / 1e9', 2)} || 's' "
        f"WHEN {d} >= 1e6 THEN CAST(CAST(floor({d} / 1e6 + 0.5) AS BIGINT) AS VARCHAR) || 'ms' "
        f"WHEN {d} >= 1e3 THEN CAST(CAST(floor({d} / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || 'µs' "
        f"ELSE CAST({n} AS VARCHAR) || 'ns' END"
    )


def some(x: str) -> str:
    return f"nullif({x}, '')"


TEXT = views.duck_view("log_text", views.TEXT)
JSON = views.duck_view("log_json", views.JSON)
TRACE = views.duck_view("trace_text", views.TRACE_TEXT)

_AXES = "file_id, rec_no, level, source, req_id, ts_text, msg, method, url, status, dur, sql_snip"

TEXT_AXES = f"""{TEXT}, text_axes AS (
  SELECT file_id, rec_no, {level('raw')} AS level, {component('raw')} AS source,
         regexp_extract(raw, '{REQ_RX}', 1) AS req_id, substr(raw, 12, 8) AS ts_text, raw AS msg,
         '' AS method, '' AS url, '' AS status, '' AS dur, '' AS sql_snip
  FROM log_text)"""

JSON_AXES = f"""{JSON}, json_parts AS (
  SELECT file_id, rec_no, json_type(raw, '$.level') AS level_type, raw->>'$.level' AS level_text,
         raw->>'$.severity' AS severity, raw->>'$.msg' AS msg_text,
         coalesce(raw->>'$.service', raw->>'$._meta.kubernetes_container_name') AS source,
         coalesce(raw->>'$.req_id', raw->>'$.trace_id', raw->>'$.rid') AS req_id,
         raw->>'$.time' AS stamp, raw->>'$.method' AS method, raw->>'$.url' AS url,
         raw->>'$.status' AS status, CAST(raw->>'$.request_time' AS BIGINT) AS nanos,
         trim(regexp_replace(coalesce(raw->>'$.sql', ''), '\\s+', ' ', 'g')) AS sql_flat,
         'event=' || (raw->>'$.event') || ' · user=' || (raw->>'$.user')
           || ' · props={{"k":' || (raw->>'$.props.k') || '}}' AS residual
  FROM log_json), json_leveled AS (
  SELECT *, coalesce(
    CASE WHEN level_type = 'VARCHAR' THEN {some(level('level_text'))}
         WHEN level_type LIKE '%BIGINT' THEN {level_number('CAST(level_text AS BIGINT)')} END,
    {some(level('severity'))}, {some(level('msg_text'))}, '') AS level,
    coalesce(msg_text, residual) AS msg,
    CASE WHEN contains(coalesce(msg_text, ''), url) THEN '' ELSE url END AS url_shown,
    CASE WHEN contains(coalesce(msg_text, ''), status) THEN '' ELSE status END AS status_shown
  FROM json_parts), json_axes AS (
  SELECT file_id, rec_no, level, source, req_id, substr(stamp, 12, 8) AS ts_text, msg,
         CASE WHEN upper(method) IN ({VERBS}) AND url_shown <> '' THEN upper(method) ELSE '' END AS method,
         url_shown AS url, status_shown AS status, {nanos('nanos')} AS dur,
         CASE WHEN length(sql_flat) > 80 THEN rtrim(substr(sql_flat, 1, 80)) || '…' ELSE sql_flat END AS sql_snip
  FROM json_leveled)"""


def _lined(source: str) -> str:
    return f"""axes AS (
  SELECT *, {bucket('level')} AS bucket,
         concat_ws('  ', {some('ts_text')}, {some('level')}, {some('source')}, {some('summary')}) AS line
  FROM (SELECT {_AXES}, concat_ws(' · ',
          nullif(concat_ws(' ', {some('method')}, {some('url')}), ''),
          CASE WHEN status <> '' THEN '→ ' || status END, {some('dur')}, {some('msg')},
          CASE WHEN sql_snip <> '' THEN 'sql: ' || sql_snip END) AS summary
        FROM ({source})))"""


ALL_AXES = (
    f"{TEXT_AXES}, {JSON_AXES}, "
    + _lined("SELECT * FROM text_axes UNION ALL SELECT * FROM json_axes")
)
TEXT_ONLY = f"{TEXT_AXES}, " + _lined("SELECT * FROM text_axes")
JSON_ONLY = f"{JSON_AXES}, " + _lined("SELECT * FROM json_axes")


def select(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"
