"""Key lists, patterns and limits that define the log semantics.

Everything in this module must keep exactly these values for results to be right.
Order matters in every key list: the first matching key wins.
"""

# --- level -----------------------------------------------------------------
LEVEL_WORDS = ("DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL", "TRACE")
LEVEL_KEYS = ("level", "levelname", "log_level", "loglevel", "severity", "lvl")
SYSLOG_SEVERITY = ("FATAL", "FATAL", "CRITICAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
PINO_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")  # 10, 20, 30, 40, 50, 60
BUCKETS = ("ERROR", "WARN", "INFO", "DEBUG", "OTHER")
ERROR_LEVELS = ("ERROR", "FATAL", "CRITICAL")
WARN_LEVELS = ("WARN", "WARNING")

# ASCII word boundaries: Java's \b is Unicode-aware, these are not.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"
LEVEL_PATTERN = (
    # The first letter is looked at before the costlier boundary test.
    "(?i)(?=[DIWEFCT])" + WORD_START + "(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE)" + WORD_END
)

# --- text ------------------------------------------------------------------
# Level and metrics look at message first; the viewer axes look at raw first.
LEVEL_TEXT_KEYS = ("message", "msg", "raw", "line", "text", "log")
TEXT_KEYS = ("raw", "message", "msg", "line", "text", "log")

# --- time ------------------------------------------------------------------
TS_KEYS = ("timestamp_iso", "timestamp", "time", "ts", "datetime", "date")
ISO_PATTERN = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
CLOCK_PATTERN = r"\d{2}:\d{2}:\d{2}(?:[.,]\d{1,3})?"

# --- source ----------------------------------------------------------------
SRC_KEYS = (
    "source", "src", "logger", "service", "service_name", "module", "name", "channel",
    "app", "container_name", "service_instance",
    "kubernetes_labels_service_name", "kubernetes_labels_app_name",
    "kubernetes_container_name", "kubernetes_pod_name", "host",
)
COMPONENT_PATTERN = r"^[A-Za-z][A-Za-z0-9_.\-]{1,30}$"
HTTP_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE", "CONNECT")

# --- request id ------------------------------------------------------------
REQ_KEYS = (
    "req_id", "request_id", "requestId", "correlation_id", "correlationId",
    "corr_id", "trace_id", "traceId", "traceID", "rid", "span_id",
)
REQ_PATTERN = (
    "(?i)(?=[RCT])" + WORD_START
    + r"(?:req(?:uest)?[_-]?id|correlation[_-]?id|corr[_-]?id|trace[_-]?id|rid)"
    + WORD_END + r'\s*[=:]?\s*"?([0-9a-zA-Z._-]{2,})"?'
)

# --- HTTP, duration, SQL ---------------------------------------------------
METHOD_KEYS = ("method", "http_method", "verb")
URL_KEYS = ("url", "uri", "path", "request_uri", "route", "endpoint", "target")
STATUS_KEYS = ("status", "status_code", "statusCode", "http_status", "response_code", "resp_status")
NS_DUR_KEYS = (
    "request_time", "latency_ns", "duration_ns", "elapsed_ns", "took_ns", "response_time_ns",
)
QUERY_KEYS = ("sql", "query", "statement", "stmt", "cql")
SNIPPET_CHARS = 80
ELLIPSIS = "…"
DOT = " · "
ARROW = "→ "

# Fields shown as axes of their own; the residual message leaves them out.
CONSUMED_KEYS = tuple(dict.fromkeys(
    k.lower()
    for k in (*TEXT_KEYS, *TS_KEYS, *SRC_KEYS, *LEVEL_KEYS, *REQ_KEYS,
              *METHOD_KEYS, *URL_KEYS, *STATUS_KEYS, *NS_DUR_KEYS, *QUERY_KEYS)
))

# --- search-index export ---------------------------------------------------
META_KEY = "_meta"
META_PREFIX = "_meta."
ORIGINAL_KEY = "event_original"
ORIGINAL_PREFIX = "_meta.event_original."
META_NOISE = ("id", "index", "score", "type", "version", "tags", "p", "_p")

# --- export ----------------------------------------------------------------
# Keys whose values get real line breaks in a text export.
SQL_TEXT_KEYS = ("sql", "query", "statement", "query_text")

# --- limits and decoding ---------------------------------------------------
MAX_RECORDS = 100_000
PREVIEW_MAX = 10_000
FALLBACK_ENCODINGS = ("utf-8-sig", "cp1251", "koi8-r", "latin-1")
RECOVER_MAX_DEPTH = 4
HISTOGRAM_BINS = 20
FINGERPRINT_CHARS = 12
