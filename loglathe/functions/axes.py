"""The axes people investigate a log by, as Column expressions over the field map.

An axis that is absent is the empty string, never NULL.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import fixed
from loglathe.functions.fields import (
    TEXTS, Cells, field_of, is_array, is_string, key_array, let, one_line, present, settle,
    string_at, text, with_cells,
)


# --- level -----------------------------------------------------------------
def level_word(value: Column) -> Column:
    """First level word in a text, WARNING folded into WARN; '' when there is none."""
    word = F.upper(F.regexp_extract(value, fixed.LEVEL_PATTERN, 1))
    return F.replace(word, F.lit("WARNING"), F.lit("WARN"))


def has_level_word(value: Column) -> Column:
    return value.rlike(fixed.LEVEL_PATTERN)


def level_from_number(number: Column) -> Column:
    """Syslog severity 0-7 or a 10-60 scale rounded half-even to tens; else NULL."""
    step = F.least(F.lit(6), F.bround(number / F.lit(10.0), 0).cast("int"))
    return F.when(number.between(0, 7), F.get(key_array(fixed.SYSLOG_SEVERITY), number.cast("int"))).when(
        number.between(10, 60), F.get(key_array(fixed.PINO_LEVELS), step - 1)
    )


def _word_or_null(value: Column) -> Column:
    return F.when(has_level_word(value), level_word(value))


def level_of(cells: Cells) -> Column:
    """Level from a level field (a word in a string, or an integer), else from the first text
    field that names one, else ''."""
    return F.coalesce(
        cells.first(fixed.LEVEL_KEYS, lambda k: F.coalesce(
            _word_or_null(cells.string(k)), level_from_number(cells.integer(k))
        )),
        cells.first(fixed.LEVEL_TEXT_KEYS, lambda k: _word_or_null(cells.string(k))),
        F.lit(""),
    )


def bucket_of(level: Column) -> Column:
    return (
        F.when(level.isin(*fixed.ERROR_LEVELS), "ERROR")
        .when(level.isin("WARN", "INFO"), level)
        .when(level.isin("DEBUG", "TRACE"), "DEBUG")
        .otherwise("OTHER")
    )


# --- source, request id, time ----------------------------------------------
def is_verb(value: Column) -> Column:
    return F.upper(value).isin(*fixed.HTTP_VERBS)


def word_after_level(value: Column) -> Column:
    return F.regexp_extract(value, fixed.LEVEL_PATTERN + r"\s*(\S*)", 2)


def component_of(word: Column) -> Column:
    """The word right after the first level word, unless it is an HTTP verb; else ''."""
    return F.when(word.rlike(fixed.COMPONENT_PATTERN) & ~is_verb(word), word).otherwise("")


def req_id_in_text(value: Column) -> Column:
    return F.regexp_extract(value, fixed.REQ_PATTERN, 1)


def stamp_of(cells: Cells) -> Column:
    """The first ISO time among the time fields, else the first time field, else ''."""
    stamps = F.filter(
        F.transform(cells.held(fixed.TS_KEYS), cells.scalar), lambda v: v.isNotNull()
    )
    return let(stamps, lambda s: F.coalesce(
        F.get(F.filter(s, lambda t: t.rlike(fixed.ISO_PATTERN)), F.lit(0)),
        F.get(s, F.lit(0)),
        F.lit(""),
    ))


def clock_of(stamp: Column) -> Column:
    """``HH:MM:SS[.ms]`` in a time text, else its first 12 characters."""
    return F.coalesce(
        F.nullif(F.regexp_extract(stamp, fixed.CLOCK_PATTERN, 0), F.lit("")),
        F.substring(stamp, 1, 12),
    )


# --- message ---------------------------------------------------------------
def residual_of(fields: Column, texts: Column) -> Column:
    """``k=v`` of every field that is not an axis of its own, in record order."""
    kept = F.map_filter(
        texts,
        lambda k, _: (k != fixed.META_KEY)
        & ~k.rlike(r"^col_\d+$")
        & ~F.lower(k).isin(*fixed.CONSUMED_KEYS),
    )

    def pair(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        nested = value.rlike(r"^[{\[]") & ~is_string(fields[key])
        flat = F.when(value.isNull(), "null").when(nested, value).otherwise(one_line(value))
        return F.concat(key, F.lit("="), flat)

    return F.array_join(F.transform(F.map_entries(kept), pair), fixed.DOT)


# --- HTTP, duration, SQL ---------------------------------------------------
def _fixed_point(x: Column, digits: int) -> Column:
    """``x`` with ``digits`` decimals, rounded by its exact binary value, ties upwards.

    k = floor(x * 10^digits) may have to go up by one: if x * 2 * 10^digits >= 2k + 1. That is
    tested without rounding: 2 * 10^digits is an odd number times a power of two, and x is the
    sum of two parts short enough for their products with the odd number to be exact.
    """
    odd, power = 5**digits, 2.0 ** (digits + 1)
    high = x.cast("float").cast("double")
    k = F.floor(x * float(10**digits))
    edge = (2 * k + 1).cast("double") / power
    up = (high * float(odd) - edge) + (x - high) * float(odd) >= 0
    n = k + up.cast("bigint")
    cents = F.lpad((n % 10**digits).cast("string"), digits, "0")
    return F.concat(F.floor(n / 10**digits).cast("string"), F.lit("."), cents)


def fmt_nanos(nanos: Column) -> Column:
    """Nanoseconds -> ``1.5min``, ``2.50s``, ``30ms``, ``2µs`` or ``500ns``; '' if not >= 0."""
    n = nanos.try_cast("double")
    below = F.when(
        n == F.floor(n), n.cast("bigint").cast("string")
    ).otherwise(n.cast("string"))
    return (
        F.when(n.isNull() | F.isnan(n) | (n < 0) | (n == float("inf")), "")
        .when(n >= 6e10, F.concat(_fixed_point(n / 6e10, 1), F.lit("min")))
        .when(n >= 1e9, F.concat(_fixed_point(n / 1e9, 2), F.lit("s")))
        .when(n >= 1e6, F.concat(F.floor(n / 1e6 + 0.5).cast("string"), F.lit("ms")))
        .when(n >= 1e3, F.concat(F.floor(n / 1e3 + 0.5).cast("string"), F.lit("µs")))
        .otherwise(F.concat(below, F.lit("ns")))
    )


def sql_of(cells: Cells) -> Column:
    """First non-blank SQL field, right-trimmed, else ''."""
    found = cells.first(
        fixed.QUERY_KEYS, lambda k: F.when(cells.string(k).rlike(r"\S"), cells.string(k))
    )
    return F.coalesce(F.regexp_replace(found, r"\s+$", ""), F.lit(""))


def cut_text(flat: Column, max_chars: int = fixed.SNIPPET_CHARS) -> Column:
    cut = F.regexp_replace(F.substring(flat, 1, max_chars), r"\s+$", "")
    return F.when(F.length(flat) > max_chars, F.concat(cut, F.lit(fixed.ELLIPSIS))).otherwise(flat)


def sql_snippet(sql: Column, max_chars: int = fixed.SNIPPET_CHARS) -> Column:
    return let(one_line(sql), lambda flat: cut_text(flat, max_chars))


def join_parts(separator: str, *parts: Column) -> Column:
    """Join, skipping empty parts. ``parts`` are plain columns."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


# --- classes for display ---------------------------------------------------
def method_class(method: Column) -> Column:
    m = F.upper(method)
    return (
        F.when(m == "GET", "get").when(m == "POST", "post")
        .when(m.isin("PUT", "PATCH"), "put").when(m == "DELETE", "del")
        .when(m.isin("HEAD", "OPTIONS"), "meta").otherwise("other")
    )


def status_class(status: Column) -> Column:
    n = F.regexp_extract(status, r"^\s*([+-]?\d+)", 1).try_cast("decimal(38,0)")
    return (
        F.when(n.isNull() | (n == 0), "other").when(n < 300, "ok").when(n < 400, "redir")
        .when(n < 500, "warn").otherwise("err")
    )


def truthy(value: Column) -> Column:
    """Present and not null, false, zero or an empty string."""
    return F.coalesce(
        present(value)
        & F.when(is_string(value), text(value) != "").otherwise(~text(value).isin("false", "0")),
        F.lit(False),
    )


def _text_or_empty(value: Column) -> Column:
    return let(value, lambda v: F.when(truthy(v), text(v)).otherwise(""))


def exc_type(fields: Column) -> Column:
    """Last dotted part of ``type`` for records that carry a trace; else ''."""
    traced = (
        truthy(fields["frames"]) | truthy(fields["traceback"]) | truthy(fields["sub_exceptions"])
    )
    return F.when(
        traced & truthy(fields["type"]),
        F.element_at(F.split(text(fields["type"]), r"\."), -1),
    ).otherwise("")


def net_error(fields: Column) -> Column:
    """``addr[:port]``, else the error type with spaces; then ``rpc:<code>``."""
    parts = F.struct(*[
        _text_or_empty(fields[k]).alias(k)
        for k in ("error_addr", "error_port", "error_type", "rpc_code")
    ])
    return let(parts, lambda p: F.concat_ws(
        fixed.DOT,
        F.when(p["error_addr"] != "", join_parts(":", p["error_addr"], p["error_port"]))
        .when(p["error_type"] != "", F.replace(p["error_type"], F.lit("_"), F.lit(" "))),
        F.when(p["rpc_code"] != "", F.concat(F.lit("rpc:"), p["rpc_code"])),
    ))


def trace_text(fields: Column) -> Column:
    return F.coalesce(
        F.nullif(string_at(fields, "traceback"), F.lit("")),
        F.nullif(string_at(fields, "stacktrace"), F.lit("")),
        F.lit(""),
    )


def frame_count(fields: Column) -> Column:
    return let(fields["frames"], lambda v: F.coalesce(
        F.when(v.isNotNull() & is_array(v), F.size(v.cast("array<variant>"))), F.lit(0)
    ))


def fingerprint(value: Column) -> Column:
    """Short content hash, to tell inputs apart without keeping their text."""
    return F.substring(F.sha1(value.cast("binary")), 1, fixed.FINGERPRINT_CHARS)


# --- all axes --------------------------------------------------------------
AXES = ("level", "bucket", "source", "req_id", "ts_text", "msg", "http", "sql_snip", "summary", "line")


@lru_cache(maxsize=4)
def _stages(_gateway: int) -> tuple[dict[str, Column], ...]:
    """The axes as stages of expressions, each reading columns of the stages before.

    * url and status are left out of ``http`` when the message text already says them;
    * the method is shown only next to a shown url, or when there is no url at all.
    """
    cells, empty = Cells(F.col(TEXTS), F.col("fields")), F.lit("")
    c = F.col
    filled = lambda k: F.when(cells.string(k) != "", True)
    found = {
        "level": level_of(cells),
        "_text": F.coalesce(field_of(fixed.TEXT_KEYS), empty),
        "_said": cells.first(fixed.TEXT_KEYS, cells.string),
        "_textual": F.coalesce(cells.first(fixed.TEXT_KEYS, filled), F.lit(False)),
        "_source": field_of(fixed.SRC_KEYS),
        "_req": cells.first(fixed.REQ_KEYS, cells.shown),
        "_stamp": stamp_of(cells),
        "_method": F.coalesce(field_of(fixed.METHOD_KEYS), empty),
        "_url": F.coalesce(field_of(fixed.URL_KEYS), empty),
        "_status": F.coalesce(field_of(fixed.STATUS_KEYS), empty),
        "_nanos": cells.first(fixed.NS_DUR_KEYS, cells.shown).try_cast("double"),
        "_sql": one_line(sql_of(cells)),
    }
    named = {
        "_word": word_after_level(c("_text")),
        "bucket": bucket_of(c("level")),
        "req_id": F.coalesce(c("_req"), req_id_in_text(c("_text"))),
        "ts_text": clock_of(c("_stamp")),
        "msg": F.coalesce(c("_said"), residual_of(c("fields"), c(TEXTS))),
        "sql_snip": cut_text(c("_sql")),
        "_dur": F.coalesce(fmt_nanos(c("_nanos")), empty),
    }
    shown = {
        "source": F.coalesce(c("_source"), component_of(c("_word"))),
        "_url_shown": F.when(c("_textual") & c("msg").contains(c("_url")), "").otherwise(c("_url")),
        "_status_shown": F.when(
            c("_textual") & c("msg").contains(c("_status")), "").otherwise(c("_status")),
    }
    method = {
        "_method_shown": F.when(
            is_verb(c("_method")) & ((c("_url_shown") != "") | (c("_url") == "")),
            F.upper(c("_method")),
        ).otherwise(""),
    }
    http = {
        "http": F.struct(
            c("_method_shown").alias("method"), c("_url_shown").alias("url"),
            c("_status_shown").alias("status"), c("_dur").alias("dur"),
        ),
        "_request": join_parts(" ", c("_method_shown"), c("_url_shown")),
    }
    summary = {"summary": summary_of(
        c("_request"), c("_status_shown"), c("_dur"), c("msg"), c("sql_snip")
    )}
    line = {"line": join_parts("  ", c("ts_text"), c("level"), c("source"), c("summary"))}
    return found, named, shown, method, http, summary, line


def with_axes(records: DataFrame, *wanted: str) -> DataFrame:
    """Add the wanted axes (all of ``AXES`` when none are named).

    Stateless: it runs in the scan stage without a shuffle. Stages that no wanted axis
    needs are pruned away.
    """
    unknown = set(wanted) - set(AXES)
    if unknown:
        raise ValueError(f"unknown axes: {sorted(unknown)}")
    wanted = [a for a in AXES if a in wanted] if wanted else list(AXES)
    kept = [c for c in records.columns if c not in AXES]
    staged = with_cells(records)
    for stage in _stages(id(SparkContext._gateway)):
        staged = staged.withColumns(stage)
    return settle(staged.select(*kept, *wanted), *wanted)


def summary_of(request: Column, status: Column, dur: Column, base: Column, snippet: Column) -> Column:
    """One line: ``METHOD URL · → STATUS · DUR · message · sql: …``, empty parts left out."""
    return F.concat_ws(
        fixed.DOT,
        F.nullif(request, F.lit("")),
        F.when(status != "", F.concat(F.lit(fixed.ARROW), status)),
        F.nullif(dur, F.lit("")),
        F.nullif(base, F.lit("")),
        F.when(snippet != "", F.concat(F.lit("sql: "), snippet)),
    )
