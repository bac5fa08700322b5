"""Assembly of multi-line stack traces into one record, and plain lines into records.

Every line gets a class from its own text. Whether it continues a trace depends on the
lines before it only through "the last line that was not indented" and "the last line that
was neither indented nor a Go call", so both are running maxima of ``line_no * 64 + code``
and cross chunk and split edges exactly (see ``ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglathe.functions import fixed
from loglathe.functions.axes import has_level_word, level_word
from loglathe.operators.materialize import cut
from loglathe.operators.ordered import CHUNK_ROWS, MAX_LINES, chunk_of, join_runs, running

# Line classes.
OTHER, LOG, PANIC, PY, GO, GROUP, GROUP_HEAD, INDENT, CALL, BLANK, RAISED = range(11)
# Openers also carry how many lines before them their record starts.
_OFFSETS = 4  # two bits for the offset, four for the class
_PACK = 64

PY_OPEN = r"^Traceback \(most recent call last\):\s*$"
GO_OPEN = r"^goroutine \d+ \[[^\]]*\]:"
GROUP_OPEN = r"^\s*\+ Exception Group Traceback \(most recent call last\):\s*$"
GROUP_TITLE = r"^(?:[A-Za-z_][\w]*\.)*(?:Base)?ExceptionGroup: "
PANIC_TITLE = r"(?:^|\s)panic(?:: | serving )"
GO_CALL = r"^(?:created by \S.*|[\w./*()\-$@\[\]]+\(.*\))$"
RAISED_LINE = r"^([A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)*)(?:: ?(.*))?$"


def line_class(line: Column) -> Column:
    level_first = F.regexp_extract(line, RAISED_LINE, 1).rlike(
        "(?i)^(?:" + "|".join(fixed.LEVEL_WORDS) + ")$"
    )
    return (
        F.when(line.rlike(r"^\s*$"), BLANK)
        .when(line.rlike(GROUP_OPEN), GROUP)
        .when(line.rlike(r"^\s"), INDENT)
        .when(line.rlike(PY_OPEN), PY)
        .when(line.rlike(GO_OPEN), GO)
        .when(line.rlike(GROUP_TITLE), GROUP_HEAD)
        .when(line.rlike(PANIC_TITLE), PANIC)
        .when(line.rlike(GO_CALL), CALL)
        .when(line.rlike(RAISED_LINE) & ~level_first, RAISED)
        .when(F.startswith(line, F.lit("{")) & line.rlike(r"\}\s*$"), OTHER)  # a JSON line heads no trace
        .when(has_level_word(line), LOG)
        .otherwise(OTHER)
    )


def _code(pack: Column) -> Column:
    return F.shiftright(F.pmod(pack, F.lit(_PACK)), 2)


def _first_line(pack: Column) -> Column:
    """Number of the line a packed opener's record starts at."""
    return F.shiftright(pack, 6) - F.pmod(pack, F.lit(_OFFSETS))


def _with_groups(lines: DataFrame, rows: int) -> DataFrame:
    """Add ``cls``, ``gid`` (line number the record starts at) and ``multi``; blank lines go."""
    no = F.col("line_no")
    at = F.pmod(no, F.lit(rows))
    own = chunk_of(no, rows)
    # The two lines on either side of a chunk edge are copied across it, so looking two
    # lines back or ahead never leaves the chunk.
    homes = F.array_compact(F.array(
        own, F.when(at >= rows - 2, own + rows), F.when((at < 2) & (own > 0), own - rows)
    ))
    spread = (
        lines.withColumn("cls", line_class(F.col("raw_line")))
        .withColumn("_chunk", F.explode(homes))
        .withColumn("_own", F.col("_chunk") == own)
    )
    w = Window.partitionBy("file_id", "_chunk").orderBy("line_no")
    cls, prev, prev2 = F.col("cls"), F.lag("cls", 1).over(w), F.lag("cls", 2).over(w)
    # How many lines before an opener its record starts (its header line).
    offset = (
        F.when((cls == PY) & (prev == LOG), 1)
        .when((cls == GO) & (prev == PANIC), 1)
        .when((cls == GO) & (prev == BLANK) & (prev2 == PANIC), 2)
        .when((cls == GROUP) & prev.isin(GROUP_HEAD, LOG), 1)
        .otherwise(0)
    )
    opened = spread.withColumn("_offset", offset)
    ahead, ahead2 = F.lead("_offset", 1).over(w), F.lead("_offset", 2).over(w)
    # written, so that lines are classed once and not for each of the steps below
    heads = cut(opened.withColumn(
        "_head", F.coalesce(ahead == 1, F.lit(False)) | F.coalesce(ahead2 == 2, F.lit(False))
    ).filter("_own").drop("_own"), "line-classes")

    pack = no * _PACK + cls * _OFFSETS + F.col("_offset")
    tracked = running(
        heads, ["file_id"], "_chunk", "line_no",
        maxes={
            "_solid": F.when(cls != INDENT, pack),
            "_anchor": F.when(~cls.isin(INDENT, CALL), pack),
        },
    )
    solid, anchor = _code(F.col("_solid")), _code(F.col("_anchor"))
    opener = (
        F.when(cls.isin(PY, GO, GROUP), no - F.col("_offset"))
        .when((cls == INDENT) & solid.isin(PY, GROUP), _first_line(F.col("_solid")))
        .when(cls.isin(INDENT, CALL) & (anchor == GO), _first_line(F.col("_anchor")))
        .when(cls.isin(RAISED, GROUP_HEAD, CALL) & (solid == PY), _first_line(F.col("_solid")))
    )
    # what the record's opener is, told to each of its lines
    told = (
        F.when(cls.isin(PY, GO, GROUP), cls)
        .when((cls == INDENT) & solid.isin(PY, GROUP), solid)
        .when(cls.isin(INDENT, CALL) & (anchor == GO), GO)
        .when(cls.isin(RAISED, GROUP_HEAD, CALL) & (solid == PY), PY)
    )
    return (
        tracked.withColumn("_told", told).filter(cls != BLANK)
        .withColumn("gid", F.coalesce(opener, no))
        .withColumn("multi", opener.isNotNull() | F.col("_head"))
        .drop("_solid", "_anchor", "_offset", "_head", "_chunk")
    )


def assemble_multiline(lines: DataFrame, rows: int = CHUNK_ROWS, max_lines: int = MAX_LINES) -> DataFrame:
    """``log_lines`` -> one row per record: ``file_id, file_name?, line_no, cont, kind, raw``.

    ``kind`` is python_traceback, go_panic, exception_group or text. Single lines pass
    through; only lines of real multi-line records are shuffled once more to be joined. A record
    of more than ``max_lines`` lines goes on in rows with the same ``line_no`` and ``kind`` and ``cont`` from 1 up.
    """
    keep = [c for c in ("file_id", "file_name") if c in lines.columns]
    grouped = cut(_with_groups(lines.select(*keep, "line_no", "raw_line"), rows), "line-groups")
    single = grouped.filter(~F.col("multi")).select(
        *keep, "line_no", F.lit(0).alias("cont"), F.lit("text").alias("kind"), F.col("raw_line").alias("raw")
    )
    told = F.max("_told")
    kind = F.when(told == GROUP, "exception_group").when(told == GO, "go_panic").otherwise("python_traceback")
    joined = join_runs(
        grouped.filter("multi"), keep, "gid", "line_no", "raw_line", max_lines=max_lines,
        extra={"kind": kind},
    )
    return single.unionByName(joined)


def continuations(assembled: DataFrame) -> DataFrame:
    """The further rows of records of very many lines: ``file_id, line_no, cont, raw``."""
    return assembled.filter("cont > 0").select("file_id", "line_no", "cont", "raw")


# --- one record's text -> its fields -----------------------------------------
_FRAME = r'(?m)^[ \t|]*File "([^"]*)", line (\d+), in (.*)$'
_SUB_RAISED = r"(?m)^\s*\|\s?([A-Za-z_][\w.]*): (.*)$"


def frames_of(raw: Column) -> Column:
    """Frames of a Python trace: ``ARRAY<STRUCT<file, line, function>>``."""
    files, nos, names = (F.regexp_extract_all(raw, F.lit(_FRAME), F.lit(i)) for i in (1, 2, 3))
    return F.transform(
        F.arrays_zip(files.alias("file"), nos.alias("line"), names.alias("function")),
        lambda z: F.struct(
            z["file"].alias("file"), z["line"].cast("bigint").alias("line"),
            z["function"].alias("function"),
        ),
    )


def sub_exceptions_of(raw: Column) -> Column:
    """Inner exceptions of a group: ``ARRAY<STRUCT<type, message>>``."""
    types, messages = (
        F.regexp_extract_all(raw, F.lit(_SUB_RAISED), F.lit(i)) for i in (1, 2)
    )
    pairs = F.arrays_zip(types.alias("type"), messages.alias("message"))
    return F.filter(pairs, lambda p: ~p["type"].rlike("ExceptionGroup$"))


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def trace_columns(records: DataFrame) -> DataFrame:
    """Add what a trace says about itself.

    level, type, message, method, url STRING; goroutine BIGINT; frames, sub_exceptions
    ARRAY<STRUCT>; traceback STRING. All NULL for plain text.
    """
    raw, kind = F.col("raw"), F.col("kind")
    python, go, group = (
        kind == k for k in ("python_traceback", "go_panic", "exception_group")
    )
    last = F.element_at(F.split(raw, "\n"), -1)
    first = F.element_at(F.split(raw, "\n"), 1)
    http = r"\s(/\S*) \[([A-Z]+)\]\s*$"
    title = r"(?m)^\s*\|?\s*((?:[A-Za-z_]\w*\.)*(?:Base)?ExceptionGroup): (.*)$"
    return records.withColumns({
        "level": F.when(go, "FATAL").when(
            python | group, F.coalesce(_some(level_word(first)), F.lit("ERROR"))
        ),
        "type": F.when(python, _some(F.regexp_extract(last, RAISED_LINE, 1)))
        .when(group, F.coalesce(
            F.element_at(F.split(_some(F.regexp_extract(raw, title, 1)), r"\."), -1),
            F.lit("ExceptionGroup"),
        ))
        .when(go & first.rlike(PANIC_TITLE), "panic"),
        "message": F.when(python, _some(F.regexp_extract(last, RAISED_LINE, 2)))
        .when(group, _some(F.regexp_extract(raw, title, 2)))
        .when(go, _some(F.regexp_extract(
            first, r"(?:^|\s)panic(?:: | serving \S+: )(.*)$", 1
        ))),
        "method": F.when(python, _some(F.regexp_extract(first, http, 2))),
        "url": F.when(python, _some(F.regexp_extract(first, http, 1))),
        "goroutine": F.when(
            go, F.regexp_extract(raw, r"(?m)^goroutine (\d+) \[", 1).try_cast("bigint")
        ),
        "frames": F.when(python | group, frames_of(raw)),
        "sub_exceptions": F.when(group, sub_exceptions_of(raw)),
        "traceback": F.when(kind != "text", raw),
    })


def text_timestamp(line: Column) -> Column:
    """ISO time at the start of a line, optionally in brackets; NULL if absent."""
    return _some(F.regexp_extract(
        line, r"^\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?)", 1
    ))


def text_fields_of(line: Column) -> Column:
    """Fields of a plain line: ``raw`` (and ``timestamp_iso``) for a log line with a time or a
    level, else ``message``."""
    stamp = text_timestamp(line)
    value = line.cast("variant")
    return (
        F.when(stamp.isNotNull(), F.create_map(
            F.lit("timestamp_iso"), stamp.cast("variant"), F.lit("raw"), value))
        .when(has_level_word(line), F.create_map(F.lit("raw"), value))
        .otherwise(F.create_map(F.lit("message"), value))
    )


def text_record(records: DataFrame) -> DataFrame:
    """Plain lines in ``raw`` -> ``fields``."""
    return records.withColumn("fields", text_fields_of(F.col("raw")))


_PARTS = ("level", "type", "message", "method", "url", "goroutine", "frames",
          "sub_exceptions", "traceback")


def trace_to_record(records: DataFrame) -> DataFrame:
    """Assembled text records -> ``fields``: named parts of a trace, or a plain line's fields."""
    if "cont" in records.columns:
        records = records.filter("cont = 0").drop("cont")
    traced = trace_columns(records)
    entries = F.array(
        F.struct(F.lit("timestamp_iso").alias("key"),
                 text_timestamp(F.col("raw")).cast("variant").alias("value")),
        *[F.struct(F.lit(k).alias("key"), _to_variant(k, F.col(k)).alias("value")) for k in _PARTS],
    )
    fields = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return traced.withColumn(
        "fields",
        F.when(F.col("kind") == "text", text_fields_of(F.col("raw"))).otherwise(fields),
    ).drop(*_PARTS)


def _to_variant(key: str, value: Column) -> Column:
    if key in ("frames", "sub_exceptions"):
        return F.to_variant_object(value)
    return value.cast("variant")


__all__ = [
    "assemble_multiline", "continuations", "frames_of", "line_class", "sub_exceptions_of",
    "text_fields_of", "text_record", "text_timestamp", "trace_columns", "trace_to_record",
]
