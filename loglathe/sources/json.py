"""JSON logs: one object per line, arrays, or objects spread over many lines.

A JSON string cannot hold a raw line break, so how deep a line goes is known from the line
alone, as the pair (how far up, how low on the way), and the running depth finds spread-out
records without reading a file whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions.fields import parse_object, squash_ends
from loglathe.operators.materialize import cut
from loglathe.operators.ordered import CHUNK_ROWS, chunk_of, join_runs, running, running_depth, with_rec_no

_STRING = r'"(?:[^"\\]|\\.)*+"'
_BETWEEN = r'\G((?:"(?:[^"\\]|\\.)*+"|[^"}]|\}(?!\s*,\s*\{))*+\})\s*,\s*(?=\{)'


def _bare(line: Column) -> Column:
    """The braces of a line that are not in strings."""
    return F.regexp_replace(F.regexp_replace(line, _STRING, ""), "[^{}]", "")


def _braces(line: Column) -> Column:
    bare = _bare(line)
    return (2 * F.length(F.replace(bare, F.lit("}"), F.lit(""))) - F.length(bare)).cast("bigint")


def _lowest(line: Column) -> Column:
    """How far below its start a line's depth goes on the way; 0 where it doesn't."""
    def step(acc, brace):
        depth = acc["depth"] + F.when(brace == "{", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(acc["low"], depth).alias("low"))

    bare = F.regexp_replace(_bare(line), r"\{\}", "")
    walked = F.aggregate(
        F.split(bare, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), step, lambda acc: acc["low"])
    closing = -F.length(bare)
    return F.when(bare.rlike(r"^\{*$"), 0).when(bare.rlike(r"^\}+$"), closing).otherwise(walked).cast("bigint")


def _pieces(line: Column) -> Column:
    """A line cut at every ``}, {`` outside strings (the comma stays with the second piece)."""
    return F.split(F.regexp_replace(line, _BETWEEN, "$1\n,"), "\n")


def _bare_object(raw: Column) -> Column:
    """Without an outer array's brackets and the commas between its objects."""
    return F.regexp_replace(squash_ends(raw), r"^[\s,\[]+(?=\{)|(?<=\})[\s,\]]+$", "")


_SEPARATOR_LINE = r"^[\s,\[\]]*$"


def _whole_objects(pieces: Column) -> Column:
    """Pieces of one line put together again wherever they belong to one object."""
    def step(acc, piece):
        text = F.concat(acc["open"], piece)
        depth = acc["depth"] + _braces(piece)
        closed = depth <= 0
        return F.struct(
            F.when(closed, F.array_append(acc["done"], text)).otherwise(acc["done"]).alias("done"),
            F.when(closed, "").otherwise(text).alias("open"),
            F.when(closed, 0).otherwise(depth).cast("bigint").alias("depth"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"),
        F.lit(0).cast("bigint").alias("depth"),
    )
    return F.aggregate(
        pieces, start, step,
        lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"]))
        .otherwise(acc["done"]),
    )


def line_objects(lines: DataFrame) -> DataFrame:
    """Every line holds whole objects: one per line, or several in an array.

    A line is complete in itself, so a damaged one cannot run into the next.
    """
    keep = [c for c in ("file_id", "file_name") if c in lines.columns]
    return (
        lines.select(
            *keep, "line_no",
            F.posexplode(_whole_objects(_pieces(F.col("raw_line")))).alias("_part", "_text"),
        )
        .filter(~F.col("_text").rlike(_SEPARATOR_LINE))
        .select(*keep, "line_no", F.col("_part").alias("part"), F.lit(0).alias("cont"), _bare_object(F.col("_text")).alias("raw"))
    )


def _tracked(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Pieces with ``_open`` (an object goes on after it) and, for objects of several pieces, the ``_first`` of them.

    Depth never falls below zero, so a brace too many closes nothing but itself.
    """
    deep = running_depth(pieces, by, "_chunk", "_at", F.col("_total"), F.col("_low"))
    depth = F.col("_depth")
    after = depth + F.col("_total") + F.greatest(F.lit(0), -(depth + F.col("_low")))
    flagged = cut(deep.withColumns({"_starts": depth == 0, "_open": after > 0}).filter(
        ~(F.col("_starts") & F.col("_text").rlike(_SEPARATOR_LINE))).drop("_depth"), "json-depths")
    kind = F.lit(None).cast("bigint")
    single = flagged.filter("_starts AND NOT _open").withColumns({"_first": kind, "_line": kind, "_base": kind})
    starts = lambda c: F.when(F.col("_starts"), c)
    several = running(
        flagged.filter("NOT _starts OR _open"), by, "_chunk", "_at", inclusive=True,
        maxes={"_first": starts(F.col("_at")), "_line": starts(F.col("line_no")),
               "_base": starts(F.col("_at") - F.col("_part"))})
    return single.unionByName(several)


_OPENING = r"^([ \t]*)\{"
_MEMBER = r'^([ \t]*)"'


def spread_objects(lines: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Objects may run over many lines (pretty-printed files).

    An object that is never closed would take in what comes after it. Where an object has a line inside that
    opens another at the indentation of the file's outermost objects, and has no end or is in a file that
    indents members deeper than that, such lines start afresh, so only the damaged object differs.
    """
    keep = [c for c in ("file_id", "file_name") if c in lines.columns]
    cut_lines = lines.select(
        *keep, "line_no", F.posexplode(_pieces(F.col("raw_line"))).alias("_part", "_text"))
    opens = (F.col("_part") == 0) & F.col("_text").rlike(_OPENING)
    # written, so that the patterns run once; every running value reads its input twice
    patterned = cut(cut_lines.withColumns({
        "_total": _braces(F.col("_text")), "_low": _lowest(F.col("_text")),
        "_indent": F.when(opens, F.length(F.regexp_extract("_text", _OPENING, 1))),
    }), "json-patterns")
    placed = cut(with_rec_no(patterned, order=["line_no", "_part"], name="_at", rows=rows).withColumn(
        "_chunk", chunk_of(F.col("line_no"), rows)), "json-places")
    first = cut(_tracked(placed, ["file_id"]), "json-pieces")
    # one row per file: how far its outermost objects, and its members, are indented
    styles = cut(first.groupBy("file_id").agg(
        F.min("_indent").alias("_outer"), F.min(F.when(F.col("_text").rlike(_MEMBER), F.length(F.regexp_extract("_text", _MEMBER, 1)))).alias("_inner")
    ), "json-indents")
    # an object is damaged that has an outermost opening inside, and no end or a file that indents what is inside
    outermost = (F.col("_indent") == F.col("_outer")) & (F.col("_at") > F.col("_first"))
    damaged = cut(first.filter("_first IS NOT NULL").join(styles, "file_id").groupBy("file_id", "_first").agg(
        F.min(F.col("_open").cast("int")).alias("_endless"), F.count_if(outermost).alias("_n"), F.max(F.col("_inner") > F.col("_outer")).alias("_indented"),
    ).filter("_n > 0 AND (_endless = 1 OR _indented)").groupBy("file_id").agg(F.min("_first").alias("_from")), "json-damaged")
    if damaged.isEmpty():
        tracked = first
    else:
        fresh = (F.col("_indent") == F.col("_outer")) & (F.col("_at") > F.col("_from"))
        parted = cut(running(
            first.join(damaged, "file_id").join(styles, "file_id").withColumn("_fresh", F.coalesce(fresh, F.lit(False)).cast("bigint")),
            ["file_id"], "_chunk", "_at", sums={"_seg": F.col("_fresh")}, inclusive=True,
        ).drop("_fresh", "_from", "_outer", "_inner", "_first", "_line", "_base", "_starts", "_open"), "json-parts")
        tracked = first.join(damaged, "file_id", "left_anti").unionByName(
            _tracked(parted, ["file_id", "_seg"]).drop("_seg"))
    single = tracked.filter("_first IS NULL").select(
        *keep, "line_no", F.col("_part").alias("part"), F.lit(0).alias("cont"), F.col("_text").alias("raw"))
    joined = join_runs(
        tracked.filter("_first IS NOT NULL").drop("line_no"), keep, "_first", "_at", "_text",
        extra={"_line": F.max("_line"), "_base": F.max("_base")})
    return single.unionByName(joined.select(
        *keep, F.col("_line").alias("line_no"), (F.col("line_no") - F.col("_base")).cast("int").alias("part"), "cont", "raw")
    ).withColumn("raw", F.when(F.col("cont") == 0, _bare_object(F.col("raw"))).otherwise(F.col("raw")))


def spread_files(lines: DataFrame) -> DataFrame:
    """Files in which fewer than half of the non-blank lines are whole objects.

    Deciding per file keeps one truncated line of a line-per-object file from running
    into the lines after it.
    """
    line = squash_ends(F.col("raw_line"))
    whole = line.rlike(r"^[\[,]?\s*\{.*\}\s*[,\]]*$")
    return (
        lines.groupBy("file_id")
        .agg(F.count_if(whole).alias("whole"), F.count_if(line != "").alias("filled"))
        .filter(F.col("whole") * 2 < F.col("filled"))
        .select("file_id")
    )


def assemble_json(lines: DataFrame, layout: str = "auto", rows: int = CHUNK_ROWS) -> DataFrame:
    """Lines -> one row per top-level JSON object: ``file_id, file_name?, line_no, part, cont, raw``.

    ``line_no`` is the line an object starts on, ``part`` its place among those of that line, and
    ``cont`` tells the rows of an object of very many lines apart.
    """
    if layout == "lines":
        return line_objects(lines)
    if layout == "spread":
        return spread_objects(lines, rows)
    if layout != "auto":
        raise ValueError("layout must be auto, lines or spread")
    spread = cut(spread_files(lines), "json-spread")  # a row per file; Spark plans by its real size
    return line_objects(lines.join(spread, "file_id", "left_anti")).unionByName(
        spread_objects(lines.join(spread, "file_id", "left_semi"), rows)
    )


def json_records(records: DataFrame) -> DataFrame:
    """``raw`` JSON text -> ``fields``; anything but an object becomes a ``message``."""
    as_message = F.map_from_arrays(
        F.array(F.lit("message")), F.array(F.col("raw").cast("variant"))
    )
    return records.withColumn("fields", F.coalesce(parse_object(F.col("raw")), as_message))


def read_json_logs(lines: DataFrame, layout: str = "auto", rows: int = CHUNK_ROWS) -> DataFrame:
    """``log_lines`` of JSON files -> ``file_id, file_name?, line_no, part, raw, fields, format``."""
    return json_records(assemble_json(lines, layout, rows)).withColumn("format", F.lit("json"))
