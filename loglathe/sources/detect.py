"""Which format each file has, from its name or from all of its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.operators.multiline import GO_OPEN, GROUP_OPEN, PY_OPEN

# Extensions that decide the format before the content does.
FORMAT_BY_EXTENSION = {"csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl"}
TEXT_FORMATS = ("text", "python_traceback", "go_panic", "exception_group", "unknown")

_HEADER_CELL = r'(?:"[@A-Za-z_][^",]*"|[@A-Za-z_][A-Za-z0-9_.@\-]*)'
CSV_HEADER = rf"^{_HEADER_CELL}(?:,{_HEADER_CELL})+\s*$"


def format_by_name(file_name: Column) -> Column:
    extension = F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.lit(None).cast("string")
    for name, fmt in FORMAT_BY_EXTENSION.items():
        known = F.when(extension == name, fmt).otherwise(known)
    return known


#: A line that is whole JSON objects, one or several.
OBJECT_LINE = r"^\s*[\[,]?\s*\{.*\}\s*[,\]]*\s*$"
#: A line that can belong to a JSON file without being an object of its own: brackets, or a damaged object.
_JSON_REST = r"^\s*[\[\]{},]"


def detect_format(lines: DataFrame) -> DataFrame:
    """One row per file: ``file_id, format, mixed``.

    The extension decides where it is known (``file_name``, if that column is there), else
    the content: JSON lines if they are the most, then trace openers, a CSV header line, plain text.
    ``mixed``: the file is text or JSON lines, and has both lines that are JSON objects and
    lines that belong to no JSON. A whole-file aggregation with map-side combine over numbers and
    flags only; what the first line looks like is packed with its number.
    """
    line = F.col("raw_line")
    filled = ~line.rlike(r"^\s*$")
    has = lambda pattern: F.max(line.rlike(pattern))
    opens = line.rlike(r"^\s*\[?\s*\{?\s*$") & line.rlike(r"[\[{]")
    first = F.col("line_no") * 4 + F.when(line.rlike(CSV_HEADER), 2).otherwise(0) + F.when(opens, 1).otherwise(0)
    keys = ["file_id", *(["file_name"] if "file_name" in lines.columns else [])]
    object_line = line.rlike(OBJECT_LINE)
    seen = lines.groupBy(*keys).agg(
        has(GROUP_OPEN).alias("group"),
        has(PY_OPEN).alias("python"),
        has(GO_OPEN).alias("go"),
        F.count_if(filled).alias("filled"),
        F.count_if(object_line).alias("objects"),
        F.count_if(filled & ~object_line & ~line.rlike(_JSON_REST)).alias("others"),
        F.coalesce(F.min(F.when(filled, first)), F.lit(0)).alias("first"),
    )
    named = format_by_name(F.col("file_name")) if "file_name" in lines.columns else F.lit(None).cast("string")
    header, opener = F.pmod(F.col("first"), F.lit(4)) >= 2, F.pmod(F.col("first"), F.lit(2)) == 1
    content = (
        F.when((F.col("filled") > 0) & (F.col("objects") * 2 > F.col("filled")), "jsonl")
        .when(F.col("group"), "exception_group")
        .when(F.col("python") & ~header, "python_traceback")
        .when(F.col("go") & ~header, "go_panic")
        .when(opener, "json")
        .when((F.col("filled") > 1) & header, "csv")
        .otherwise("text")
    )
    fmt = F.coalesce(named, content)
    mixed = fmt.isin("jsonl", *TEXT_FORMATS) & (F.col("objects") > 0) & (F.col("others") > 0)
    return seen.select("file_id", fmt.alias("format"), mixed.alias("mixed"))
