"""NDJSON export: part files of one object per line, and a metadata side folder.

No header line inside the parts, so they read back as plain JSON lines. Records are
written by the tasks that hold them; nothing is gathered.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.operators.rewrite import flatten, readable_sql

VERSION = "1"


def write_ndjson(
    records: DataFrame,
    path: str,
    gzip: bool = False,
    flat: bool = False,
    per_file: bool = False,
    mode: str = "errorifexists",
    readable: bool = False,
) -> None:
    """Write ``fields`` of every record as one JSON line; nulls are kept.

    ``per_file`` makes a ``file_id=…`` folder per input. Rows are not repartitioned by file:
    a file holding a third of all rows is still written by many tasks. ``readable`` writes line breaks and
    tabs of SQL values as such: text for people, whose records end at the next line that begins with ``{``.
    """
    if flat:
        records = flatten(records)
    line = F.to_json(F.col("fields"), {"ignoreNullFields": "false"})
    line = (readable_sql(line) if readable else line).alias("value")
    out = records.select(*(["file_id"] if per_file else []), line)
    writer = out.write.mode(mode)
    if per_file:
        writer = writer.partitionBy("file_id")
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.text(path)


def export_counts(records: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Per file: records exported, records there were, and whether the export is partial."""
    exported = records.groupBy("file_id").agg(F.count("*").alias("exported"))
    if total is None:
        return exported.withColumns({"total": F.col("exported"), "truncated": F.lit(False)})
    return (
        total.groupBy("file_id").agg(F.count("*").alias("total"))
        .join(exported, "file_id", "left").fillna(0, ["exported"])
        .select("file_id", "exported", "total", (F.col("exported") < F.col("total")).alias("truncated"))
    )


def write_metadata(
    counts: DataFrame, path: str, filtered: bool = False, mode: str = "errorifexists"
) -> None:
    """Export metadata next to the data: version, UTC time, and one row per file."""
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    (
        counts.select(
            F.lit(VERSION).alias("version"), F.lit(stamp).alias("exported_at"),
            F.lit(filtered).alias("filtered"), "*",
        )
        .write.mode(mode).json(path)
    )


def export(
    records: DataFrame,
    path: str,
    total: DataFrame | None = None,
    filtered: bool = False,
    gzip: bool = False,
    flat: bool = False,
    per_file: bool = False,
    readable: bool = False,
) -> None:
    """``path/records`` and ``path/meta``."""
    write_ndjson(records, f"{path}/records", gzip=gzip, flat=flat, per_file=per_file, readable=readable)
    write_metadata(export_counts(records, total), f"{path}/meta", filtered=filtered)
