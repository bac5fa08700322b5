"""The run report as rows: metrics, status and diagnostics per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_report(
    report: DataFrame,
    formats: DataFrame | None = None,
    encodings: DataFrame | None = None,
    capped: DataFrame | None = None,
    unexpanded: DataFrame | None = None,
    failed: DataFrame | None = None,
) -> DataFrame:
    """One row per file with everything the diagnostics are made from.

    Every input has one row per file; ``failed`` has ``file_id, error``.
    """
    out = report
    if failed is not None:
        out = out.join(failed.select("file_id", "error"), "file_id", "full")
    else:
        out = out.withColumn("error", F.lit(None).cast("string"))
    for table, columns in (
        (formats, "format string"), (encodings, "encoding string, fallback boolean"),
        (capped, "total bigint, truncated boolean"), (unexpanded, "unexpanded bigint"),
    ):
        names = [c.split()[0] for c in columns.split(", ")]
        if table is not None:
            out = out.join(table.select("file_id", *names), "file_id", "left")
        else:
            out = out.withColumns({
                c.split()[0]: F.lit(None).cast(c.split()[1]) for c in columns.split(", ")
            })
    zero = ["total_lines", "filtered", "errors", "warnings", "unexpanded"]
    return out.fillna(0, zero).fillna(False, ["fallback", "truncated"]).withColumn(
        "status",
        F.when(F.col("error").isNotNull(), "error").when(F.col("truncated"), "partial").otherwise("ok"),
    )


def diagnostics(report: DataFrame) -> DataFrame:
    """``file_id, seq, severity, code, detail`` with the fixed set of codes."""
    def entry(when, severity, code, detail):
        return F.when(when, F.struct(
            F.lit(severity).alias("severity"), code.alias("code"), detail.alias("detail")
        ))

    failed = F.col("error").isNotNull()
    number = lambda c: F.col(c).cast("string")
    entries = F.array_compact(F.array(
        entry(failed, "error", F.col("error"), F.lit("input could not be read or parsed")),
        entry(~failed, "info", F.lit("FORMAT_DETECTED"), F.coalesce("format", F.lit("unknown"))),
        entry(~failed & F.col("fallback"), "warn", F.lit("ENCODING_FALLBACK"),
              F.coalesce("encoding", F.lit(""))),
        entry(~failed & F.col("truncated"), "warn", F.lit("TRUNCATED"),
              F.concat(number("filtered"), F.lit(" of "), F.coalesce(number("total"), F.lit("?")))),
        entry(~failed & (F.col("filtered") == 0), "warn", F.lit("NO_RECORDS"), F.lit("no records")),
        entry(~failed & (F.col("unexpanded") > 0), "warn", F.lit("PARTIAL_EXPAND"),
              number("unexpanded")),
    ))
    return report.select("file_id", F.posexplode(entries).alias("seq", "_d")).select(
        "file_id", "seq", "_d.*"
    )
