"""Several inputs as one session."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Union of inputs in the given order; ``file_ord`` keeps it. Missing columns become NULL."""
    parts = [
        df.withColumn("file_ord", F.lit(i)).withColumn("session_name", F.lit(name))
        for i, (name, df) in enumerate(inputs.items())
    ]
    if not parts:
        raise ValueError("a session needs at least one input")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def inline(spark: SparkSession, text: str, file_id: str = "inline") -> DataFrame:
    """``log_lines`` of a text given directly (for tests and small pastes)."""
    from loglathe.sources.lines import split_texts

    one = spark.createDataFrame([(file_id, text)], "name string, text string")
    return split_texts(one, "text", F.col("name"), F.lit(0).cast("bigint"))


def session_overview(files: DataFrame, report: DataFrame) -> DataFrame:
    """Per file: name, size, format, errors, status.

    ``files`` has ``file_id, file_name, file_size, format``; a file without a report, or with an
    ``error`` in it, failed. An empty file with a report did not.
    """
    seen = F.when(F.col("error").isNull(), F.col("filtered")) if "error" in report.columns else F.col("filtered")
    return (
        files.join(report.select("file_id", seen.alias("filtered"), "errors"), "file_id", "left")
        .select(
            "file_id", "file_name", "file_size", "format",
            F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"),
            F.when(F.col("filtered").isNull(), "error").otherwise("parsed").alias("status"),
        )
    )


def session_totals(overview: DataFrame) -> DataFrame:
    return overview.agg(
        F.count_if(F.col("status") == "parsed").alias("parsed"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


def failed_files(requested: DataFrame, lines: DataFrame) -> DataFrame:
    """Requested files (``file_id``) of which nothing could be read."""
    return requested.join(lines.select("file_id").distinct(), "file_id", "left_anti")
