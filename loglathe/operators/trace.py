"""Following one request through all files, and bookmarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.functions.axes import with_axes
from loglathe.operators.materialize import cut
from loglathe.operators.search import records_with
from loglathe.operators.sizes import join_small

TRACE_ORDER = ("file_id", "rec_no")


def trace(records: DataFrame, req_id: str) -> DataFrame:
    """All records of one request id over all files; an empty id finds nothing."""
    return records.filter((F.col("req_id") == req_id) & (F.col("req_id") != ""))


def find_trace(records: DataFrame, req_id: str, *wanted: str) -> DataFrame:
    """``trace`` over records that have no axes yet: only the records found get the ``wanted`` ones.

    What is found is written, so that putting it in order doesn't look for it twice.
    """
    found = trace(with_axes(records, "req_id"), req_id)
    return in_order(cut(records_with(found, *wanted), "trace"))


def trace_many(records: DataFrame, ids: DataFrame) -> DataFrame:
    """All records of any request id in ``ids`` (column ``req_id``)."""
    wanted = ids.select("req_id").filter("req_id <> ''").distinct()
    return join_small(records, wanted, ["req_id"], "left_semi")


def trace_of(records: DataFrame, anchors: DataFrame) -> DataFrame:
    """The traces that the anchor records ``(file_id, rec_no)`` belong to, each record once.

    ``anchor_ids`` says which anchor has which request id, so many anchors of one request don't
    multiply its trace. An anchor without a request id has none. Neighbouring rows are not context.
    """
    return trace_many(records, anchor_ids(records, anchors))


def anchor_ids(records: DataFrame, anchors: DataFrame) -> DataFrame:
    """``anchor_file_id, anchor_rec_no, req_id`` of every anchor that has a request id."""
    return join_small(
        records.filter("req_id <> ''"),
        anchors.select("file_id", "rec_no").distinct(), ["file_id", "rec_no"], "left_semi",
    ).select(
        F.col("file_id").alias("anchor_file_id"), F.col("rec_no").alias("anchor_rec_no"), "req_id"
    )


def in_order(records: DataFrame, *columns: str) -> DataFrame:
    """Session order of the files where the records know it (``file_ord``), then row order."""
    known = ("file_ord", "rec_no") if "file_ord" in records.columns else TRACE_ORDER
    return records.orderBy(*(columns or known))


def trace_summary(records: DataFrame) -> DataFrame:
    """Rows and distinct files of every request id.

    Counted per (id, file) first, so a request holding a large part of all rows is reduced
    before it is shuffled.
    """
    per_file = (
        records.filter("req_id <> ''").groupBy("req_id", "file_id").agg(F.count("*").alias("n"))
    )
    return per_file.groupBy("req_id").agg(
        F.sum("n").alias("row_count"), F.count("*").alias("file_count")
    ).withColumn("multi_file", F.col("file_count") > 1)


def bookmarks(records: DataFrame, marks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Marked records in marking order, with file name and 1-based row number.

    ``marks`` has ``seq, file_id, rec_no``. A mark whose record is gone keeps its place, with
    ``row_label`` ``—``. The record table is only semi-joined, so it is never widened.
    """
    kept = join_small(
        records, marks.select("file_id", "rec_no").distinct(), ["file_id", "rec_no"], "left_semi"
    ).withColumn("_there", F.lit(True))
    out = marks.join(kept, ["file_id", "rec_no"], "left").withColumn(
        "row_label",
        F.when(F.col("_there"), (F.col("rec_no") + 1).cast("string")).otherwise("—"),
    ).drop("_there")
    if files is not None:
        out = out.join(files.select("file_id", "file_name").distinct(), "file_id", "left")
    return out


def bookmarked(records: DataFrame, marks: DataFrame) -> DataFrame:
    """The marked records themselves, for export."""
    return join_small(
        records, marks.select("file_id", "rec_no").distinct(), ["file_id", "rec_no"], "left_semi"
    )


def drop_file(marks: DataFrame, removed: DataFrame | Sequence[str]) -> DataFrame:
    """Marks without those of removed files."""
    if isinstance(removed, DataFrame):
        return join_small(marks, removed.select("file_id").distinct(), ["file_id"], "left_anti")
    return marks.filter(~F.col("file_id").isin(*removed)) if removed else marks


def bookmark_summary(marks: DataFrame) -> DataFrame:
    per_file = marks.groupBy("file_id").agg(F.count("*").alias("n"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("marks"), F.count("*").alias("files")
    )
