"""Caps, pages and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import fixed
from loglathe.operators.materialize import cut


def cap(records: DataFrame, n: int = fixed.MAX_RECORDS) -> DataFrame:
    """The first ``n`` records of each file. Needs dense ``rec_no``; a plain filter."""
    if n < 0:
        raise ValueError("n must not be negative")
    return records.filter(F.col("rec_no") < n)


def cap_signal(records: DataFrame, n: int = fixed.MAX_RECORDS) -> DataFrame:
    """Per file: records before the cap, after it, and whether any were cut off."""
    return records.groupBy("file_id").agg(F.count("*").alias("total")).select(
        "file_id", "total",
        F.least(F.col("total"), F.lit(n)).alias("kept"), (F.col("total") > n).alias("truncated"),
    )


def check_page(offset: int, limit: int) -> tuple[int, int]:
    for name, value in (("offset", offset), ("limit", limit)):
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{name} must be an integer")
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return offset, min(limit, fixed.PREVIEW_MAX)


def page(records: DataFrame, offset: int = 0, limit: int = fixed.PREVIEW_MAX) -> DataFrame:
    """One page of each file by position: a range filter, not a sort and skip."""
    offset, limit = check_page(offset, limit)
    return records.filter(F.col("rec_no").between(offset, offset + limit - 1))


def page_window(
    records: DataFrame, offset: int = 0, limit: int = fixed.PREVIEW_MAX, signal: DataFrame | None = None
) -> DataFrame:
    """Per file: ``offset, limit, returned, total_records, has_more``, and ``truncated`` with a ``signal``.

    ``signal`` is a ``cap_signal`` of the records before they were capped.
    """
    offset, limit = check_page(offset, limit)
    total = F.col("total_records")
    window = records.groupBy("file_id").agg(F.count("*").alias("total_records")).select(
        "file_id", F.lit(offset).cast("bigint").alias("offset"), F.lit(limit).cast("bigint").alias("limit"),
        F.greatest(F.lit(0), F.least(total - offset, F.lit(limit))).cast("bigint").alias("returned"),
        "total_records", (total > offset + limit).alias("has_more"),
    )
    if signal is None:
        return window
    return window.join(signal.select("file_id", "truncated"), "file_id", "left").fillna(False, ["truncated"])


def content_key(records: DataFrame) -> Column:
    """Text that is equal exactly when all fields are equal, whatever their order."""
    return F.to_json(F.to_variant_object(F.col("fields")))


def dedup(
    records: DataFrame,
    by: str = "file_id",
    order: str | Sequence[str] = "rec_no",
    key: Column | Sequence[Column] | None = None,
) -> DataFrame:
    """Drop records equal to an earlier one of the same file; the first stays.

    Two 64-bit hashes stand for a key (128 bits: no two different keys of a file are expected to
    share them). Only hashes and places are grouped, with map-side combine, so a line that makes
    up a third of a file never meets in one task; what comes more than once is written as a table
    and joined back, broadcast by Spark where it is small. Records are never sorted as a whole.
    """
    if key is None:
        key = content_key(records)
    keys = [key] if isinstance(key, Column) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    at = F.struct(*orders)
    hashed = {"_h1": F.xxhash64(*keys), "_h2": F.xxhash64(F.lit(1), *keys)}
    missing = [F.when(k.isNull(), F.lit(i)) for i, k in enumerate(keys)]     # a null is not the absence of a key
    hashed = {n: F.xxhash64(h, *missing) for n, h in hashed.items()}
    places = records.select(F.col(by).alias("_by"), *[c.alias(n) for n, c in hashed.items()], at.alias("_at"))
    repeats = cut(
        places.groupBy("_by", "_h1", "_h2").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").drop("_n"), "repeats")
    keyed = records.withColumns(hashed)
    again = (
        keyed[by].eqNullSafe(repeats["_by"]) & (keyed["_h1"] == repeats["_h1"]) & (keyed["_h2"] == repeats["_h2"])
        & (F.struct(*[keyed[o] for o in orders]) != repeats["_first"])
    )
    return keyed.join(repeats, again, "left_anti").select(*records.columns)
