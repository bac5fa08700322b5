"""Counts over records: metrics, buckets, sources, facets, histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import fixed
from loglathe.operators.search import bucket_shown, matches, source_shown, unexpanded_candidates, with_unexpanded
from loglathe.operators.materialize import cut
from loglathe.operators.sizes import join_small


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_id").agg(
        F.count_if(~F.col("raw_line").rlike(r"^\s*$")).alias("total_lines")
    )


def level_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("file_id").agg(
        F.count("*").alias("filtered"),
        F.count_if(F.col("level").isin(*fixed.ERROR_LEVELS)).alias("errors"),
        F.count_if(F.col("level").isin(*fixed.WARN_LEVELS)).alias("warnings"),
    )


def run_report(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Per file: non-blank lines, records kept, errors, warnings. Zeros where nothing was kept."""
    zero = ["total_lines", "filtered", "errors", "warnings"]
    return line_counts(lines).join(level_counts(records), "file_id", "full").fillna(0, zero)


def _all_buckets(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(b) for b in fixed.BUCKETS])
    return df.sparkSession.range(1).select(F.explode(names).alias("bucket"))


def bucket_counts(records: DataFrame) -> DataFrame:
    """Five buckets, always; zero where nothing falls into one."""
    counted = records.groupBy("bucket").agg(F.count("*").alias("n"))
    return (
        _all_buckets(records).join(counted, "bucket", "left").fillna(0, ["n"])
        .withColumn("_rank", F.array_position(
            F.array(*[F.lit(b) for b in fixed.BUCKETS]), F.col("bucket")))
        .orderBy("_rank").drop("_rank")
    )


def source_counts(records: DataFrame) -> DataFrame:
    """Records per source: most first, then by name, the unnamed source last."""
    return (
        records.groupBy("source").agg(F.count("*").alias("n"))
        .orderBy(F.col("source") == "", F.desc("n"), "source")
    )


def facets(
    records: DataFrame,
    off_buckets: Sequence[str] = (),
    off_sources: Sequence[str] = (),
    **query: Sequence[str],
) -> DataFrame:
    """Counts next to each filter switch: ``facet, name, n``.

    Bucket counts obey the source switches and the search; source counts obey the bucket
    switches and the search. Switched-off and empty entries stay, with their number.
    One pass: the data is reduced to (bucket, source) cells, both facets are sums of cells.
    """
    cells = records.groupBy("bucket", "source").agg(
        F.count_if(matches(**query)).alias("hits")
    )
    return facets_of_cells(cells, off_buckets, off_sources)


def facets_of_cells(cells: DataFrame, off_buckets: Sequence[str] = (), off_sources: Sequence[str] = ()) -> DataFrame:
    """Both facets as sums of cells ``bucket, source, hits``."""
    entries = F.array(
        F.struct(F.lit("bucket").alias("facet"), F.col("bucket").alias("name"),
                 F.when(source_shown(off_sources), F.col("hits")).otherwise(0).alias("hits")),
        F.struct(F.lit("source").alias("facet"), F.col("source").alias("name"),
                 F.when(bucket_shown(off_buckets), F.col("hits")).otherwise(0).alias("hits")),
    )
    empty = _all_buckets(cells).select(
        F.lit("bucket").alias("facet"), F.col("bucket").alias("name"),
        F.lit(0).cast("bigint").alias("hits"),
    )
    return (
        cells.select(F.inline(entries)).unionByName(empty)
        .groupBy("facet", "name").agg(F.sum("hits").alias("n"))
    )


def view_counter(records: DataFrame, shown: Column, lines: DataFrame) -> DataFrame:
    """One row: records shown, records there, non-blank lines."""
    counted = records.agg(
        F.count_if(shown).alias("visible"), F.count("*").alias("in_window"),
        F.lit(0).cast("bigint").alias("total_lines"),
    )
    none = F.lit(0).cast("bigint")
    total = lines.agg(
        none.alias("visible"), none.alias("in_window"),
        F.count_if(~F.col("raw_line").rlike(r"^\s*$")).alias("total_lines"),
    )
    names = ("visible", "in_window", "total_lines")
    return counted.unionByName(total).agg(*[F.sum(n).alias(n) for n in names])


def unexpanded_count(records: DataFrame) -> DataFrame:
    """Per file: records with a field that looks like JSON but does not parse."""
    return (
        with_unexpanded(unexpanded_candidates(records)).filter("unexpanded")
        .groupBy("file_id").agg(F.count("*").alias("unexpanded"))
    )


def position_bin(rec_no: Column, total: Column, bins: int = fixed.HISTOGRAM_BINS) -> Column:
    share = rec_no.cast("double") / total.cast("double")
    return F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")


def file_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("file_id").agg(F.count("*").alias("total"))


def level_histogram(
    records: DataFrame, bucket: str, bins: int = fixed.HISTOGRAM_BINS, totals: DataFrame | None = None,
) -> DataFrame:
    """Where in each file the records of one bucket lie: ``file_id, bin, n``, zeros kept.

    Bins are equal shares of row positions, which ``ntile`` would not give. ``rec_no`` must be
    the dense 0-based position. ``totals`` (``file_id, total``) can be counted before the axes are there,
    so that those are computed once.
    """
    totals = cut(file_totals(records) if totals is None else totals, "file-totals")  # a row per file
    placed = records.filter(F.col("bucket") == bucket).select("file_id", "rec_no").join(totals, "file_id")
    counted = placed.groupBy(
        "file_id", position_bin(F.col("rec_no"), F.col("total"), bins).alias("bin")
    ).agg(F.count("*").alias("n"))
    frame = totals.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counted, ["file_id", "bin"], "left").fillna(0, ["n"])


def bin_of_records(
    records: DataFrame, chosen: DataFrame, bins: int = fixed.HISTOGRAM_BINS
) -> DataFrame:
    """The bin each chosen record ``(file_id, rec_no)`` falls into."""
    return join_small(chosen, file_totals(records), ["file_id"]).select(
        "file_id", "rec_no", position_bin(F.col("rec_no"), F.col("total"), bins).alias("bin")
    )
