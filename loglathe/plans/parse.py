"""Files or lines -> records with axes: the whole chain, cut by written tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglathe.functions.axes import with_axes
from loglathe.operators.counts import run_report, unexpanded_count
from loglathe.operators.materialize import cut
from loglathe.operators.multiline import assemble_multiline, trace_to_record
from loglathe.operators.normalize import normalize_export
from loglathe.operators.ordered import with_rec_no
from loglathe.operators.report import diagnostics, full_report
from loglathe.operators.rewrite import bind_sql, expand_message, strip_ansi, strip_k8s
from loglathe.operators.search import filter_levels
from loglathe.operators.windows import cap, cap_signal, dedup
from loglathe.options import ParseOptions
from loglathe.ship import ship
from loglathe.sources.csv import read_csv_logs
from loglathe.sources.detect import OBJECT_LINE, TEXT_FORMATS, detect_format
from loglathe.sources.json import read_json_logs
from loglathe.sources.lines import read_files
from loglathe.sources.streams import CODECS


@dataclass(frozen=True)
class Parsed:
    """Results of one run. Lines and records are written tables; the reports over them are lazy.

    ``continuations`` (``file_id, line_no, part, cont, raw``) has what very long records go on with: their
    ``raw`` ends after a fixed number of lines, and ``line_no`` and ``part`` say which record goes on.
    """

    lines: DataFrame
    formats: DataFrame
    records: DataFrame
    report: DataFrame
    continuations: DataFrame

    @property
    def diagnostics(self) -> DataFrame:
        return diagnostics(self.report)


def _records_of(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Each file goes through the reader of its format; formats has one row per file.

    A mixed file has lines of its own that are JSON objects besides other lines. It is read as text, where a
    line of JSON ends a trace like any other line; then its JSON lines go on to the JSON reader.
    """
    tagged = lines.join(formats.select("file_id", "format", "mixed"), "file_id")
    columns = ["file_id", "line_no", "part", "cont", "raw", "fields"]
    whole, nothing = F.lit(0).alias("part"), F.from_json(F.lit("{}"), "map<string,variant>")
    text = assemble_multiline(tagged.filter(F.col("format").isin(*TEXT_FORMATS) & ~F.col("mixed")))
    parts = [text]
    if not formats.filter("mixed").isEmpty():
        mixed = cut(assemble_multiline(tagged.filter("mixed")), "mixed")
        is_json = (F.col("kind") == "text") & F.col("raw").rlike(OBJECT_LINE)
        parts = [text.unionByName(mixed.filter(~is_json))]
        parts.append(read_json_logs(mixed.filter(is_json).withColumnRenamed("raw", "raw_line"), layout="lines"))
    csv = read_csv_logs(tagged.filter(F.col("format") == "csv"))
    json = read_json_logs(tagged.filter(F.col("format").isin("json", "jsonl") & ~F.col("mixed")))
    records = [trace_to_record(parts[0]).select("file_id", "line_no", whole, F.lit(0).alias("cont"), "raw", "fields")]
    records += [df.select(columns) for df in (*parts[1:], json)]
    records.append(csv.select("file_id", "line_no", whole, "cont", "raw", "fields"))
    further = parts[0].filter("cont > 0").select("file_id", "line_no", whole, "cont", "raw", nothing.alias("fields"))
    return reduce(DataFrame.unionByName, [*records, further])


def parse_lines(
    lines: DataFrame, options: ParseOptions = ParseOptions(), files: DataFrame | None = None
) -> Parsed:
    """``log_lines`` -> :class:`Parsed`.

    Numbered lines, parsed records and finished records are each used several times and written
    to the shared folder: parse, write, drop repeats, number, add the axes, write. Axes follow
    from the fields alone, so they are computed last and never shuffled.
    ``files`` (``file_id, file_ord, error``) names the files that were asked for, in session
    order: each gets a row in the report, and ``file_ord`` goes to the records.
    """
    ship(lines.sparkSession)
    lines = cut(lines, "lines")
    formats = cut(detect_format(lines), "formats")
    source = lines
    if options.remove_ansi:
        source = source.withColumn("raw_line", strip_ansi(F.col("raw_line")))
    records = _records_of(source, formats)
    if options.expand_message:
        records = expand_message(records)
    records = normalize_export(records)
    if options.bind_sql_args:
        records = bind_sql(records)
    if options.strip_k8s:
        records = strip_k8s(records)
    order = ["line_no", "part"]
    parsed = cut(records, "parsed")
    records, further = parsed.filter("cont = 0").drop("cont"), parsed.filter("cont > 0").drop("fields")
    if options.remove_duplicates:
        records = dedup(records, order=order)
    if options.log_levels:
        records = filter_levels(with_axes(records, "level"), options.log_levels).drop("level")
    numbered = with_axes(with_rec_no(records, order=order))
    if files is not None:
        numbered = numbered.join(files.select("file_id", "file_ord"), "file_id", "left")
    records = cut(numbered, "records")
    kept = records if options.cap is None else cap(records, options.cap)
    signal = None if options.cap is None else cap_signal(records, options.cap)
    encodings = None
    if "encoding" in lines.columns:
        encodings = lines.select("file_id", "encoding", "fallback").distinct()  # one row for each file, without a sort
    failed = None if files is None else files.filter("error IS NOT NULL")
    counted = run_report(lines, kept)
    if files is not None:
        counted = counted.join(files.filter("error IS NULL").select("file_id"), "file_id", "full")
    report = full_report(
        counted, formats=formats, encodings=encodings, capped=signal,
        unexpanded=unexpanded_count(kept), failed=failed,
    )
    return Parsed(lines, formats, kept, report, further)


def requested_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file_id, file_ord, error`` of every file under the paths, empty ones too, in session order.

    Only listed, not read: the names are those the driver's file index holds for the scan anyway
    (a scan itself leaves empty files out). A path that can't be listed is a row of its own with
    Spark's error class.
    """
    listed = []
    for i, path in enumerate(paths):
        try:
            names = spark.read.text(path).inputFiles()  # file:///x is file:/x in the metadata of scanned rows
            listed += [(re.sub("^file:///", "file:/", name), i, None) for name in names]
        except AnalysisException as e:
            listed.append((path, i, e.getCondition() or "READ_FAILED"))
    every = spark.createDataFrame(listed, "file_id string, _path int, error string")
    order = Window.partitionBy(F.lit(0)).orderBy("_path", "file_id")  # a row per file
    return every.groupBy("file_id").agg(F.min("_path").alias("_path"), F.max("error").alias("error")).select(
        "file_id", (F.row_number().over(order) - 1).alias("file_ord"), "error")


def parse_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    options: ParseOptions = ParseOptions(),
    keep_partial: bool = False,
    codecs: Mapping[str, str] = CODECS,
) -> Parsed:
    """Log files -> :class:`Parsed`, with a report row for every file asked for.

    A path that isn't there, and a file that can't be read to its end, is reported as an error; the
    other files go on. A broken file has no records, or with ``keep_partial`` those before the damage;
    its status is ``error`` either way. ``codecs`` says by the end of a name how a file is packed.
    """
    ship(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = cut(requested_files(spark, paths), "files")
    there = [r.file_id for r in files.filter("error IS NULL").select("file_id").collect()]  # the names listed just now
    lines, broken = read_files(spark, there, options.encoding, dict(codecs))
    broken = cut(broken, "broken-files")
    if not broken.isEmpty():
        files = cut(files.join(broken.withColumnRenamed("error", "_error"), "file_id", "left").select(
            "file_id", "file_ord", F.coalesce("error", "_error").alias("error")), "files")
        if not keep_partial:
            lines = lines.join(broken.select("file_id"), "file_id", "left_anti")
    return parse_lines(lines, options, files)
