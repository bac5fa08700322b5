"""Text files -> numbered, decoded lines.

Files stay splittable: a line is numbered inside its file split, and one small table with
a row per split carries the line count across splits, says how the file is encoded and whether
it was read to its end. Compressed files come from ``streams``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglathe.functions import fixed
from loglathe.functions.charset import WIDE, canonical, decodable, decode_bytes, decode_wide
from loglathe.operators.materialize import cut
from loglathe.operators.ordered import CHUNK_ROWS, chunk_of, join_runs, running, with_rec_no
from loglathe.sources.streams import CODECS, codec_of, scan_packed


def scan_text(
    spark: SparkSession, paths: str | Sequence[str], skip_broken: bool = False, separator: str | None = None,
) -> DataFrame:
    """Raw lines with their file, split and position inside the split."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    if skip_broken:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    paths = [paths] if isinstance(paths, str) else list(paths)
    meta = F.col("_metadata")
    return reader.text(paths).select(
        meta["file_path"].alias("file_id"),
        meta["file_name"].alias("file_name"),
        meta["file_size"].alias("file_size"),
        meta["file_block_start"].alias("split"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("raw_line"),
    )


def candidates(encoding: str) -> list[str]:
    """Encodings to try, in order; ``auto`` means UTF-8, else windows-1251. The last one takes any bytes."""
    if encoding == "auto":
        return ["utf-8", "cp1251"]
    wanted = canonical(encoding)
    return [*([] if wanted in WIDE else [wanted]), *[e for e in map(canonical, fixed.FALLBACK_ENCODINGS) if e != wanted]]


def encoding_per_file(lines: DataFrame, encoding: str = "utf-8", by: str = "file_id") -> DataFrame:
    """One row per file: the first candidate encoding in which every line is valid."""
    names = candidates(encoding)
    ok = lines.groupBy(by).agg(*_validity(names))
    chosen = _chosen(names)
    return ok.select(by, chosen.alias("encoding"), (chosen != _wanted(encoding)).alias("fallback"))


def _wanted(encoding: str) -> str:
    return "utf-8" if encoding == "auto" else canonical(encoding)


def _validity(names: Sequence[str]) -> list[Column]:
    return [F.min(decodable(F.col("raw_line"), e)).alias(f"_ok{i}") for i, e in enumerate(names)]


def _chosen(names: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.col(f"_ok{i}"), e) for i, e in enumerate(names)], F.lit(names[-1]))


def decode_lines(lines: DataFrame, encoding: str = "utf-8", by: str = "file_id", table: DataFrame | None = None) -> DataFrame:
    """Decode ``raw_line`` file by file, adding ``encoding`` and ``fallback``.

    Works on lines, since a line feed is one byte in every charset tried here; no file is
    ever held whole. The table of encodings has one row per file and is written first, so
    Spark plans the join by its real size.
    """
    names = candidates(encoding)
    decoded = F.col("raw_line")
    for e in reversed(names):
        if not e.startswith("utf-8"):
            decoded = F.when(F.col("encoding") == e, decode_bytes(F.col("raw_line"), e)).otherwise(decoded)
    if table is None:
        table = cut(encoding_per_file(lines, encoding, by), "encodings")
    return lines.join(table, by, "left").withColumn("raw_line", decoded)


def _zero_side(raw: Column) -> Column:
    """1 where more second than first bytes of a line's first units are zero, 2 where fewer are, else 0."""
    start = raw.cast("binary")
    zeros = lambda shift: F.size(F.filter(
        F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(start, 2 * i + shift, 1) == F.lit(b"\0")))
    return F.when(~F.contains(raw, F.lit("\0")), 0).otherwise(
        F.when(zeros(2) > zeros(1), 1).when(zeros(2) < zeros(1), 2).otherwise(0))


def profile_splits(scanned: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """One row per file split, from one pass: its lines, its bytes, and what tells the file's charset."""
    raw, zero, first = F.col("raw_line"), F.lit("\0"), F.col("split") == 0
    head = F.substring(raw.cast("binary"), 1, 2)
    return scanned.groupBy("file_id", "split").agg(
        F.min("pos").alias("_from"), F.count("*").alias("_n"), F.max("file_size").alias("_size"),
        F.sum(F.octet_length(raw)).alias("_bytes"),
        F.sum(F.octet_length(raw) - F.octet_length(F.replace(raw, zero, F.lit("")))).alias("_zeros"),
        # the lowest position is that of the file's first line, the only one known to start with a whole unit
        F.min(F.when(first, F.col("pos") * 4 + _zero_side(raw))).alias("_side"),
        F.max(first & (head == F.lit(b"\xff\xfe"))).alias("_mark_le"), F.max(first & (head == F.lit(b"\xfe\xff"))).alias("_mark_be"),
        *_validity(candidates(encoding)))


def _per_file(splits: DataFrame, encoding: str) -> DataFrame:
    """``file_id, encoding, fallback, wide, error`` from the profiles of a file's splits.

    Text in two-byte units has zero bytes in its line breaks, digits, blanks and ASCII letters, on one
    side of the unit; text in any other charset has none. A file that gave fewer bytes than it has was not read to its end: a line
    takes one or two bytes more than its text, and a mark of UTF-8 at the start three.
    """
    names = candidates(encoding)
    total = lambda c: F.sum(c).alias(c)
    files = splits.groupBy("file_id").agg(
        *[total(c) for c in ("_n", "_bytes", "_zeros")], F.pmod(F.min("_side"), F.lit(4)).alias("_side"),
        *[F.max(c).alias(c) for c in ("_size", "_mark_le", "_mark_be")],
        *[F.min(f"_ok{i}").alias(f"_ok{i}") for i in range(len(names))])
    some = (F.col("_zeros") > 0) & (F.col("_zeros") * 20 >= F.col("_bytes"))
    wide = (
        F.when(F.col("_mark_le") & (F.col("_zeros") > 0), "utf-16-le").when(F.col("_mark_be") & (F.col("_zeros") > 0), "utf-16-be")
        .when(some & (F.col("_side") == 1), "utf-16-le").when(some & (F.col("_side") == 2), "utf-16-be"))
    wanted = _wanted(encoding)
    if wanted in WIDE:
        default = "utf-16-be" if wanted == "utf-16-be" else "utf-16-le"
        wide = F.coalesce(wide, F.when(F.col("_zeros") > 0, default))
    fallback = F.when(F.col("wide").isNotNull(), wanted not in WIDE).otherwise(F.col("narrow") != wanted)
    short = F.col("_bytes") + 2 * F.col("_n") + 3 < F.col("_size")
    return files.withColumn("wide", wide).withColumn("narrow", _chosen(names)).select(
        "file_id", F.coalesce("wide", "narrow").alias("encoding"), fallback.alias("fallback"), "wide",
        F.when(short, "READ_FAILED: fewer bytes than the file has").alias("error"))


def number_lines(scanned: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Add a 0-based ``line_no`` per file to ``scan_text`` rows.

    ``pos`` goes up by one inside a split, so a line's number is the lines of earlier splits plus
    its distance from the split's first line. Only a table with a row per split is shuffled; the
    lines stay where they were read.
    """
    if splits is None:
        splits = scanned.groupBy("file_id", "split").agg(F.min("pos").alias("_from"), F.count("*").alias("_n"))
    before = Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")
    offsets = cut(splits.select("file_id", "split", base.alias("_base")), "splits")
    return (
        scanned.join(offsets, ["file_id", "split"])
        .withColumn("line_no", F.col("pos") + F.col("_base"))
        .drop("split", "pos", "_base")
    )


def scan_wide(spark: SparkSession, files: Sequence[str], encoding: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Numbered, decoded lines of files in ``utf-16-le`` or ``utf-16-be``.

    Files are cut at the two bytes of a line break, so they stay splittable. Those two bytes can also
    be halves of two neighbouring characters; such a cut lies at an odd place of the file, and the
    number of bytes before a piece, a running sum, tells so. Pieces cut there are joined again.
    """
    separator = {"utf-16-le": "\n\0", "utf-16-be": "\0\n"}[encoding]
    cut_at = number_lines(scan_text(spark, files, skip_broken=True, separator=separator))
    odd = F.octet_length("raw_line").cast("bigint") % 2
    placed = running(
        cut_at.withColumn("_chunk", chunk_of(F.col("line_no"), rows)), ["file_id"], "_chunk", "line_no", sums={"_odd": odd})
    starts = F.col("_odd") % 2 == 0
    keep = ["file_id", "file_name", "file_size"]
    flagged = placed.withColumns({"_starts": starts, "_open": (F.col("_odd") + odd) % 2 == 1})
    whole = flagged.filter("_starts AND NOT _open").select(*keep, "line_no", "raw_line")
    broken = running(
        flagged.filter("NOT _starts OR _open"), ["file_id"], "_chunk", "line_no",
        maxes={"_first": F.when(F.col("_starts"), F.col("line_no"))}, inclusive=True)
    joined = join_runs(broken, keep, "_first", "line_no", "raw_line", separator=separator).withColumnRenamed("raw", "raw_line")
    text = F.regexp_replace(decode_wide(F.col("raw_line"), encoding), "\r$", "")
    text = F.when(F.col("line_no") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    lines = whole.unionByName(joined.select(whole.columns)).withColumn("raw_line", text)
    return with_rec_no(lines, name="_no").withColumn("line_no", F.col("_no")).drop("_no")


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str = "utf-8",
    skip_broken: bool = False,
) -> DataFrame:
    """``log_lines``: file_id, file_name, file_size, line_no, raw_line, encoding, fallback."""
    lines, broken = read_files(spark, listed(spark, paths), encoding)
    if not skip_broken and (first := broken.first()):
        raise OSError(f"{first.file_id}: {first.error}")
    return lines


def listed(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Names of the files under some paths, as scanned rows have them."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return [re.sub("^file:///", "file:/", x) for x in spark.read.text(paths).inputFiles()]


def read_files(
    spark: SparkSession, files: Sequence[str], encoding: str = "utf-8", codecs_by_end: dict[str, str] = CODECS,
) -> tuple[DataFrame, DataFrame]:
    """(``log_lines``, broken files) of files given by name; a broken one has ``file_id, error``.

    Compressed files are streams, one scan of each; all others are read in splits, once for the
    profile of their splits and once for the lines. Files of two-byte units are read again in their own cut.
    Lines of broken files up to the damage are among the lines.
    """
    packed = [f for f in files if codec_of(f, codecs_by_end)]
    plain = [f for f in files if not codec_of(f, codecs_by_end)]
    columns = ["file_id", "file_name", "file_size", "line_no", "raw_line", "encoding", "fallback"]
    parts, broken = [], []
    if plain:
        scanned = scan_text(spark, plain, skip_broken=True)
        splits = cut(profile_splits(scanned, encoding), "split-profiles")
        per_file = cut(_per_file(splits, encoding), "file-profiles")
        broken.append(per_file.filter("error IS NOT NULL").select("file_id", "error"))
        wide = {r.file_id: r.wide for r in per_file.filter("wide IS NOT NULL").select("file_id", "wide").collect()}  # names listed above
        narrow = per_file.filter("wide IS NULL").select("file_id", "encoding", "fallback")
        if len(wide) < len(plain):
            rest = scanned if not wide else scan_text(spark, [f for f in plain if f not in wide], skip_broken=True)
            if wide:  # other splits, other positions
                splits = rest.groupBy("file_id", "split").agg(F.min("pos").alias("_from"), F.count("*").alias("_n"))
            parts.append(decode_lines(number_lines(rest, splits), encoding, table=narrow))
        for name in sorted(set(wide.values())):
            lines = scan_wide(spark, [f for f in plain if wide.get(f) == name], name)
            parts.append(lines.join(per_file.select("file_id", "encoding", "fallback"), "file_id"))
    if packed:
        stream = cut(scan_packed(spark, packed, codecs_by_end), "packed")
        broken.append(stream.filter("error IS NOT NULL").select("file_id", "error"))
        lines = stream.filter("error IS NULL").drop("error")
        narrow = decode_lines(lines.filter("wide IS NULL").drop("wide"), encoding)
        parts.append(narrow)
        parts.append(lines.filter("wide IS NOT NULL").withColumn("encoding", F.col("wide")).withColumn(
            "fallback", F.lit(_wanted(encoding) not in WIDE)).drop("wide"))
    if not parts:
        empty = spark.createDataFrame(
            [], "file_id string, file_name string, file_size bigint, line_no bigint, raw_line string, encoding string, fallback boolean")
        return empty, spark.createDataFrame([], "file_id string, error string")
    return (reduce(DataFrame.unionByName, [p.select(columns) for p in parts]), reduce(DataFrame.unionByName, broken))


def split_texts(
    texts: DataFrame, text: str, file_id: Column, order: Column, stride: int = 1 << 20
) -> DataFrame:
    """Texts held in a table -> ``log_lines``, one file per ``file_id``.

    ``order`` is a unique integer per text. ``line_no`` is ``order * stride`` plus the line's
    position in its text: unique and increasing, not dense. A text with more than ``stride``
    lines is an error.
    """
    pieces = F.split(F.col(text), r"\r\n|\n|\r")
    fits = F.when(F.size(pieces) <= stride, pieces).otherwise(
        F.raise_error(F.lit(f"a text has more than {stride} lines")).cast("array<string>")
    )
    return texts.select(
        file_id.alias("file_id"), order.alias("_order"), F.posexplode(fits).alias("_at", "raw_line")
    ).select(
        "file_id",
        (F.col("_order") * F.lit(stride) + F.col("_at")).cast("bigint").alias("line_no"),
        "raw_line",
    )


def without_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("raw_line").rlike(r"^\s*$"))
