"""CSV logs whose quoted fields may hold line breaks, read without giving up file splits.

Every line is a step of a machine with two states, at the start of a record or inside quotes, and
steps compose along chunks like any running value, so records are found in parallel. Each file
has its own header; rows become field maps, with ``col_N`` for cells beyond the header.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.operators.materialize import cut
from loglathe.operators.ordered import CHUNK_ROWS, chunk_of, join_runs, running, running_state


_CLOSED = r'"[^"]*+(?:""[^"]*+)*+"'


def _line_steps(line: Column, sep: str) -> dict[str, Column]:
    """What a line does, read from the start of a record and read from inside quotes.

    ``_open0``, ``_open1``: whether a quoted cell is open after it; ``_seps0``, ``_seps1``: separators
    outside quotes; ``_rough``: the quote that closes has neither a separator nor the end behind it. A quote opens a cell only where the cell starts; elsewhere it is a character.
    """
    s = re.escape(sep)
    cells = rf"(?:(?:{_CLOSED}[^{s}]*+|(?!\")[^{s}]*+){s})*+"
    left_open = rf'\A{cells}"[^"]*+(?:""[^"]*+)*+\z'
    quoted, close = F.contains(line, F.lit('"')), rf'\A[^"]*+(?:""[^"]*+)*+"[^{s}]*+'
    count = lambda text: (F.size(F.regexp_extract_all(text, F.lit(_cell_pattern(sep)), F.lit(0))) - 1).cast("bigint")
    rest = F.regexp_replace(line, close, "")
    closes = quoted & line.rlike(close)
    plain = (F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit("")))).cast("bigint")
    return {
        "_open0": quoted & line.rlike(left_open),
        "_open1": ~closes | rest.rlike(left_open),
        "_rough": quoted & line.rlike(rf'\A[^"]*+(?:""[^"]*+)*+"(?!{s}|\z)'),
        "_seps0": F.when(quoted, count(F.regexp_replace(line, rf'(\A{cells})"[^"]*+(?:""[^"]*+)*+\z', "$1"))).otherwise(plain),
        "_seps1": F.when(closes, count(F.regexp_replace(rest, rf'(\A{cells})"[^"]*+(?:""[^"]*+)*+\z', "$1"))).otherwise(F.lit(0).cast("bigint")),
    }


def _runs(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines with ``_starts`` (a record starts here), ``_open`` (it goes on) and ``_first`` (its first line, where it has several)."""
    tracked = running_state(lines, by, "_chunk", "line_no", F.col("_open0"), F.col("_open1"))
    inside = F.col("_state") == 1
    flagged = tracked.withColumns({
        "_starts": ~inside, "_open": F.when(inside, F.col("_open1")).otherwise(F.col("_open0")),
        "_seps": F.when(inside, F.col("_seps1")).otherwise(F.col("_seps0")), "_amid": inside & F.col("_rough"),
    }).drop("_state")
    single = flagged.filter("_starts AND NOT _open").withColumn("_first", F.lit(None).cast("bigint"))
    # Only lines of multi-line records need the record's first line; they are few.
    several = running(
        flagged.filter("NOT _starts OR _open"), by, "_chunk", "line_no",
        maxes={"_first": F.when(F.col("_starts"), F.col("line_no"))}, inclusive=True)
    return single.unionByName(several)


def assemble_csv(lines: DataFrame, rows: int = CHUNK_ROWS, sep: str = ",") -> DataFrame:
    """Lines -> one row per CSV record: ``file_id, file_name?, line_no, cont, raw``.

    Whether a line is inside quotes follows from the lines before it by a two-state machine. A record over
    several lines that has other than the header's number of cells, a quote that closes amid a cell, or no
    end is damaged; then every line that is not part of a sound record and has the header's number of
    cells starts afresh, so only the damaged record differs.
    """
    keep = [c for c in ("file_id", "file_name") if c in lines.columns]
    stepped = lines.select(*keep, "line_no", "raw_line").withColumns({
        "_chunk": chunk_of(F.col("line_no"), rows), **_line_steps(F.col("raw_line"), sep)})
    filled = ~F.col("raw_line").rlike(r"^\s*$")
    # written, so that the patterns above run once
    first = cut(_runs(stepped, ["file_id"]), "csv-lines")
    heads = first.filter(filled).groupBy("file_id").agg(F.min("line_no").alias("line_no"))
    widths = cut(first.join(cut(heads, "csv-heads"), ["file_id", "line_no"]).select(
        "file_id", F.when(~F.col("_open0"), F.col("_seps0")).alias("_width")).filter("_width > 0"), "csv-widths")
    # one row for each record of several lines; a damaged one has another width than the header and a line that could start afresh
    afresh = (F.col("line_no") > F.col("_first")) & (F.col("_seps0") == F.col("_width"))
    odd = (F.col("_endless") == 1) | (F.col("_seps") != F.col("_width")) | F.col("_amid")
    several = cut(first.filter("_first IS NOT NULL").join(widths, "file_id").groupBy("file_id", "_first").agg(
        F.sum("_seps").alias("_seps"), F.max("_width").alias("_width"), F.min(F.col("_open").cast("int")).alias("_endless"),
        F.max("_amid").alias("_amid"), F.max(afresh).alias("_afresh")).select(
        "file_id", "_first", (F.col("_afresh") & odd).alias("_bad")), "csv-runs")
    damaged = several.filter("_bad").select("file_id").distinct()
    if damaged.isEmpty():
        placed = first
    else:
        # every file without damage is left as it is
        placed = first.join(damaged, "file_id", "left_anti").unionByName(
            _afresh(first.join(damaged, "file_id", "left_semi"), several, widths))
    single = placed.filter("_first IS NULL").select(*keep, "line_no", F.lit(0).alias("cont"), F.col("raw_line").alias("raw"))
    joined = join_runs(placed.filter("_first IS NOT NULL"), keep, "_first", "line_no", "raw_line")
    return single.unionByName(joined).filter(~F.col("raw").rlike(r"^\s*$"))


def _afresh(first: DataFrame, several: DataFrame, widths: DataFrame) -> DataFrame:
    """Records of damaged files: lines of the header's width outside sound records start a new count."""
    sound = several.filter("NOT _bad").select("file_id", "_first", F.lit(True).alias("_sound"))
    marked = first.join(widths, "file_id").join(sound, ["file_id", "_first"], "left")
    inner = F.col("_sound").isNotNull() & (F.col("_first") < F.col("line_no"))
    fresh = ((F.col("_seps0") == F.col("_width")) & ~inner).cast("bigint")
    parted = cut(running(
        marked.withColumn("_fresh", fresh), ["file_id"], "_chunk", "line_no", sums={"_part": F.col("_fresh")}, inclusive=True
    ).drop("_fresh", "_width", "_sound", "_first", "_starts", "_open", "_seps", "_amid"), "csv-parts")
    return _runs(parted, ["file_id", "_part"]).drop("_part").select(first.columns)


def _cell_pattern(sep: str) -> str:
    s = re.escape(sep)
    return rf'\G(?:^|{s})(?:{_CLOSED}[^{s}]*+|[^{s}]*+)'


def cells_of(record: Column, sep: str = ",") -> Column:
    """Cells of one CSV record, with outer quotes removed and doubled quotes undone.

    Every cell is kept: what follows a closing quote belongs to its cell, a quote inside an
    unquoted cell is a character, and a quote that is never closed is one as well.
    """
    whole = F.regexp_extract_all(record, F.lit(_cell_pattern(sep)), F.lit(0))
    return F.transform(whole, lambda c, i: _cell(F.when(i == 0, c).otherwise(F.substr(c, F.lit(2)))))


_QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$'


def _cell(cell: Column) -> Column:
    inner = F.replace(F.regexp_extract(cell, _QUOTED, 1), F.lit('""'), F.lit('"'))
    return F.when(
        cell.rlike(_QUOTED), F.concat(inner, F.regexp_extract(cell, _QUOTED, 2))
    ).otherwise(cell)


def _names(header: Column) -> Column:
    """Names of the columns; one that is empty or was there before is called by its place."""
    return F.transform(header, lambda c, i: F.when(
        (c != "") & (F.array_position(header, c) == i + 1), c
    ).otherwise(F.concat(F.lit("col_"), (i + 1).cast("string"))))


def csv_records(records: DataFrame, sep: str = ",") -> DataFrame:
    """Assembled CSV records -> ``fields``; the header row of each file goes."""
    first = records.groupBy("file_id").agg(F.min("line_no").alias("line_no"))
    # one row per file, written so that Spark plans the joins by its real size
    headers = cut(records.join(cut(first, "csv-first"), ["file_id", "line_no"], "left_semi").select(
        "file_id", F.col("line_no").alias("_first_line"), _names(cells_of(F.col("raw"), sep)).alias("_header")
    ), "csv-headers")
    named = F.transform(
        F.col("_cells"),
        lambda c, i: F.struct(
            F.coalesce(F.get(F.col("_header"), i), F.concat(F.lit("col_"), (i + 1).cast("string"))).alias("key"),
            c.cast("variant").alias("value"),
        ),
    )
    return (
        records.join(headers, "file_id")
        .filter(F.col("line_no") > F.col("_first_line"))
        .withColumn("_cells", cells_of(F.col("raw"), sep))
        .withColumn("fields", F.map_from_entries(named))
        .drop("_first_line", "_cells", "_header")
    )


def read_csv_logs(lines: DataFrame, sep: str = ",", rows: int = CHUNK_ROWS) -> DataFrame:
    """``log_lines`` of CSV files -> ``log_records`` with ``format = 'csv'``."""
    return csv_records(cut(assemble_csv(lines, rows, sep), "csv"), sep).withColumn("format", F.lit("csv"))
