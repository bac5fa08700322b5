"""A session kept in a folder, with small tables that answer questions without reading its records.

Records lie in one directory for each part of a file's rows. A part is one chunk up to the 64th chunk of
a file, and twice as many chunks each time the file doubles from there, so directories grow with the logarithm of
a file's rows while none holds more than a 32nd of it. Next to the records are

* ``ids``: for every request id the chunks it occurs in, dealt into slots by a hash of the id;
* ``grams``: for every chunk a bitmap of the three-letter pieces of its lines;
* ``cells``: for every chunk the number of records of each (bucket, source), from which counts, facets,
  totals and the positions of records by rank follow;
* ``sketches``: for every file a mergeable sketch of its request ids.

Each is written once for the files of an ``add`` and merged when read, so a further file, or one taken away,
changes answers without a look at the records of the others. Questions about records first find their
chunks and then read only the directories these lie in (dynamic partition pruning), with the exact test after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.functions import fixed
from loglathe.functions.fields import let
from loglathe.operators import counts
from loglathe.operators.search import bucket_shown, matches, source_shown

#: Records of one file in one chunk, and at most in one file of a directory.
CHUNK = 1 << 20
#: A file has twice as many directories of one chunk, and as many for each further doubling.
PARTS = 32
#: Directories that request ids are dealt into.
SLOTS = 64
#: Bits of a chunk's bitmap, kept in words of 64.
GRAM_BITS = 1 << 17
PLACE = ["load", "file_id", "chunk"]
DIRECTORY = ["load", "file_id", "part"]
_TABLES = {
    "ids": "req_id string, file_id string, chunk bigint, n bigint, load string, slot int",
    "grams": "file_id string, chunk bigint, word int, bits bigint, load string",
    "cells": "file_id string, chunk bigint, bucket string, source string, n bigint, load string",
    "sketches": "file_id string, sketch binary, load string",
    "dropped": "load string, file_id string",
}


def grams_of(line: Column) -> Column:
    """The different pieces of three characters of a text, lower-cased."""
    # let: a lambda would split the text again for each of its characters
    return let(F.split(F.lower(line), ""), lambda chars: F.array_distinct(F.transform(
        F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 2, F.lit(0))),
        lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))))


def part_of(chunk: Column) -> Column:
    """The directory of a chunk: goes up with the chunk, by one for every chunk at first and ever slower later."""
    doublings = F.greatest(F.lit(0), F.length(F.bin(chunk)) - PARTS.bit_length())
    width = F.pow(F.lit(2.0), doublings).cast("bigint")
    return F.when(chunk.isNotNull(), doublings * PARTS + F.floor(chunk / width)).cast("bigint")


def _bit_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BITS))


def _slot_of(req_id: Column) -> Column:
    return F.pmod(F.xxhash64(req_id), F.lit(SLOTS)).cast("int")


@dataclass(frozen=True)
class Stored:
    """A stored session. ``chunk_rows`` must be the same for all calls on one folder."""

    spark: SparkSession
    folder: str
    chunk_rows: int = CHUNK

    # --- writing -----------------------------------------------------------------
    def add(self, records: DataFrame) -> None:
        """Store the records (with all axes and a dense ``rec_no``) of one or more files not yet in the session."""
        load = uuid.uuid4().hex
        chunk = F.floor(F.col("rec_no") / self.chunk_rows).cast("bigint")
        placed = records.withColumn("load", F.lit(load)).withColumn("chunk", chunk).withColumn("part", part_of(F.col("chunk")))
        placed.repartition("file_id", "part", F.floor(F.col("rec_no") / CHUNK)).sortWithinPartitions(
            "file_id", "part", "rec_no").write.partitionBy(*DIRECTORY).mode("append").parquet(f"{self.folder}/records")
        held = self._all_records().filter(F.col("load") == load)
        place = ["file_id", "chunk"]
        self._append("ids", held.filter("req_id <> ''").groupBy("req_id", *place).agg(F.count("*").alias("n")).withColumn(
            "slot", _slot_of(F.col("req_id"))).repartition("slot"), load, "slot")
        bit = _bit_of(F.col("gram"))
        self._append("grams", held.select(*place, F.explode(grams_of(F.col("line"))).alias("gram")).groupBy(
            *place, F.floor(bit / 64).cast("int").alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(gram), {GRAM_BITS}) % 64 as int))")).alias("bits")), load)
        self._append("cells", held.groupBy(*place, "bucket", "source").agg(F.count("*").alias("n")), load)
        self._append("sketches", held.groupBy("file_id").agg(
            F.hll_sketch_agg(F.when(F.col("req_id") != "", F.col("req_id"))).alias("sketch")), load)

    def drop(self, file_id: str) -> None:
        """Take a file out of the session: one row is written, nothing else is read or changed but its cells."""
        gone = self._table("cells").filter(F.col("file_id") == file_id).select("load", "file_id").distinct()
        gone.write.mode("append").parquet(f"{self.folder}/dropped")

    def _append(self, name: str, df: DataFrame, load: str, *by: str) -> None:
        df.withColumn("load", F.lit(load)).write.partitionBy("load", *by).mode("append").parquet(f"{self.folder}/{name}")

    # --- reading ------------------------------------------------------------------
    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _all_records(self) -> DataFrame:
        path, kinds = f"{self.folder}/records", {"load": T.StringType(), "file_id": T.StringType(), "part": T.LongType()}
        found = self.spark.read.parquet(path).schema       # names of files that look like numbers stay names
        schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])
        return self.spark.read.schema(schema).parquet(path)

    def _alive(self, df: DataFrame) -> DataFrame:
        if not self._there("dropped"):
            return df
        return df.join(self.spark.read.schema(_TABLES["dropped"]).parquet(f"{self.folder}/dropped"), ["load", "file_id"], "left_anti")

    def _table(self, name: str) -> DataFrame:
        if not self._there(name):
            return self.spark.createDataFrame([], _TABLES[name])
        return self._alive(self.spark.read.schema(_TABLES[name]).parquet(f"{self.folder}/{name}"))

    @property
    def records(self) -> DataFrame:
        return self._alive(self._all_records()).drop("load", "part", "chunk")

    def _at(self, places: DataFrame) -> DataFrame:
        """Records of some chunks; directories without any of them are not opened.

        The places are one row for each ``chunk_rows`` records at most, so they are broadcast.
        """
        places = places.select(*PLACE, part_of(F.col("chunk")).alias("part"))
        return self._all_records().join(F.broadcast(places), [*PLACE, "part"], "left_semi").drop("load", "part", "chunk")

    # --- one request id -------------------------------------------------------------
    def places_of(self, req_id: str) -> DataFrame:
        """The chunks that have records of a request id, and how many."""
        slot = self.spark.range(1).select(_slot_of(F.lit(req_id))).first()[0]
        return self._table("ids").filter((F.col("slot") == slot) & (F.col("req_id") == req_id) & (F.col("req_id") != ""))

    def trace(self, req_id: str) -> DataFrame:
        return self._at(self.places_of(req_id)).filter(F.col("req_id") == req_id)

    def trace_summary(self) -> DataFrame:
        """Rows and distinct files of every request id."""
        per_file = self._table("ids").groupBy("req_id", "file_id").agg(F.sum("n").alias("n"))
        return per_file.groupBy("req_id").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_files"))

    def distinct_requests(self) -> DataFrame:
        """About how many different request ids there are (one row, ``n``)."""
        return self._table("sketches").agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("n"))

    # --- search -------------------------------------------------------------------------
    def places_with(self, words: Sequence[str]) -> DataFrame:
        """Chunks that can have a line with all words: every three-letter piece of them is in the bitmap."""
        cells = self._table("cells").select(*PLACE).distinct()
        wanted = self.spark.createDataFrame([(w.lower(),) for w in words], "w string").select(
            F.explode(grams_of(F.col("w"))).alias("gram")).distinct()
        needed = [(r.word, r.mask) for r in wanted.select(
            F.floor(_bit_of(F.col("gram")) / 64).cast("int").alias("word"),
            F.expr(f"shiftleft(1L, cast(pmod(xxhash64(gram), {GRAM_BITS}) % 64 as int))").alias("mask")).collect()]  # pieces of the words
        masks: dict[int, int] = {}
        for word, mask in needed:
            masks[word] = masks.get(word, 0) | mask
        if not masks:
            return cells
        signed = lambda m: m - 2**64 if m >= 2**63 else m
        mask = F.coalesce(*[F.when(F.col("word") == w, F.lit(signed(m % 2**64))) for w, m in masks.items()])
        return self._table("grams").filter(F.col("word").isin(*masks)).filter(F.col("bits").bitwiseAND(mask) == mask).groupBy(
            *PLACE).agg(F.count("*").alias("n")).filter(F.col("n") == len(masks))

    def search(self, off_buckets: Sequence[str] = (), off_sources: Sequence[str] = (), **query: Sequence[str]) -> DataFrame:
        """As ``view`` over the records, reading only chunks that the words can be in."""
        found = self._at(self.places_with(query.get("words", ())))
        return found.filter(bucket_shown(off_buckets) & source_shown(off_sources) & matches(**query))

    # --- counts ---------------------------------------------------------------------------
    def metrics(self) -> DataFrame:
        """Per file: records, errors, warnings."""
        n_in = lambda b: F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0))
        return self._table("cells").groupBy("file_id").agg(
            F.sum("n").alias("filtered"), n_in("ERROR").alias("errors"), n_in("WARN").alias("warnings"))

    def facets(self, off_buckets: Sequence[str] = (), off_sources: Sequence[str] = ()) -> DataFrame:
        """Counts next to each filter switch, without a search."""
        cells = self._table("cells").groupBy("bucket", "source").agg(F.sum("n").alias("hits"))
        return counts.facets_of_cells(cells, off_buckets, off_sources)

    def source_counts(self) -> DataFrame:
        return self._table("cells").groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source") == "", F.desc("n"), "source")

    # --- positions ------------------------------------------------------------------------
    def _spans(self) -> DataFrame:
        """Every chunk with the first and last position in it and its file's total."""
        sizes = self._table("cells").groupBy(*PLACE).agg(F.sum("n").alias("n"))
        totals = sizes.groupBy("load", "file_id").agg(F.sum("n").alias("total"))
        first = F.col("chunk") * self.chunk_rows
        return sizes.join(totals, ["load", "file_id"]).select(*PLACE, "total", first.alias("first"), (first + F.col("n") - 1).alias("last"))

    def edges(self, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
        """Chunks that reach over the edge of a bin: at most ``bins`` - 1 in each file."""
        low, high = (counts.position_bin(F.col(c), F.col("total"), bins) for c in ("first", "last"))
        return self._spans().withColumns({"low": low, "high": high}).filter("low <> high")

    def histogram(self, bucket: str, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
        """Where in each file the records of one bucket lie: ``file_id, bin, n``, zeros kept.

        Chunks inside a bin count by their cells; only records of chunks over an edge are read.
        """
        spans = self._spans()
        low, high = (counts.position_bin(F.col(c), F.col("total"), bins) for c in ("first", "last"))
        inside = spans.withColumns({"bin": low, "high": high}).filter("bin = high").select(*PLACE, "bin")
        whole = self._table("cells").filter(F.col("bucket") == bucket).join(inside, PLACE).select("file_id", "bin", "n")
        over = self.edges(bins)
        totals = over.select("file_id", "total").distinct()
        read = self._at(over).filter(F.col("bucket") == bucket).select("file_id", "rec_no").join(totals, "file_id").select(
            "file_id", counts.position_bin(F.col("rec_no"), F.col("total"), bins).alias("bin"), F.lit(1).cast("bigint").alias("n"))
        counted = whole.unionByName(read).groupBy("file_id", "bin").agg(F.sum("n").alias("n"))
        frame = spans.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        return frame.join(counted, ["file_id", "bin"], "left").fillna(0, ["n"])

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of each file, from the chunks they lie in."""
        low, high = (part_of(F.lit(n // self.chunk_rows)) for n in (offset, offset + limit - 1))
        rows = self._alive(self._all_records().filter(F.col("part").between(low, high)))
        return rows.filter((F.col("rec_no") >= offset) & (F.col("rec_no") < offset + limit)).drop("load", "part", "chunk")

    def select(self, bucket: str, rank: int) -> DataFrame:
        """The record of ``bucket`` with ``rank`` (from 0) others of it before it, in each file that has one."""
        per = self._table("cells").filter(F.col("bucket") == bucket).groupBy(*PLACE).agg(F.sum("n").alias("n"))
        before = F.coalesce(F.sum("n").over(
            Window.partitionBy("load", "file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        place = per.withColumn("before", before).filter((F.col("before") <= rank) & (F.col("before") + F.col("n") > rank))
        chunk = self._all_records().filter(F.col("bucket") == bucket).join(
            F.broadcast(place.select(*PLACE, part_of(F.col("chunk")).alias("part"), "before")), [*PLACE, "part"])
        at = F.row_number().over(Window.partitionBy(*PLACE).orderBy("rec_no")) - 1 + F.col("before")
        return chunk.withColumn("_at", at).filter(F.col("_at") == rank).drop("_at", "before", "load", "part", "chunk")
