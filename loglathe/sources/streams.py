"""Compressed log files as a Python data source: a damaged file ends in a row that says so.

A compressed file can't be split, so a task reads each from end to end whatever the reader. Spark's
own text reader either fails the job at the first damaged file or keeps what it got without a word.
Here every file is a stream of numbered lines, and whatever ends it early becomes one row with
``error`` set, after the lines read so far; the other files go on. Files are opened with Arrow's file
systems, so paths are those of local folders, S3, GCS or HDFS.
"""

from __future__ import annotations

import bz2
import codecs
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How a file is packed, by the end of its name.
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
CHUNK, LINES = 1 << 20, 8192
#: Tasks of one scan; more files than that share tasks.
MAX_TASKS = 10_000
SCHEMA = ("file_id string, file_name string, file_size bigint, line_no bigint, raw_line binary, wide string, "
          "error string")


class DamagedFile(Exception):
    """What is in a file is not what its name says, or ends too early."""


def codec_of(path: str, codecs_by_end: dict[str, str] = CODECS) -> str | None:
    return next((c for end, c in codecs_by_end.items() if path.lower().endswith(end)), None)


def open_raw(path: str):
    """(stream of the bytes as stored, size)."""
    if path.startswith("file:") or "://" not in path:
        system, inner = fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", path))
    else:
        system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return system.open_input_stream(inner, compression=None), info.size


def unpacked(stream, codec: str) -> Iterator[bytes]:
    """Plain bytes of a packed stream, several packed parts one after another included."""
    def fresh():
        if codec == "gzip":
            return zlib.decompressobj(31)
        if codec == "bz2":
            return bz2.BZ2Decompressor()
        import zstandard
        return zstandard.ZstdDecompressor().decompressobj()

    part, begun = fresh(), False
    while packed := stream.read(CHUNK):
        while packed:
            begun = True
            try:
                plain = part.decompress(packed)
            except Exception as e:  # each library has an error class of its own
                raise DamagedFile(f"not {codec} data: {e}") from e
            if plain:
                yield plain
            packed = b""
            if part.eof:
                packed, part, begun = part.unused_data, fresh(), False
    if begun:
        raise DamagedFile(f"the {codec} data ends too early")


def wide_of(head: bytes) -> str | None:
    """UTF-16 by its mark, or by zero bytes on one side of nearly every unit that has any."""
    for mark, name in ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if head.startswith(mark):
            return name
    even, odd = head[::2].count(0), head[1::2].count(0)
    if 20 * max(even, odd) < len(head) or 10 * min(even, odd) > max(even, odd):
        return None
    return "utf-16-le" if odd > even else "utf-16-be"


def as_utf8(chunks: Iterable[bytes]) -> Iterator[tuple[bytes, str | None]]:
    """Chunks with the charset found at the start; text of two-byte units becomes UTF-8."""
    decoder, wide, first = None, None, True
    for chunk in chunks:
        if first:
            first, wide = False, wide_of(chunk[:65536])
            decoder = codecs.getincrementaldecoder(wide)("replace") if wide else None
            text = decoder.decode(chunk).removeprefix("﻿") if decoder else None
            chunk = text.encode("utf-8", "replace") if decoder else chunk.removeprefix(codecs.BOM_UTF8)
        elif decoder:
            chunk = decoder.decode(chunk).encode("utf-8", "replace")
        yield chunk, wide
    if decoder and (rest := decoder.decode(b"", True)):
        yield rest.encode("utf-8", "replace"), wide


def lines_of(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Lines between line feeds, carriage returns or both, as Spark's text reader cuts them."""
    held: list[bytes] = []
    for chunk in chunks:
        if held and held[-1].endswith(b"\r"):              # its line feed may come now
            chunk, held = held[-1] + chunk, held[:-1]
        pieces = chunk.splitlines(keepends=True)
        if not pieces:
            continue
        if len(pieces) == 1 and not pieces[0].endswith(b"\n"):
            held.append(pieces[0])
            continue
        pieces[0], held = b"".join([*held, pieces[0]]), []
        if not pieces[-1].endswith(b"\n"):
            held = [pieces.pop()]
        yield from (x.rstrip(b"\r\n") if x.endswith(b"\r\n") else x[:-1] for x in pieces)
    if held:
        last = b"".join(held)
        yield last[:-1] if last.endswith(b"\r") else last


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], codecs_by_end: dict[str, str]):
        self.files, self.codecs = files, codecs_by_end

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.files[i::MAX_TASKS]) for i in range(min(MAX_TASKS, len(self.files)))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.value:
            yield from self._file(path)

    def _file(self, path: str) -> Iterator[pa.RecordBatch]:
        name, size, at, wide = unquote(path.rsplit("/", 1)[-1]), None, 0, None

        def batch(lines: list[bytes | None], error: str | None = None) -> pa.RecordBatch:
            n = len(lines)
            numbers = [None] if error else range(at, at + n)
            columns = [[path] * n, [name] * n, [size] * n, numbers, lines, [wide] * n, [error] * n]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        try:
            stream, size = open_raw(path)
            with stream:
                some: list[bytes] = []

                def plain():
                    nonlocal wide
                    for chunk, found in as_utf8(unpacked(stream, codec_of(path, self.codecs) or "gzip")):
                        wide = found
                        yield chunk

                for line in lines_of(plain()):
                    some.append(line)
                    if len(some) == LINES:
                        yield batch(some)
                        at, some = at + LINES, []
                if some:
                    yield batch(some)
        except DamagedFile as e:
            yield batch([None], f"DAMAGED_FILE: {e}")
        except FileNotFoundError:
            yield batch([None], "PATH_NOT_FOUND")
        except OSError as e:
            yield batch([None], f"READ_FAILED: {e}")


class LineStreams(DataSource):
    """Options: ``files``, a JSON list of paths, and ``codecs``, a JSON object from name ends to codecs."""

    @classmethod
    def name(cls) -> str:
        return "packed_log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["files"]), json.loads(self.options["codecs"]))


def scan_packed(spark: SparkSession, files: list[str], codecs_by_end: dict[str, str] = CODECS) -> DataFrame:
    """Numbered lines of compressed files, and one row with ``error`` for each that could not be read to its end."""
    spark.dataSource.register(LineStreams)
    rows = spark.read.format(LineStreams.name()).options(
        files=json.dumps(files), codecs=json.dumps(codecs_by_end)).load()
    return rows.withColumn("raw_line", F.col("raw_line").cast("string"))
