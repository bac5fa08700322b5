"""Helpers shared by the operators: written tables, text batches, free column names, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts handed to a per-text function at once; bounds what a Python worker holds besides the batch.
STEP = 256
#: Folder of each local application that names none.
_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="llm-")
        folder = _LOCAL[app]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs a reread.

    The shuffle files of the job are removed as soon as the table is written, so phases of one
    operator do not add up on disk.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._kept_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` gave, once everything that reads them has been written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._kept_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name


def text_key() -> Column:
    """Tells different texts of one doc_id apart; a row repeated whole is one document."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def column_batches(
    df: DataFrame, inputs: list[str], make: Callable[[], Callable], fields: str, carry: list[str],
) -> DataFrame:
    """``carry`` columns as they are, plus the columns ``fields`` that a function makes of ``inputs``.

    ``make`` runs once in each task and returns a function from lists of values (one list for
    each input) to lists of results (one for each field). Rows stay where they are.
    """
    slim = df.select(*carry, *[F.col(c).alias(f"in{i}") for i, c in enumerate(inputs)])
    made = T._parse_datatype_string(fields)
    schema = T.StructType([*(slim.schema[c] for c in carry), *made.fields])
    arrow = to_arrow_schema(schema)
    held = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                out = work(*(part.column(held + i).to_pylist() for i in range(len(inputs))))
                arrays = [part.column(i) for i in range(held)]
                arrays += [pa.array(c, f.type) for c, f in zip(out, list(arrow)[held:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return slim.mapInArrow(run, schema)


def over_texts(docs: DataFrame, make: Callable[[], Callable], fields: str) -> DataFrame:
    """doc_id and what ``make()`` makes of each whole text (null: empty)."""
    def filled():
        work = make()
        return lambda texts: work(["" if x is None else x for x in texts])

    return column_batches(docs, ["text"], filled, fields, ["doc_id"])


def where_texts(docs: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whose text passes ``make()(texts) -> list of bool``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                yes = work(["" if x is None else x for x in part.column(at).to_pylist()])
                yield part.filter(pa.array([bool(x) for x in yes], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def words_of(text: str) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z lower-cased; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split()
