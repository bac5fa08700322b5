"""Cutting lineage through a table in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of each local application that names none.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where none is named, a local master gets a temporary one and a cluster is refused: its
    executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="loglathe-")
        folder = _LOCAL[app]
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back. Runs a job at once.

    A table rather than ``checkpoint()``: later steps still prune columns and push filters,
    a lost executor costs a re-read, not a re-parse, and Spark knows the table's size when it
    plans: a small one is broadcast and a large one is not, without a hint.
    """
    path = f"{shared_folder(df.sparkSession)}/loglathe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
