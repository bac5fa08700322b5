"""Document fingerprints by Order MinHash: which rare pieces a text has, and in which order they stand."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loglathe.llm.base import STEP, column_batches, keep

#: Code points in a k-mer, k-mers in a tuple, and tuples in a signature.
K, TUPLE, HASHES = 12, 2, 32
_CHUNK = 4096
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BASE = 0x100000001B3


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(_MIX[0])) | np.uint64(1)


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """One hash for each k-mer in text order; equal k-mers are told apart by their number of occurrence."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return points
    k = min(k, len(points))
    rolled = np.zeros(len(points) - k + 1, np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(_BASE) + points[i:i + len(rolled)]
    hashes = _mixed(rolled + np.uint64(_MIX[0]))
    # the low bits carry the place, so one plain sort brings equal k-mers together in text order
    low = np.uint64((1 << max(1, int(len(hashes) - 1).bit_length())) - 1)
    packed = np.sort((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64))
    same = (packed[1:] & ~low) == (packed[:-1] & ~low)
    if same.any():
        at = np.arange(len(packed))
        first = np.where(np.concatenate([[True], ~same]), at, 0)
        number = (at - np.maximum.accumulate(first)).astype(np.uint64)
        again = number > 0
        places = (packed[again] & low).astype(np.int64)
        hashes[places] = _mixed(hashes[places] + number[again] * np.uint64(_MIX[0]))
    return hashes


def signature(text: str) -> np.ndarray:
    """HASHES slots of 32 bits: for each hash function the TUPLE least k-mers, put in text order, hashed together.

    A text shorter than a k-mer is one k-mer; the empty text has zeros. The choice goes chunk by
    chunk, so a long text needs no more memory than its k-mers.
    """
    kmers = numbered_kmers(text)
    if not len(kmers):
        return np.zeros(HASHES, np.uint32)
    best = np.zeros((HASHES, 0), np.uint64)
    place = np.zeros((HASHES, 0), np.int64)
    rows = np.arange(HASHES)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(kmers), _CHUNK):
        part = kmers[at:at + _CHUNK]
        order = part[None, :] * _FACTORS[:, None]
        for _ in range(min(TUPLE, len(part))):
            least = order.argmin(1)
            best = np.column_stack([best, order[rows, least]])
            place = np.column_stack([place, least + at])
            order[rows, least] = top
        if best.shape[1] > TUPLE:
            kept = np.argsort(best, axis=1, kind="stable")[:, :TUPLE]
            best, place = best[rows[:, None], kept], place[rows[:, None], kept]
    place.sort(axis=1)
    out = np.zeros(HASHES, np.uint64)
    for i in range(place.shape[1]):
        out = _mixed(out * np.uint64(_BASE) + kmers[place[:, i]] + np.uint64(i + 1))
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots."""
    return float((a == b).mean())


def as_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the next text's first."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


_FIELDS = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _row(text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    changed = edited(text, following)
    after = signature(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, as_text(own), as_text(after), likeness(own, after), likeness(own, other)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text (null: empty); equal texts have equal ones. No shuffle."""
    return column_batches(
        docs, ["text"], lambda: lambda texts: [[as_text(signature(x or "")) for x in texts]], "fingerprint string",
        ["doc_id"],
    )


def against_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document, and both likenesses.

    The next document is that of the next doc_id; after the last comes the first (a single
    document follows itself). Null ids come first, rows of one id go by text. Documents are
    dealt by ranges of doc_id and walked in order, one partition a task, so that each text is
    shuffled once; a partition's last document needs the first one of the next partition that has
    any, and these few are joined afterwards. Empty tables give no rows; other columns are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    made = T._parse_datatype_string(_FIELDS).fields
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("role", T.IntegerType()),
        T.StructField("doc_id", kind), T.StructField("body", T.StringType()), *made,
    ])
    arrow = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = TaskContext.get().partitionId(), None, []

        def packed():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names)

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                rows = batch.slice(at, STEP)
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    text = text or ""
                    own = signature(text)
                    if held is None:
                        out.append((part, 1, None, text, *[None] * 6))
                    else:
                        out.append((part, 0, held[0], None, *_row(held[1], held[2], text, own)))
                    held = doc_id, text, own
                if out:
                    yield packed()
                    out.clear()
        if held is not None:
            out.append((part, 2, held[0], held[1], *[None] * 6))
            yield packed()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    walked = keep(ordered.mapInArrow(walk, schema), "order-minhash")
    first = walked.where("role = 1").select(F.col("part").alias("next_part"), F.col("body").alias("following"))
    # one row for each partition that has rows
    parts = first.select(F.col("next_part").alias("part")).withColumn("one", F.lit(1))
    turn = parts.select("part", F.coalesce(
        F.lead("part").over(Window.partitionBy("one").orderBy("part")),
        F.min("part").over(Window.partitionBy("one")),
    ).alias("next_part"))
    last = walked.where("role = 2").select("part", "doc_id", "body").join(turn, "part").join(first, "next_part")

    def ends():
        def work(bodies, followings):
            rows = [_row(b, signature(b), f, signature(f)) for b, f in zip(bodies, followings, strict=True)]
            return [list(c) for c in zip(*rows, strict=True)]
        return work

    tail = column_batches(last, ["body", "following"], ends, _FIELDS, ["doc_id"])
    return walked.where("role = 0").select("doc_id", *[f.name for f in made]).unionByName(tail)
