"""Sparse hashed features and the plain numpy optimiser that the text classifiers share."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.llm.base import over_texts

BITS = 18
#: Entries of a sample that are multiplied at once.
CHUNK = 1 << 16
#: ASCII signs become blanks, A-Z become a-z.
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
#: What a character looks like: letters A and a, digits 0, signs themselves.
_SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+")


def word_ids(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a whole text and how often each stands in it."""
    words = text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    return _counted(list(map(zlib.crc32, words)))


def word_and_shape_ids(text: str) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_ids``, with the shape of every word and a mark for every word that repeats the one before."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_PLAIN).split()
    plain = raw.split()
    ids = list(map(zlib.crc32, words))
    ids += [zlib.crc32(x, 1) for x in _RUN.sub(rb"\1", raw.translate(_SHAPE)).split()]
    ids += [zlib.crc32(b"same", 2)] * sum(a == b for a, b in zip(plain, plain[1:], strict=False))
    return _counted(ids)


def _counted(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    ids, n = np.unique(np.array(hashes, np.uint32) & np.uint32((1 << BITS) - 1), return_counts=True)
    return ids.astype(np.int32), n.astype(np.float32)


def damped(n: np.ndarray) -> np.ndarray:
    """Counts to values of length 1, so that long texts weigh no more than short ones."""
    x = np.log1p(n)
    return x / max(1.0, float(np.sqrt((x * x).sum())))


def share(n: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a text; of length 1 as well."""
    return np.sqrt(n / max(1.0, float(n.sum())))


class Sample:
    """Rows of a bounded sample as one sparse matrix; ids that under ``least`` of its rows have are left out.

    The driver holds it beside Spark, so entries are narrow, only those that stay are laid out, and products
    are made ``CHUNK`` entries at a time.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], least: int):
        self.size = len(rows)
        found = np.zeros(1 << BITS, np.int64)
        for ids, _ in rows:
            np.add.at(found, ids, 1)
        held = found >= least
        many = int(found[held].sum())
        self.row, self.id = np.empty(many, np.int32), np.empty(many, np.int32)
        self.value = np.empty(many, np.result_type(np.float32, *{v.dtype for _, v in rows}))
        end = 0
        for i, (ids, values) in enumerate(rows):
            stays = held[ids]
            at, end = end, end + int(stays.sum())
            self.row[at:end], self.id[at:end], self.value[at:end] = i, ids[stays], values[stays]

    def _added(self, size: int, to: np.ndarray, factors: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for at in range(0, len(to), CHUNK):
            part = slice(at, at + CHUNK)
            np.add.at(out, to[part].astype(np.intp), self.value[part] * factors[of[part]])
        return out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return self._added(self.size, self.row, weights, self.id)

    def back(self, slope: np.ndarray) -> np.ndarray:
        return self._added(1 << BITS, self.id, slope, self.row)


def adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Deterministic full-batch Adam."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def held_out() -> Column:
    """One row in five, by the CRC-32 of the decimal doc_id; its labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def first_by_hash(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of a table with doc_id, the same ones in every run."""
    order = F.xxhash64("doc_id")
    return ids.where(F.col("doc_id").isNotNull()).orderBy(order, *ids.columns).limit(most)


def sampled_features(docs: DataFrame, ids: DataFrame, features) -> list:
    """Collect the features of the documents in ``ids``, a sample of bounded size (so it may be broadcast)."""
    def make():
        def work(texts):
            pairs = [features(x) for x in texts]
            return [[i.tobytes() for i, _ in pairs], [n.tobytes() for _, n in pairs]]
        return work

    few = docs.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    made = over_texts(few, make, "ids binary, counts binary")
    # as Arrow buffers: a row's arrays are views of them, and they go back to the system as a whole
    rows = {}
    for part in made.select("doc_id", "ids", "counts").toArrow().to_batches():
        for doc, i, n in zip(*part.columns, strict=True):
            rows[doc.as_py()] = (np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.float32))
    return [(r, rows[r.doc_id]) for r in ids.collect() if r.doc_id in rows]
