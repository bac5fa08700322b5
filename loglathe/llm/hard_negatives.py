"""Hard negatives by segment summaries.

A vector's components become integers, floor(256 x), and are summarised at several levels: each
level cuts them into segments and stores the mean and the deviation (the length of what is left
when the mean is taken off) of every segment. For two vectors and one segment of w components the
inner product is w * mean * mean give or take deviation * deviation, so the sums over segments
bound the score. Levels go from one segment to ever shorter ones; a pair that the bounds at one
level rule out is not looked at again, and only pairs left after the last level get exact scores.

Anchors meet all rows in blocks: rows are dealt into parts, and every part gets all anchors, in
batches. A part keeps its own best few for each anchor, and a window picks among the parts' few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglathe.llm.base import keep

#: Components of a segment at each level; the first level is the whole vector.
WIDTHS = (None, 16, 4)
ROWS_PER_PART, MAX_PARTS = 8192, 4096
#: Anchors and rows that are compared at once in a task.
ANCHORS, TILE = 256, 2048
#: Components beyond this are held at it, so that scores of up to 128 components fit 64 bits.
BIGGEST = 1 << 28
POSITIVES, NEGATIVES = 5, 10


class Summaries:
    """Integer vectors of one length with the scaled means and the deviations of their segments."""

    def __init__(self, vectors: np.ndarray, widths=WIDTHS):
        self.exact = vectors                                   # int64
        self.plain = vectors.astype(np.float64)
        self.most = int(np.abs(vectors).max(initial=0))
        self.norm = np.sqrt((self.plain ** 2).sum(1))
        self.levels = [self._level(w or max(1, vectors.shape[1])) for w in widths]

    def _level(self, width: int):
        cuts = np.arange(0, max(1, self.plain.shape[1]), width)
        sizes = np.diff([*cuts, max(1, self.plain.shape[1])])
        if not self.plain.shape[1]:
            return np.zeros((len(self.plain), 1)), np.zeros((len(self.plain), 1))
        sums, squares = (np.add.reduceat(x, cuts, axis=1) for x in (self.plain, self.plain ** 2))
        # the mean times the root of the segment's size: the product of two is size * mean * mean
        return sums / np.sqrt(sizes), np.sqrt(np.maximum(squares - sums ** 2 / sizes, 0))

    def take(self, at) -> Summaries:
        part = object.__new__(Summaries)
        part.exact, part.plain, part.norm, part.most = self.exact[at], self.plain[at], self.norm[at], self.most
        part.levels = [(m[at], d[at]) for m, d in self.levels]
        return part


def _bounds(a: Summaries, b: Summaries, level: int, pairs=None):
    """Least and greatest possible scores: of all pairs, or of the pairs (i, j) given."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    if pairs is None:
        mid, off = ma @ mb.T, da @ db.T
        off += 1e-6 + 1e-9 * np.outer(a.norm, b.norm)          # rounding must not rule out a pair
    else:
        i, j = pairs
        mid, off = np.einsum("ps,ps->p", ma[i], mb[j]), np.einsum("ps,ps->p", da[i], db[j])
        off += 1e-6 + 1e-9 * a.norm[i] * b.norm[j]
    return mid - off, mid + off


def _scores(a: Summaries, b: Summaries, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of pairs."""
    if not len(i):
        return np.empty(0, np.int64)
    exact = a.most * b.most * max(1, a.plain.shape[1]) < 1 << 53
    x, y = (a.plain, b.plain) if exact else (a.exact, b.exact)
    if 8 * len(i) > len(x) * len(y):
        return (x @ y.T)[i, j].astype(np.int64)
    return np.einsum("pd,pd->p", x[i], y[j]).astype(np.int64)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; minus infinity where a row has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Best:
    """The ``k`` best (score, smaller id first) of each of ``n`` slots."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot, "left")
        rank = np.arange(len(slot)) - first
        stay = rank < self.k
        full = rank == self.k - 1
        self.floor[slot[full]] = score[full]
        self.slot, self.score, self.id = slot[stay], score[stay], ids[stay]


def search(anchors: Summaries, rows: Summaries, ids: np.ndarray, allowed: np.ndarray,
           low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """The ``k`` best rows with low <= score <= high of each slot; an anchor has ``low.shape[1]`` slots.

    ``allowed`` tells which pairs count at all. A pair stays as long as for some slot its bounds
    can lie in the slot's range and reach the k-th best found so far or known to be there.
    """
    n, slots = low.shape
    best = Best(n * slots, k)
    for lo in range(0, len(ids), TILE):
        part, alive = rows.take(slice(lo, lo + TILE)), allowed[:, lo:lo + TILE].copy()
        pairs, floor = None, np.maximum(low, best.floor.reshape(n, slots))
        for level in range(len(anchors.levels)):
            least, most = _bounds(anchors, part, level, pairs)
            if pairs is None:
                reach = np.zeros_like(alive)
                for s in range(slots):
                    sure = alive & (least >= low[:, s, None]) & (most <= high[:, s, None])
                    floor[:, s] = np.maximum(floor[:, s], _kth(np.where(sure, least, -np.inf), k))
                    reach |= (most >= floor[:, s, None]) & (least <= high[:, s, None])
                alive &= reach
                if 8 * alive.sum() < alive.size:               # few are left: go on with a list of pairs
                    pairs = np.nonzero(alive)
            else:
                i, j = pairs
                reach = ((most[:, None] >= floor[i]) & (least[:, None] <= high[i])).any(1)
                pairs = i[reach], j[reach]
        i, j = np.nonzero(alive) if pairs is None else pairs
        score = _scores(anchors, part, i, j)
        for s in range(slots):
            fits = (score >= low[i, s]) & (score <= high[i, s])
            best.add(i[fits] * slots + s, score[fits], ids[lo:lo + TILE][j[fits]])
    return best


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    out = np.zeros((len(column), length), np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _meet(rows: DataFrame, anchors: DataFrame, parts: int, length: int, same: bool, k: int) -> DataFrame:
    """(anchor_id, slot, id, score): every part's best ``k`` for every anchor's slots.

    ``rows`` has id, label, v; ``anchors`` also lows and highs, the ranges of its slots.
    """
    dealt = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "label", "v",
        F.expr("cast(null as array<double>)").alias("lows"), F.expr("cast(null as array<double>)").alias("highs"))
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "label", "v",
        "lows", "highs")
    schema = "anchor_id long, slot int, id long, score long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting = None, None, []
        for batch in batches:
            part, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if lo == hi:
                    continue
                piece = batch.slice(lo, hi - lo)
                ids, labels = (piece.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                vectors = _vectors(piece.column(4), length)
                if part[lo] != at:
                    at, held, waiting = part[lo], None, []
                if kind[lo] == 0:
                    waiting.append((ids, labels, vectors))
                    continue
                if held is None:
                    if not waiting:
                        continue
                    own = [np.concatenate(x) for x in zip(*waiting, strict=True)]
                    held, waiting = (own[0], own[1], Summaries(own[2])), []
                lows, highs = (np.stack([np.asarray(x, float) for x in piece.column(i).to_pylist()]) for i in (5, 6))
                for a in range(0, len(ids), ANCHORS):
                    some = slice(a, a + ANCHORS)
                    like = labels[some, None] == held[1][None, :]
                    allowed = (like if same else ~like) & (ids[some, None] != held[0][None, :])
                    best = search(Summaries(vectors[some]), held[2], held[0], allowed, lows[some], highs[some], k)
                    slots = lows.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[some][best.slot // slots], pa.int64()), pa.array(best.slot % slots, pa.int32()),
                        pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())], names=names)

    together = dealt.unionByName(asked).repartitionById(parts, F.col("part"))
    return together.sortWithinPartitions("part", "kind").mapInArrow(run, schema)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best ``k`` among the parts' best."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _filled(name: str, none: float, slots: int) -> Column:
    """One end of the ranges in ``r``, with ``none`` for slots that aren't there."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.try_element_at(F.col("r"), i + 1)[name], F.lit(none)))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and embedding; a row without an id, a label or a vector, or with a
    null or non-finite component, takes no part. Of rows that share an id, the least (label,
    vector) counts. Vectors of different length are compared over the components both have. Ties
    go to the smaller id. A negative has another label, and its score lies between ``least`` and
    ``most`` hundredths of the positive's. Anchors without a positive, and pairs without a
    negative, give no row; an empty table gives none.
    """
    whole = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    ints = F.transform("embedding", lambda x: F.greatest(
        F.least(F.floor(F.lit(256.0) * x.cast("double")), F.lit(BIGGEST)), F.lit(-BIGGEST)).cast("int"))
    valid = rows.withColumn("_asks", is_anchor).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~whole)
    one = valid.groupBy(F.col("vec_id").cast("long").alias("id")).agg(
        F.min(F.struct(F.col("label").cast("long").alias("label"), ints.alias("v"), "_asks")).alias("r"))
    held = keep(one.select("id", "r.label", "r.v", F.col("r._asks").alias("asks")), "negatives-rows")
    n, length = held.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = max(1, min(MAX_PARTS, -(-n // ROWS_PER_PART)))
    anywhere = [F.array(F.lit(x)).alias(c) for x, c in ((float("-inf"), "lows"), (float("inf"), "highs"))]
    anchors = held.where("asks")
    near = _meet(held, anchors.select("*", *anywhere), parts, length or 0, True, positives)
    first = keep(_ranked(near, ["anchor_id"], positives).select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        (F.col("rank") - 1).alias("slot")), "negatives-positives")
    # a slot for each positive, in their order; slots that an anchor lacks hold nothing
    score = F.col("positive_score").cast("double")
    ranges = first.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(
        "slot", (score * least / 100).alias("low"), (score * most / 100).alias("high")))).alias("r"))
    filled = [_filled(c, none, positives).alias(f"{c}s") for c, none in (("low", float("inf")), ("high", float("-inf")))]
    windows = anchors.join(ranges, "id").select("id", "label", "v", *filled)
    found = _meet(held, windows, parts, length or 0, False, negatives)
    return _ranked(found, ["anchor_id", "slot"], negatives).join(first, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
