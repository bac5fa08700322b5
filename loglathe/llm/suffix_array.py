"""Removal of long repeated byte strings with a sparse suffix array, sorted in range partitions.

A string of ``length`` bytes (200) is looked at through one of its suffixes only: the one that
starts at its *anchor*, the least of its 64-byte grams by hash. Equal strings have their anchor
at the same offset, so two strings are equal if and only if the suffixes at their anchors agree
up to the string's end and the bytes before the anchors agree back to its start. That leaves one
suffix in about 70 to sort. Each carries what the strings of its anchor need and no more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.base import column_batches, free_name, keep, text_key

LENGTH, GRAM = 200, 64
#: Suffixes in a range partition: what one task sorts at a time, about 20 MB.
SUFFIXES = 50_000
_PIECE = 1 << 22
_PLACE_BITS = 23
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULT = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MULT[0]
    x = (x ^ (x >> np.uint64(27))) * _MULT[1]
    return x ^ (x >> np.uint64(31))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place, ``gram`` being a power of two."""
    h, n, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    with np.errstate(over="ignore"):
        while n < gram:
            h = h[:-n] * power + h[n:]
            power, n = power * power, 2 * n
    return _mixed(h)


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima to both sides of block ends."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:n - width + 1], after[width - 1:n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, first, last, lead): anchors of the strings that start at first ... last, and a hash of their gram.

    Every start of a string of ``length`` bytes belongs to one anchor. Very long texts go in
    pieces; an anchor at a seam may come twice, with a part of its strings each.
    """
    out = []
    width = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), _PIECE):
        part = np.frombuffer(data, np.uint8, min(_PIECE + length - 1, len(data) - at), at)
        h = _gram_hashes(part, gram)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)     # ties go to the left one
        place = (_window_least(packed, width) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        own = place[first]
        out.append((own + at, first + at, last + at, h[own].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _leads(texts):
    return [[anchors(_bytes(x))[3] for x in texts]]


def _contexts(texts):
    """For every anchor its lead, two digests of the bytes of all its strings, and its place with both offsets."""
    out = []
    for text in texts:
        data = _bytes(text)
        rows = []
        for a, p, q, lead in zip(*(x.tolist() for x in anchors(data)), strict=True):
            rows.append((lead, *_digest(data[p:q + LENGTH]), a << 16 | a - q << 8 | a - p))
        out.append(rows)
    return [out]


_CONTEXT = "array<struct<lead:bigint,c1:bigint,c2:bigint,at:bigint>>"


def _cut_contexts(texts, wanted):
    """Suffixes to sort: the bytes from the anchor on, and those before it in reverse."""
    out = []
    for text, rows in zip(texts, wanted, strict=True):
        data, got = _bytes(text), []
        for r in rows:
            a, low, high = r["at"] >> 16, r["at"] >> 8 & 255, r["at"] & 255
            got.append((r["lead"], r["c1"], r["c2"], r["n"], low, high, data[a:a - low + LENGTH], data[a - high:a][::-1]))
        out.append(got)
    return [out]


_SUFFIX = (
    "array<struct<lead:bigint,c1:bigint,c2:bigint,n:bigint,low:int,high:int,suffix:binary,before:binary>>"
)


def multikey_sort(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows in byte order, and the bytes that each shares with the one before it, up to ``width``.

    Multikey quicksort with eight bytes as a key, level by level: rows are parted by their next
    key, and only runs of equal keys go on to the one after it.
    """
    m, words = len(rows), -(-width // 8)
    joined = b"".join(r[:width].ljust(8 * words, b"\0") for r in rows)
    keys = np.frombuffer(joined, ">u8").reshape(m, words).astype(np.uint64)
    order, lcp = np.arange(m), np.full(m, width, np.int64)
    if m:
        lcp[0] = 0
    run = np.zeros(m, np.int64)                   # the run of equal rows that a sorted place belongs to
    places = np.arange(m)                         # sorted places that are still in runs of several rows
    for w in range(words):
        if not len(places):
            break
        key = keys[order[places], w]
        by = np.lexsort((key, run[places]))
        order[places], key = order[places][by], key[by]
        same_run = np.concatenate([[False], run[places][1:] == run[places][:-1]])
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        parted = same_run & differs
        at = np.flatnonzero(parted)
        if len(at):
            x = key[at] ^ key[at - 1]
            shared = np.zeros(len(at), np.int64)
            for b in range(7):                    # leading bytes that agree
                shared += (x >> np.uint64(8 * (7 - b)) == 0)
            lcp[places[at]] = np.minimum(width, 8 * w + shared)
        starts = ~same_run | parted
        run[places] = places[np.flatnonzero(starts)][np.cumsum(starts) - 1]
        size = np.diff(np.append(np.flatnonzero(starts), len(places)))
        places = places[np.repeat(size > 1, size)]
    return order, lcp


def _classes(order: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """For each row the number of its class, rows of a class being equal in their first ``length`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < length)
    return out


#: Offsets whose strings are compared across boundaries as one string first.
_BLOCK = 8
_DIGESTS = [("d1", pa.int64()), ("d2", pa.int64())]
_SEAM = pa.list_(pa.struct([
    ("b1", pa.int64()), ("b2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()),
    ("strings", pa.list_(pa.struct(_DIGESTS)))]))
_FOUND = (
    "lead long, c1 long, c2 long, offsets array<int>, "
    "seams array<struct<b1:bigint,b2:bigint,k1:bigint,k2:bigint,first:int,strings:array<struct<d1:bigint,d2:bigint>>>>"
)


def _digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(data)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _seam_blocks(right: bytes, left: bytes, first: int, last: int, seen: set) -> list[dict]:
    """Strings at offsets first ... last, by blocks of offsets on a fixed grid.

    For each block a digest of all its bytes, one of the core that every string of that place in the
    grid has, and one of each string.
    """
    out = []
    for at in range(first - first % _BLOCK, last + 1, _BLOCK):
        lo, hi = max(first, at), min(last, at + _BLOCK - 1)
        data = left[:hi][::-1] + right[:LENGTH - lo]
        b1, b2 = _digest(data)
        if (b1, b2, lo) not in seen:              # equal blocks of one partition repeat each other already
            seen.add((b1, b2, lo))
            strings = [_digest(data[hi - o:hi - o + LENGTH]) for o in range(lo, hi + 1)]
            k1, k2 = _digest(left[:at][::-1] + right[:LENGTH - at - _BLOCK + 1])
            out.append({"b1": b1, "b2": b2, "k1": k1, "k2": k2, "first": lo, "strings": [{"d1": x, "d2": y} for x, y in strings]})
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range partition: sort its suffixes, and find for each anchor the strings that come again.

    ``offsets`` are those of strings found here, counted from the string's start to the anchor.
    ``seams`` are digests of strings whose equals may lie in other partitions: those that agree,
    from the anchor to their end, with the first or the last suffix here. Each is told once.
    """
    tables = list(batches)
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    lead, c1, c2, n, low, high = (t.column(c).to_numpy() for c in ("lead", "c1", "c2", "n", "low", "high"))
    right, left = t.column("suffix").to_pylist(), t.column("before").to_pylist()
    if not right:
        return
    r_order, r_lcp = multikey_sort(right, LENGTH)
    l_order, l_lcp = multikey_sort(left, LENGTH - GRAM)
    m = len(right)
    offsets, seams = [[] for _ in range(m)], [[] for _ in range(m)]
    for o in range(LENGTH - GRAM + 1):
        held = np.flatnonzero((low <= o) & (o <= high))
        if not len(held):
            continue
        r_class = _classes(r_order, r_lcp, LENGTH - o)
        pair = r_class[held] * (m + 1) + _classes(l_order, l_lcp, o)[held]
        _, inverse, size = np.unique(pair, return_inverse=True, return_counts=True)
        again = size[inverse] > 1
        for i in held[again & (n[held] == 1)]:
            offsets[i].append(o)
    # bytes shared with the first and with the last suffix, along the order from either end
    ahead = np.minimum.accumulate(np.append(LENGTH, r_lcp[1:]))
    behind = np.minimum.accumulate(np.append(r_lcp[1:], LENGTH)[::-1])[::-1]
    shared = np.empty(m, np.int64)
    shared[r_order] = np.maximum(ahead, behind)
    start, seen = np.maximum(low, LENGTH - shared), set()
    for i in np.flatnonzero(start <= high):
        seams[i] = _seam_blocks(right[i], left[i], int(start[i]), int(high[i]), seen)
    told = [i for i in range(m) if offsets[i] or seams[i]]
    for at in range(0, len(told), 2000):
        some = told[at:at + 2000]
        yield pa.RecordBatch.from_arrays([
            pa.array(lead[some]), pa.array(c1[some]), pa.array(c2[some]),
            pa.array([offsets[i] for i in some], pa.list_(pa.int32())), pa.array([seams[i] for i in some], _SEAM),
        ], names=["lead", "c1", "c2", "offsets", "seams"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans): for every document the byte spans [from, to) of its repeated strings, unmerged.

    1. Leads of all anchors are counted; an anchor whose 64 bytes stand nowhere else has no repeats.
    2. The others are grouped by the digest of all bytes of their strings. Equal ones, as inside
       copies, are one suffix with a count, so a group of copies of any size is one row from here.
    3. Where a lead has several such suffixes, each is cut from one document and they are dealt by
       ranges that Spark samples from the suffixes themselves. A partition is sorted by multikey
       quicksort, to the right and, for the bytes before the anchors, to the left; for each offset,
       strings in one class both ways are equal.
    4. Strings that agree with a partition's first or last suffix are compared across the
       boundaries by digest, grouped and not gathered: first in blocks of neighbouring strings,
       of which a large group of near copies has few that differ, then, where the core of a block
       comes again, one by one.
    """
    key = text_key().alias("key")
    body = docs.select("doc_id", key, F.coalesce("text", F.lit("")).alias("text"))
    leads = column_batches(body, ["text"], lambda: _leads, "leads array<bigint>", [])
    several = keep(
        leads.select(F.explode("leads").alias("lead")).groupBy("lead").agg(F.count("*").alias("k")).where("k > 1").select("lead"),
        "suffix-leads")
    every = column_batches(body, ["text"], lambda: _contexts, f"x {_CONTEXT}", ["doc_id", "key"])
    found = keep(every.select("doc_id", "key", F.inline("x")).join(several, "lead"), "suffix-anchors")
    where = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "at")
    kinds = keep(found.groupBy("lead", "c1", "c2").agg(F.count("*").alias("n"), F.min(where).alias("w")), "suffix-kinds")
    mixed = kinds.groupBy("lead").agg(F.count("*").alias("k")).where("k > 1").select("lead")
    chosen = keep(kinds.join(mixed, "lead").select(
        F.col("w.doc_id").alias("its_id"), F.col("w.key").alias("its_key"), "lead", "c1", "c2", "n", F.col("w.at").alias("at")),
        "suffix-chosen")
    wanted = chosen.groupBy("its_id", "its_key").agg(F.collect_list(F.struct("lead", "c1", "c2", "n", "at")).alias("wanted"))
    parts = max(1, math.ceil(chosen.count() / SUFFIXES))
    with_text = body.join(wanted, body.doc_id.eqNullSafe(wanted.its_id) & (body.key == wanted.its_key))
    suffixes = column_batches(with_text, ["text", "wanted"], lambda: _cut_contexts, f"x {_SUFFIX}", []).select(F.inline("x"))
    ranges = suffixes.repartitionByRange(parts, "suffix", "before")
    told = keep(ranges.mapInArrow(_repeats, _FOUND), "suffix-found")
    seams = told.select("lead", "c1", "c2", F.inline("seams"))
    block = ["b1", "b2", "first"]
    blocks = keep(
        seams.groupBy(*block, "k1", "k2").agg(F.count("*").alias("k"), F.first("strings").alias("strings")), "suffix-seams")
    last = F.col("first") + F.size("strings") - 1
    alike = blocks.where("k > 1").select(*block, F.sequence("first", last).alias("offsets"))
    # strings of different blocks can only be equal if their cores are
    cores = blocks.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    strings = blocks.join(cores, ["k1", "k2"], "left_semi").select(*block, F.posexplode("strings").alias("i", "s")).select(
        *block, (F.col("first") + F.col("i")).alias("o"), "s.d1", "s.d2")
    across = strings.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2")
    some = strings.join(across, ["d1", "d2"], "left_semi").groupBy(*block).agg(F.collect_set("o").alias("offsets"))
    again = alike.unionByName(some)
    one = told.select("lead", "c1", "c2", "offsets").unionByName(
        seams.join(again, block).select("lead", "c1", "c2", "offsets"))
    some = one.groupBy("lead", "c1", "c2").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("offsets")).where("size(offsets) > 0")
    # equal suffixes repeat all their strings; of the others the offsets are known
    whole = kinds.where("n > 1").select("lead", "c1", "c2", F.lit(None).cast("array<int>").alias("offsets"))
    partial = some.join(kinds.where("n = 1").select("lead", "c1", "c2"), ["lead", "c1", "c2"], "left_semi")
    verdict = keep(whole.unionByName(partial), "suffix-verdict")
    place = F.shiftright("at", 16)
    all_of_it = F.array(F.struct(
        (place - F.col("at").bitwiseAND(F.lit(255))).alias("from"),
        (place - F.shiftright("at", 8).bitwiseAND(F.lit(255)) + LENGTH).alias("to")))
    each = F.transform("offsets", lambda o: F.struct((place - o).alias("from"), (place - o + LENGTH).alias("to")))
    # neighbouring offsets overlap: runs of them become one span before the rows are shuffled
    runs = F.aggregate(each, F.array().cast("array<struct<from:bigint,to:bigint>>"), lambda out, s: F.when(
        (F.size(out) > 0) & (F.element_at(out, -1)["from"] <= s["to"]) & (F.element_at(out, -1)["from"] > s["from"]),
        F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
                 F.array(F.struct(s["from"].alias("from"), F.element_at(out, -1)["to"].alias("to"))))
    ).otherwise(F.concat(out, F.array(s))))
    spans = found.join(verdict, ["lead", "c1", "c2"]).select(
        "doc_id", "key", F.inline(F.when(F.col("offsets").isNull(), all_of_it).otherwise(runs)))
    return spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    starts = [*(a for a, _ in runs), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, starts, strict=True))


def _with_spans(docs: DataFrame, columns: list) -> DataFrame:
    name = free_name(docs, "key")
    keyed = docs.withColumn(name, text_key())
    found = keep(repeated_spans(docs), "suffix-spans")
    found = found.select(F.col("doc_id").alias("its_id"), F.col("key").alias("its_key"), "spans")
    joined = keyed.join(found, keyed.doc_id.eqNullSafe(found.its_id) & (keyed[name] == found.its_key), "left")
    return joined.select(*[keyed[c] for c in columns], found.spans)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs of every row of ``docs``.

    Texts are UTF-8 bytes (null: empty). A byte goes if a string of ``LENGTH`` bytes around it also
    starts anywhere else, in the same text or another; overlaps count, matches never cross texts, and
    all is judged on the input. ``runs`` are the maximal removed byte spans. A row repeated whole
    is another text. Shorter texts keep all; an empty table gives no rows; other columns are ignored.
    """
    def make():
        def work(texts, spans):
            out = [[], [], [], [], []]
            for text, own in zip(texts, spans, strict=True):
                data, runs = _bytes(text), merged(own)
                row = (len(data), sum(b - a for a, b in runs), len(runs),
                       hashlib.sha256(_without(data, runs)).hexdigest(), [{"from": a, "to": b} for a, b in runs])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out
        return work

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<struct<from:bigint,to:bigint>>"
    return column_batches(_with_spans(docs, ["doc_id", "text"]), ["text", "spans"], make, fields, ["doc_id"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: the bytes that stay, whole characters only (a character that lost a byte goes)."""
    def make():
        return lambda texts, spans: [[
            None if x is None else _without(_bytes(x), merged(s)).decode("utf-8", "ignore")
            for x, s in zip(texts, spans, strict=True)]]

    return column_batches(_with_spans(docs, ["doc_id", "text"]), ["text", "spans"], make, "kept string", ["doc_id"]) \
        .withColumnRenamed("kept", "text")
