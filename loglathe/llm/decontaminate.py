"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.base import column_batches, where_texts, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Items that are searched for at once; more of them are more passes over the documents, never a larger table.
BLOCK = 20_000
#: And so many characters of them, which bounds what goes to every executor.
BLOCK_CHARS = 20_000_000


def shingles(text: str, n: int = SHINGLE) -> list[bytes]:
    """Runs of ``n`` words, blanks as one; a text of fewer words is one shingle, one without words has none."""
    words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]


def size_class(n: int) -> int:
    """Items of 2^c ... 2^(c+1) - 1 different shingles are one partition."""
    return n.bit_length() - 1


def sketch_size(c: int, threshold: float = THRESHOLD) -> int:
    """Minima to keep for partition ``c``: one more than its largest item may lack, so one of them must be found."""
    most = 2 ** (c + 1) - 1
    return most - math.ceil(threshold * most - 1e-9) + 1


class Index:
    """Bottom-k MinHash sketches of a block of items, one table for each class of size, and the items' shingles.

    A document that contains ``threshold`` of an item lacks fewer shingles than the item's sketch
    has, so at least one of its minima stands in the document. The document's shingles are looked
    up in the tables of those classes that it is large enough to contain, which finds every such
    pair; the exact test follows. An item of under ``n`` words is one shingle of its own length,
    looked for among the document's runs of that length.
    """

    def __init__(self, items: list[tuple], n: int = SHINGLE, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.items: list[tuple] = []
        #: shingle length -> class of size -> minimum -> places in ``items``
        self.tables: dict[int, dict[int, dict[bytes, list[int]]]] = {}
        for item_id, text in items:
            width = min(n, len(words_of(text or "")))
            own = set(shingles(text or "", n))
            if not own:
                continue
            c = size_class(len(own))
            minima = self.tables.setdefault(width, {}).setdefault(c, {})
            for s in sorted(own, key=lambda x: (xxhash.xxh64_intdigest(x), x))[:sketch_size(c, threshold)]:
                minima.setdefault(s, []).append(len(self.items))
            self.items.append((item_id, frozenset(own)))

    def find(self, text: str) -> list[tuple]:
        """(item_id, shared, size) of the items that the whole text contains, by item_id."""
        out = []
        for width, classes in self.tables.items():
            own = shingles(text, width)
            met = {
                i for c, minima in classes.items() if len(own) >= self.threshold * 2 ** c - 1e-9
                for s in minima.keys() & own for i in minima[s]}
            if not met:
                continue
            held = set(own)
            for i in met:
                item_id, item = self.items[i]
                shared = len(item & held)
                if shared >= self.threshold * len(item) - 1e-9:
                    out.append((item_id, shared, len(item)))
        return sorted(out)


def blocks(
    benchmark: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, size: int = BLOCK, chars: int = BLOCK_CHARS
) -> Iterator[Index]:
    """Indexes of at most about ``size`` different items and ``chars`` characters each; repeated items count once."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    n_items, n_chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(n_items / size), math.ceil(n_chars / chars))
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        yield Index([(r.item_id, r.text) for r in rows], n, threshold)


def contained(
    docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, size: int = BLOCK
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every item that a document contains.

    Containment is the share of an item's different shingles that stand anywhere in the whole
    document, ``threshold`` or more. Documents stay where they are: a block of items goes to
    every executor, and nothing is shuffled. Null and empty texts, on either side, contain and
    are contained in nothing; an item without words isn't searched for; an item of fewer than
    ``n`` words is found wherever its words stand in a row. Copies and repeated rows give
    their own rows; of repeated items one is searched for. Other columns are ignored.
    """
    spark, found = docs.sparkSession, None
    kind = benchmark.schema["item_id"].dataType.simpleString()
    for index in blocks(benchmark, n, threshold, size):
        shared = spark.sparkContext.broadcast(index)
        hits = column_batches(
            docs, ["text"], lambda shared=shared: lambda texts: [[shared.value.find(x or "") for x in texts]],
            f"hits array<struct<item_id:{kind},n_shared:bigint,n_shingles:bigint>>", ["doc_id"],
        ).where(F.size("hits") > 0).select("doc_id", F.inline("hits"))
        found = hits if found is None else found.unionByName(hits)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, size: int = BLOCK
) -> DataFrame:
    """Rows of ``docs``, unchanged, that contain no item; copies and repeated rows share one fate."""
    for index in blocks(benchmark, n, threshold, size):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = where_texts(docs, lambda shared=shared: lambda texts: [not shared.value.find(x) for x in texts])
    return docs
