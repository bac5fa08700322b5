"""Exact dedup: rows are grouped by a 128-bit hash of their text and the texts inside a group are compared by bytes.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Of equal
texts the row with the largest doc_id stays (null ids come before all others); of repeats of that
row, one. Everything runs on DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.llm.base import free_name, keep

#: A group with this share of all rows or more is looked up by broadcast: there are at most that many of them.
HOT_GROUPS = 1000
_LEAST = -(2**63)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash128(text: Column) -> Column:
    """128 bits of a text, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _clashes(docs: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    """Hashes that stand for more than one text.

    The aggregate compares whole texts by their bytes; copies within an input split travel once.
    """
    text = normalised(F.col("text"))
    texts = docs.select(content_hash(text).alias("h"), text.alias("t")).groupBy("h", "t").agg(F.lit(1).alias("one"))
    return texts.groupBy("h").agg(F.sum("one").alias("n")).where("n > 1").select(F.col("h"), F.lit(True).alias("clash"))


def _lookup(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with the group of their key; the few groups that can be hot by broadcast, the rest by key."""
    hot = F.col("group_size") * HOT_GROUPS >= total
    on = ["h", "part"]
    few = groups.where(hot).select(*on, F.col("keep_id").alias("hot_id"), F.col("keep_at").alias("hot_at"),
                                   F.col("group_size").alias("hot_size"))
    marked = rows.join(F.broadcast(few), on, "left")
    rest = marked.where("hot_size is null").drop("hot_id", "hot_at", "hot_size").join(groups.where(~hot), on)
    return marked.where("hot_size is not null").select(
        *rows.columns, F.col("hot_id").alias("keep_id"), F.col("hot_at").alias("keep_at"),
        F.col("hot_size").alias("group_size")).unionByName(rest)


def _classes(docs: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    text = normalised(F.col("text"))
    slim = docs.select(
        "doc_id", content_hash(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha"),
        F.monotonically_increasing_id().alias("at"))
    rows = keep(slim, "exact-rows")                       # ``at`` is written, so it stays what it is
    clashes = keep(_clashes(docs, content_hash), "exact-clashes")
    if clashes.isEmpty():
        rows = rows.withColumn("part", F.lit(b""))
    else:
        part = F.when(F.col("clash"), F.col("sha")).otherwise(F.lit(b"")).alias("part")
        rows = rows.join(clashes, "h", "left").select("doc_id", "h", "sha", "at", part)
    order = F.coalesce("doc_id", F.lit(_LEAST))
    groups = keep(rows.groupBy("h", "part").agg(
        F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.max_by("at", order).alias("keep_at"),
    ), "exact-groups")
    return _lookup(rows, groups, rows.count())


def classes(docs: DataFrame, content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) of every row of ``docs``.

    ``keep_id`` is the largest doc_id of the group (null where all are null). Exactly one row of
    each group has ``kept``; of repeats of that doc_id it is any one. An empty table gives no rows.
    Two texts that share a hash are two groups: ``content_hash`` decides on speed, never on results.
    """
    return _classes(docs, content_hash).select(
        "doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row of ``docs`` for each text, all columns unchanged: the one with the largest doc_id."""
    winners = _classes(docs, content_hash).where("at = keep_at").select(
        F.col("keep_id").alias("its_id"), F.col("sha").alias("its_sha"))
    sha = free_name(docs, "sha")
    keyed = docs.withColumn(sha, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    once = keyed.dropDuplicates(["doc_id", sha])          # repeats of an id fall before rows travel
    return once.join(
        winners, once.doc_id.eqNullSafe(winners.its_id) & (once[sha] == winners.its_sha), "left_semi").drop(sha)
