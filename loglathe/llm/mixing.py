"""Mixing sources to target weights by hash thresholds, found with histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglathe.llm.base import free_name, keep

#: Weights of the sources in order, repeated; times that a mix may repeat a source.
WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
#: The place of a document is a number of 60 bits, read in digits of these widths.
DIGITS = (12, 12, 36)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of the doc_id (null: of the text), as a number; spread evenly and never changing."""
    named = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, get ``weights`` in turn and share the sum of all sizes;
    a target stops at ``repeats`` times its source's size and the excess goes to the others by
    weight. That ends at one level L with target = min(repeats * size, L * weight): sources in
    order of repeats * size / weight are full until one stays above the level that the rest leaves.
    The tables here have a row for each source, not for each document.
    """
    one = Window.partitionBy("one")
    order = one.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.withColumn("one", F.lit(1)).withColumn("weight", weight)
    t = t.withColumn("full", F.col("source_size") * F.lit(repeats))
    filling = one.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        (F.sum("source_size").over(one) - F.coalesce(F.sum("full").over(before), F.lit(0))).cast("double")
        / F.sum("weight").over(after)
    )
    # a full source leaves a higher level to the rest, one that isn't full a lower: the highest is L
    return t.withColumn("own", level).withColumn("final", F.max("own").over(one)).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("full").cast("double"), F.col("final") * F.col("weight")), F.lit(0.0)).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, times, upto): a source's documents are taken ``times`` times, and once more up to place ``upto``.

    What ``times`` leaves of the target is the budget. Sums of size by source and first digit of
    the place say which digits fit the budget whole; only the documents of the digit where it
    ends are summed again by the next one, and so on to single places. Of the two places on
    either side of the budget the nearer one is taken, the lower one if they are as near. Each
    pass reads 4,096 times fewer documents than the one before, and no documents are sorted.
    """
    rest = F.col("target") - F.col("times") * F.col("source_size")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = goals.withColumn("times", times.cast("long")).select(
        "source", "times", rest.alias("budget"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("have"))
    shift = sum(DIGITS)
    for i, width in enumerate(DIGITS):
        shift -= width
        here = sized.join(
            F.broadcast(state.select(F.col("source").alias("its"), "base")), F.col("source").eqNullSafe(F.col("its"))
        ) if i else sized
        if i:                                              # only the bucket where the budget ended before
            here = here.where(F.shiftright("place", shift + width) == F.shiftright("base", shift + width))
        sums = here.groupBy("source", F.shiftright("place", shift).alias("digit")).agg(F.sum("size").alias("size"))
        s = sums.select(F.col("source").alias("its"), "digit", "size")
        s = s.join(state, s.its.eqNullSafe(state.source)).drop("its")
        upto = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        s = s.withColumn("sum", F.col("have") + F.sum("size").over(upto)).withColumn("was", F.col("sum") - F.col("size"))
        if i + 1 < len(DIGITS):
            # the last digit that starts within the budget
            within = s.where(F.col("was") <= F.col("budget"))
            state = within.groupBy("source").agg(F.max(F.struct("digit", "was", "times", "budget")).alias("at")).select(
                "source", "at.times", "at.budget", F.shiftleft("at.digit", shift).alias("base"), F.col("at.was").alias("have"))
            state = keep(state, "mix-state")
            continue
        ends = F.transform(
            F.array(F.struct(F.col("was").alias("sum"), (F.col("digit") - 1).alias("upto")),
                    F.struct(F.col("sum").alias("sum"), F.col("digit").alias("upto"))),
            lambda e: F.struct(F.abs(e["sum"] - F.col("budget")).alias("off"), e["sum"].alias("sum"), e["upto"].alias("upto"), F.col("times").alias("times")))
        near = s.where((F.col("was") <= F.col("budget"))).select("source", F.explode(ends).alias("e"))
        return near.groupBy("source").agg(F.min("e").alias("e")).select("source", "e.times", "e.upto")
    raise AssertionError


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place) of every row, without the texts."""
    return docs.select(
        "doc_id", "source", words_in(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place"))


def plan(sized: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(its, source_size, target, times, upto) of every source, ``its`` being its name."""
    goals = keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "mix-goals")
    cuts = keep(thresholds(sized, goals), "mix-cuts")
    c = cuts.select(F.col("source").alias("its"), "times", "upto")
    return goals.join(c, goals.source.eqNullSafe(c.its)).select(
        F.col("source").alias("its"), "source_size", "target", "times", "upto")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``.

    ``taken`` is 0 to ``repeats`` times the size. Documents are taken whole, so a source meets its
    target to within the document at its threshold. Rows of one doc_id stand at one place and go
    together; texts that are null or without words have size 0. A source without words has target
    0; an empty table gives no rows. Other columns are ignored.
    """
    sized = keep(sized_documents(docs), "mix-sizes")
    p = plan(sized, weights, repeats)
    once_more = (F.col("place") <= F.col("upto")).cast("long")
    return sized.join(F.broadcast(p), sized.source.eqNullSafe(p.its)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + once_more)).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, with ``copy`` (1, 2, ...) as one more column.

    The column gets a leading underscore where ``docs`` has one of that name. Documents without
    words are left out: they add nothing to any target.
    """
    sized = keep(sized_documents(docs), "mix-sizes")
    p = plan(sized, weights, repeats).select("its", "times", "upto")
    name = "copy" if "copy" not in {c.lower() for c in docs.columns} else free_name(docs, "copy")
    its, times, upto = (free_name(docs, c) for c in ("its", "times", "upto"))
    p = p.select(F.col("its").alias(its), F.col("times").alias(times), F.col("upto").alias(upto))
    many = F.col(times) + (place(docs.doc_id, docs.text) <= F.col(upto)).cast("long")
    joined = docs.join(F.broadcast(p), docs.source.eqNullSafe(p[its])).where(words_in(docs.text) > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), many))
    return joined.where(many > 0).select(*[docs[c] for c in docs.columns], copies.alias(name))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
goals AS (
  SELECT source, source_size, coalesce(least(3.0::DOUBLE * source_size,
         (SELECT max(own) FROM filled) * weight), 0) AS target
  FROM filled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM goals),
places AS (SELECT source, place, sum(size) AS size FROM sized GROUP BY ALL),
runs AS (
  SELECT p.source, p.place, b.target - b.times * b.source_size AS budget,
         (sum(p.size) OVER (PARTITION BY p.source ORDER BY p.place))::BIGINT AS upto_sum
  FROM places p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source),
ends AS (
  SELECT source, place, upto_sum, abs(upto_sum - budget) AS off FROM runs
  UNION ALL SELECT source, -1, 0, abs(0 - min(budget)) FROM runs GROUP BY source),
cuts AS (
  SELECT source, arg_min(place, (off, upto_sum, place)) AS upto FROM ends GROUP BY source)
SELECT s.doc_id, s.size, b.source_size, b.target,
       (s.size * (b.times + CASE WHEN s.place <= c.upto THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""
