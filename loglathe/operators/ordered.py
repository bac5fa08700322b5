"""Order-dependent values (running sums, running maxima, row numbers) without one task per file.

A window over a whole file puts that file into one task. Here every file is cut into
bounded chunks: the window runs inside a chunk, a small table with one row per chunk
carries the state across chunk edges, and the two are joined on the chunk key. The
join reuses the window's partitioning, so the wide side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536
#: Lines of one record that are put together in one row.
MAX_LINES = 100_000


def chunk_of(order: Column, rows: int = CHUNK_ROWS) -> Column:
    """First order key of the chunk a key falls into; a chunk spans ``rows`` integer keys."""
    return order - F.pmod(order, F.lit(rows))


def running(
    df: DataFrame,
    by: Sequence[str],
    chunk: str,
    order: str | Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Add running sums and maxima in ``order`` within ``by``.

    ``order`` is one column or several. ``chunk`` is a column that never decreases along ``order`` within ``by`` and whose
    groups are bounded. Values must be integer columns: the per-chunk aggregation then
    stays a hash aggregation with map-side combine.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    key = [*by, chunk]
    orders = [order] if isinstance(order, str) else list(order)
    inside = Window.partitionBy(*key).orderBy(*orders).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)

    totals = df.groupBy(*key).agg(
        *[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_c_{n}") for n, c in maxes.items()],
    )
    carried = totals.select(
        *key,
        *[F.sum(f"_c_{n}").over(before).alias(f"_b_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(before).alias(f"_b_{n}") for n in maxes],
    )
    local = df.withColumns({
        **{f"_l_{n}": F.sum(c).over(inside) for n, c in sums.items()},
        **{f"_l_{n}": F.max(c).over(inside) for n, c in maxes.items()},
    })
    zero = F.lit(0).cast("bigint")
    return (
        local.join(carried, key, "left")
        .withColumns({
            **{n: F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_b_{n}"), zero)
               for n in sums},
            **{n: F.greatest(f"_l_{n}", f"_b_{n}") for n in maxes},
        })
        .drop(*[f"_{p}_{n}" for p in "lb" for n in (*sums, *maxes)])
    )


def with_rec_no(
    df: DataFrame,
    by: str = "file_id",
    order: str | Sequence[str] = "line_no",
    name: str = "rec_no",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Dense 0-based position within ``by``, following a unique integer ``order``.

    ``order`` may be several columns; chunks are cut by the first of them.
    """
    first = order if isinstance(order, str) else order[0]
    return running(
        df.withColumn("_chunk", chunk_of(F.col(first), rows)),
        [by], "_chunk", order, sums={name: F.lit(1).cast("bigint")},
    ).drop("_chunk")


def running_state(
    df: DataFrame, by: Sequence[str], chunk: str, order: str, from_zero: Column, from_one: Column, name: str = "_state",
) -> DataFrame:
    """Add the state (0 or 1) before each row of a two-state machine that starts each ``by`` in 0.

    ``from_zero`` and ``from_one`` are the states (booleans) a row leads to from either. A row is thus one
    of four functions, and functions compose associatively: what counts is the last row that leads
    to one state from both, and how often the state was swapped since. Both are running values.
    ``order`` must leave two bits of a bigint free.
    """
    swap = (from_zero & ~from_one).cast("bigint")
    swapped = running(df, by, chunk, order, sums={"_swaps": swap})
    after = F.pmod(F.col("_swaps") + swap, F.lit(2))
    settled = F.when(from_zero == from_one, F.col(order) * 4 + from_zero.cast("bigint") * 2 + after)
    both = running(swapped, by, chunk, order, maxes={"_settled": settled})
    since = lambda c: F.pmod(c, F.lit(2))
    value = since(F.shiftright("_settled", 1) + F.col("_settled") + F.col("_swaps"))
    return both.withColumn(name, F.coalesce(value, since(F.col("_swaps")))).drop("_swaps", "_settled")


def running_depth(
    df: DataFrame, by: Sequence[str], chunk: str, order: str | Sequence[str], total: Column, least: Column, name: str = "_depth",
) -> DataFrame:
    """Add the depth before each row, never below zero, of rows that go up and down.

    A row is (``total``, ``least``): how far it ends above its start, and the lowest it gets on the way
    (at most 0). Depth that would fall below zero stays at zero, so it is the plain sum less the
    lowest plain depth so far.
    """
    summed = running(df, by, chunk, order, sums={"_sum": total})
    low = running(summed, by, chunk, order, maxes={"_deepest": -(F.col("_sum") + least)})
    return low.withColumn(name, F.col("_sum") + F.greatest(F.lit(0).cast("bigint"), F.col("_deepest"))).drop("_sum", "_deepest")


def join_runs(
    df: DataFrame,
    keep: Sequence[str],
    first: str,
    order: str,
    text: str,
    stride: int = 1,
    max_lines: int = MAX_LINES,
    extra: Mapping[str, Column] | None = None,
    separator: str = "\n",
) -> DataFrame:
    """Lines that share ``(file_id, first)`` -> rows ``keep, line_no, cont, raw`` (+ extras).

    ``first`` is the ``order`` of the run's first line and becomes ``line_no``; ``stride`` is the step
    of ``order`` from one line to the next. A run of more than ``max_lines`` lines has further
    rows of that many lines each, told apart by ``cont`` (0 for the first): they belong to the
    same record, nothing is lost, and no task collects more than that at once.
    """
    part = F.floor((F.col(order) - F.col(first)) / F.lit(stride * max_lines)).cast("int")
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return (
        df.groupBy(*keep, F.col(first).alias("line_no"), part.alias("cont"))
        .agg(
            F.array_join(F.transform(lines, lambda s: s["t"]), separator).alias("raw"),
            *[c.alias(n) for n, c in (extra or {}).items()],
        )
    )
