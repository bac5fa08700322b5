"""Broadcast behind a size check, salted join beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.operators.materialize import cut

BROADCAST_ROWS = 200_000
SALTS = 32


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    spread: str = "rec_no",
) -> DataFrame:
    """Equi-join with a side that is expected to be small.

    The expected-small side is written first, so what it is made from is read once, not for
    its count and again for the join. If it has at most ``max_rows`` rows it is broadcast; otherwise every row of it
    is copied ``salts`` times and the big side is spread over the copies by ``spread``, so
    that one hot key becomes ``salts`` reduce groups. Both ways give the same rows.
    ``how`` may be inner, left, left_semi or left_anti (the big side is the left side).
    """
    small = cut(small, "small")
    if small.count() <= max_rows:
        return big.join(F.broadcast(small), list(on), how)
    salted = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return big.withColumn(
        "_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    ).join(salted, [*on, "_salt"], how).drop("_salt")
