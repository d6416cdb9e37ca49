"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest small side, in rows, that is broadcast after counting it (times about 100 bytes a row).
BROADCAST_ROWS = 50_000
#: Shares into which the rows of a key are split beyond that.
SALTS = 16


def shuffled_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two sides that both grow with the input: merged, whatever their estimated sizes.

    The estimates are those of compressed files, and leave out what an explode multiplies: a table
    of ten estimated megabytes may be hundreds in the driver that would have to broadcast it.
    """
    return big.join(small.hint("merge"), on, how)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Equi-join whose big side is split over ``salts`` shares of each key, by the column ``spread``.

    ``small`` is repeated once per share, so no key of ``big`` ends in a single task, and is never broadcast.
    ``how`` may be inner, left, left_semi or left_anti.
    """
    big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return shuffled_join(big, small, [*on, "_salt"], how).drop("_salt")


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str, spread: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` if it has at most ``max_rows`` rows when counted, else :func:`salted_join`.

    ``small`` should be a materialised table: it is read for the count and again for the join.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, spread)
