"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A key is hot when it holds more rows than one task should; there is at most one hot key
# for as many rows of the table, so the list is a millionth of it: safe to broadcast.
ROWS_PER_SPLIT = 1_000_000


def hot_keys(counts: DataFrame, keys: Sequence[str], count_col: str, total: int,
             rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Keys to split and into how many parts: ``(keys…, splits)``.

    ``counts`` has one row per key. At most total / rows_per_split rows come out.
    """
    return (counts.where(F.col(count_col) > rows_per_split)
            .select(*keys, F.ceil(F.col(count_col) / rows_per_split).cast("int").alias("splits")))


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: str,
                hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small`` on ``keys``; rows of hot keys are spread over several
    tasks by the hash of ``spread_by`` and ``small``'s row is repeated once per split."""
    hot = F.broadcast(hot)
    one = F.lit(1)
    big = (big.join(hot, list(keys), "left")
           .withColumn("_salt", F.pmod(F.xxhash64(spread_by),
                                       F.coalesce("splits", one)).cast("int"))
           .drop("splits"))
    small = (small.join(hot, list(keys), "left")
             .withColumn("_salt", F.explode(F.sequence(
                 F.lit(0), F.coalesce("splits", one) - 1)))
             .drop("splits"))
    return big.join(small, [*keys, "_salt"], how).drop("_salt")
