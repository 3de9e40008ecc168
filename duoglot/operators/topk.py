"""Ranking within groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

# Up to this limit Spark cuts every task's share of a group before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT_THRESHOLD = 1000
PRE_RANK_SPLITS = 256
# Rows that a task adds to its lists before it cuts them again.
LIST_ROWS = 200_000


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int,
                  rank: str = "rank", tie: str = "doc_id") -> DataFrame:
    """The first ``limit`` rows of every group, numbered from 1.

    ``limit`` is a literal, so Spark's group limit keeps at most that many rows of a group
    per task before anything is shuffled. For larger limits the group is first ranked in
    splits by the hash of ``tie``: the best rows overall are among the best of each split.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    if limit > GROUP_LIMIT_THRESHOLD:
        split = F.pmod(F.xxhash64(tie), F.lit(PRE_RANK_SPLITS))
        within = Window.partitionBy(*group, "_split").orderBy(*order)
        df = (df.withColumn("_split", split)
              .withColumn("_pre", F.row_number().over(within))
              .where(F.col("_pre") <= limit).drop("_split", "_pre"))
    return (df.withColumn(rank, F.row_number().over(window))
            .where(F.col(rank) <= F.lit(limit)))


def best_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key (nulls compare equal): the first in ``order``.

    A key that holds a large share of all rows is cut to one row per task before the
    shuffle by the same group limit.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_position", F.row_number().over(window))
            .where(F.col("_position") == 1).drop("_position"))


def top_by_own_limit(df: DataFrame, limits: DataFrame, score: str, rank: str = "rank",
                     group: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The best rows of every group by falling ``score``, ties by ``tie``, as many as the group's own
    ``limit`` in ``limits`` (``(group, limit)``, one row per group).

    A window can only cut at one number for all groups before the shuffle. Here every task
    keeps a list per group of the length that the group asks for, so one group with a large limit
    does not lengthen the lists of the others. Groups without a limit are left out.
    """
    columns = df.columns
    limited = df.join(F.broadcast(limits.select(group, F.col("limit").cast("long").alias("_limit"))), group)

    def cut(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(group, "ascending"), (score, "descending"), (tie, "ascending")]))
        codes = table.column(group).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(np.diff(codes, prepend=-1))
        place = np.arange(len(codes)) - np.repeat(firsts, np.diff(firsts, append=len(codes)))
        return table.filter(pa.array(place < table.column("_limit").to_numpy()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) > kept + LIST_ROWS:
                held = [cut(pa.concat_tables(held))]
                kept = held[0].num_rows
        if held:
            yield from cut(pa.concat_tables(held)).to_batches()

    lists = limited.mapInArrow(keep, limited.schema)
    window = Window.partitionBy(group).orderBy(F.desc(score), F.col(tie))
    return (lists.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= F.col("_limit"))
            .select(*columns, rank))
