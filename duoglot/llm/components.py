"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PART_LINKS = 100_000


def connected_components(links: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``(id, component)`` for every id in ``links (a, b)``; ``component`` is the smallest id.

    Each round joins links with the smallest neighbour of each id. The number of rounds
    grows with the logarithm of the longest chain. Nothing but two sums a round comes to the driver.
    ``rows`` is a bound on the number of links; without it they are counted.
    """
    # No round has more links than the one before, so few links are never dealt over many files.
    of = lambda n: max(1, -(-n // PART_LINKS))
    links = (links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .distinct())
    links = (links if rows is None else links.coalesce(of(rows))).checkpoint()
    parts = of(links.count())
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = links.coalesce(parts).checkpoint()
        state = links.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
