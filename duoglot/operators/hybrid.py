"""Blending the keyword leg and the vector leg, reranking, final scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from duoglot.functions.vectors import round_score

# Request defaults, candidate limit, score of last resort.
DEFAULT_TOP_K = 10
DEFAULT_ALPHA = 0.5
MIN_CANDIDATES = 100
EPSILON_SCORE = 1e-9

RRF_CONSTANT = 60              # Cormack et al. 2009
# A rerank plug-in: (query, snippet) → score.
Scorer = Callable[[Column, Column], Column]


def with_defaults(queries: DataFrame, top_k: int = DEFAULT_TOP_K,
                  alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Query table with ``top_k`` and ``alpha`` filled in."""
    def filled(name: str, value, kind: str) -> Column:
        default = F.lit(value).cast(kind)
        return F.coalesce(F.col(name).cast(kind), default) if name in queries.columns else default

    return queries.withColumns({"top_k": filled("top_k", top_k, "int"),
                                "alpha": filled("alpha", alpha, "double")})


def fuse(queries: DataFrame, keyword: DataFrame, vector: DataFrame,
         fusion: str = "relative") -> DataFrame:
    """``(query_id, doc_id, bm25_score, vector_score, hybrid_score)`` per candidate.

    ``queries`` has ``(query_id, alpha_used, top_k)``; a query without a vector has
    ``alpha_used`` 0. At 0 only keyword hits qualify, at 1 only vector hits. ``relative``
    scales each leg of a query to [0, 1] (1 where all scores agree); ``rrf`` uses
    reciprocal ranks. When no keyword hit qualifies at 0, the vector hits stand in with
    their similarity.

    Both legs hold at most a few hundred rows per query and share one shuffle by query.
    """
    if fusion not in ("relative", "rrf"):
        raise ValueError("fusion must be 'relative' or 'rrf'")
    none = F.lit(None)
    legs = keyword.select(
        "query_id", "doc_id", "bm25_score", "bm25_rank",
        none.cast("double").alias("vector_score"), none.cast("int").alias("vector_rank")
    ).unionByName(vector.select(
        "query_id", "doc_id", none.cast("double").alias("bm25_score"),
        none.cast("int").alias("bm25_rank"), "vector_score", "vector_rank"))
    own_limit = F.greatest(F.lit(MIN_CANDIDATES), F.col("top_k"))
    legs = (legs.join(queries.select("query_id", "alpha_used", "top_k"), "query_id")
            .where(F.coalesce("bm25_rank", "vector_rank") <= own_limit))

    per_query = Window.partitionBy("query_id")
    alpha = F.col("alpha_used")
    no_keyword = F.count("bm25_score").over(per_query) == 0
    legs = legs.withColumn("fallback", (alpha == 0) & no_keyword)

    def scaled(name: str) -> Column:
        low, high = F.min(name).over(per_query), F.max(name).over(per_query)
        return F.when(high == low, F.when(F.col(name).isNotNull(), 1.0)).otherwise(
            (F.col(name) - low) / (high - low))

    legs = legs.withColumns({"b": scaled("bm25_score"), "v": scaled("vector_score")})
    both = legs.groupBy("query_id", "doc_id").agg(
        *[F.max(c).alias(c) for c in ("bm25_score", "bm25_rank", "vector_score", "vector_rank",
                                      "b", "v", "alpha_used", "fallback")])
    if fusion == "relative":
        blend = (alpha * F.coalesce("v", F.lit(0.0))
                 + (1 - alpha) * F.coalesce("b", F.lit(0.0)))
    else:
        blend = (alpha * F.coalesce(1 / (RRF_CONSTANT + F.col("vector_rank")), F.lit(0.0))
                 + (1 - alpha) * F.coalesce(1 / (RRF_CONSTANT + F.col("bm25_rank")), F.lit(0.0)))
    qualifies = ((F.col("bm25_score").isNotNull() & (alpha < 1))
                 | (F.col("vector_score").isNotNull() & ((alpha > 0) | F.col("fallback"))))
    return both.where(qualifies).select(
        "query_id", "doc_id", "bm25_score", "vector_score",
        F.when(F.col("fallback"), F.col("vector_score"))
        .otherwise(round_score(blend)).alias("hybrid_score"))


def rank_candidates(candidates: DataFrame, max_candidates: int) -> DataFrame:
    """Number the candidates of each query by hybrid score and cut at ``max(100, top_k)``."""
    window = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), F.col("doc_id"))
    ranked = candidates.withColumn("hybrid_rank", F.row_number().over(window))
    return ranked.where(F.col("hybrid_rank") <= F.lit(max_candidates))


def final_scores(ranked: DataFrame) -> DataFrame:
    """``score`` and ``score_type``: rerank score, else hybrid score, else epsilon."""
    return ranked.withColumns({
        "score": F.coalesce("rerank_score", "hybrid_score", F.lit(EPSILON_SCORE)),
        "score_type": F.when(F.col("rerank_score").isNotNull(), "reranked")
        .when(F.col("hybrid_score").isNotNull(), "hybrid").otherwise("fallback")})


def rerank(candidates: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Final order and cut to ``top_k``, with ``rank``, ``score`` and ``score_type``.

    ``candidates`` has ``query, snippet, hybrid_rank, hybrid_score, top_k``. Equal scores
    keep the hybrid order; without a scorer the hybrid order stands.
    """
    if scorer is None:
        scored = candidates.withColumn("rerank_score", F.lit(None).cast("double"))
        order = [F.col("hybrid_rank")]
    else:
        scored = candidates.withColumn(
            "rerank_score", scorer(F.col("query"), F.col("snippet")).cast("double"))
        order = [F.desc(F.coalesce("rerank_score", F.lit(0.0))), F.col("hybrid_rank")]
    window = Window.partitionBy("query_id").orderBy(*order)
    return final_scores(scored.withColumn("rank", F.row_number().over(window))
                        .where(F.col("rank") <= F.col("top_k")))
