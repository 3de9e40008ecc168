"""Query table × index → ranked hits, and ranked hits → answers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from duoglot.functions import text
from duoglot.operators import answers as answer_ops
from duoglot.operators import codes, hybrid, lexical
from duoglot.operators.encode import Encoder, encode, hash_encode
from duoglot.operators.knn import knn_topk
from duoglot.plans.index import FUSED
from duoglot.session import work_folder
from duoglot.sources.index_tables import FETCH_IDS, Index, one_of

# Hits are broadcast to the docs scan up to this many rows (about 100 bytes each).
BROADCAST_HITS = 500_000
HIT_COLUMNS = ("query_id", "query_lang", "alpha", "alpha_used", "rank", "doc_id", "book_id",
               "para_id", "pali_paragraph", "translation_paragraph", "snippet", "bm25_score",
               "vector_score", "score", "score_type")


@dataclass(frozen=True)
class SearchOptions:
    """How to search.

    ``fields`` maps the searched text fields to weights; ``where`` is a condition on the
    columns of the docs, applied to both legs (term statistics stay those of the whole
    index); ``vectors=False`` runs the keyword leg only; ``lsh`` makes the vector leg
    approximate, with codes of all vectors formed in the search; ``probes`` does so with the codes that
    the index keeps: that many buckets of every table are read for a query, and documents met in
    at least ``shared_tables`` tables are compared; from ``prune_from`` postings to score on, the keyword leg leaves out
    documents that cannot reach the top: by essential terms or, with ``impact_ranges`` and for more query
    terms than can be broadcast at once, by the bounds of document ranges.
    """

    top_k: int = hybrid.DEFAULT_TOP_K
    alpha: float = hybrid.DEFAULT_ALPHA
    fields: Mapping[str, float] = field(default_factory=lambda: dict(lexical.DEFAULT_FIELDS))
    vector_name: str = FUSED
    vectors: bool = True
    encoder: Encoder | None = None
    where: Column | None = None
    fusion: str = "relative"
    scorer: hybrid.Scorer | None = None
    lsh: tuple[int, int] | None = None
    probes: int = 0
    shared_tables: int = 1
    explain: bool = False
    prune_from: int = lexical.PRUNE_FROM
    impact_ranges: bool = False


def analyse_queries(queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
    """Query table with defaults, ``query_lang`` and the ``keyword_query`` text."""
    options = options or SearchOptions()
    return (hybrid.with_defaults(queries, options.top_k, options.alpha)
            .withColumn("query_lang", text.detect_lang("query"))
            .withColumn("keyword_query", text.keyword_query("query", "query_lang")))


def with_vectors(queries: DataFrame, options: SearchOptions) -> DataFrame:
    """Add the query vectors unless the table brings its own ``embedding`` column."""
    if not options.vectors:
        return queries.drop("embedding").withColumn(
            "embedding", F.lit(None).cast("array<float>"))
    if "embedding" in queries.columns:
        return queries
    if options.encoder is not None:
        return encode(queries, "query", options.encoder, id_col="query_id")
    return queries.join(hash_encode(queries, ["query_id"], "query"), "query_id", "left")


def search(index: Index, queries: DataFrame, options: SearchOptions | None = None) -> DataFrame:
    """Ranked hits of every query of ``(query_id, query[, top_k, alpha, embedding])``.

    The analysed query table is checkpointed, as both legs read it, and profiled (number of
    queries and query terms, largest ``top_k``): those numbers decide between broadcast and
    shuffle joins and give the ranking windows their literal limit. Where some query asks for more
    than the usual candidates, every query has a limit of its own instead.
    """
    options = options or SearchOptions()
    work_folder(index.spark)
    q = with_vectors(analyse_queries(queries, options), options).withColumn(
        "alpha_used", F.when(F.col("embedding").isNull(), 0.0).otherwise(F.col("alpha"))
    ).checkpoint()
    profile = q.agg(F.count(F.lit(1)).alias("n"), F.max("top_k").alias("k"), F.sum("top_k").alias("all_k"),
                    F.sum(F.greatest(F.lit(hybrid.MIN_CANDIDATES), F.col("top_k"))).alias("all_candidates"),
                    F.sum(F.size(F.array_distinct(text.tokens("keyword_query")))).alias("terms"),
                    F.count_if(F.col("embedding").isNotNull() & (F.col("alpha_used") > 0))
                    .alias("vector"),
                    F.count_if(F.col("embedding").isNotNull() & (F.col("alpha_used") == 0))
                    .alias("fallback")).first()
    limit = max(hybrid.MIN_CANDIDATES, profile["k"] or 0)
    limits = None
    if limit > hybrid.MIN_CANDIDATES and profile["n"] <= BROADCAST_HITS:
        limits = q.select("query_id", F.greatest(F.lit(hybrid.MIN_CANDIDATES), F.col("top_k")).alias("limit"))
    allowed = None
    if options.where is not None:
        # Bucketed like postings and vectors: joined bucket by bucket, and able to spill.
        allowed = index.docs().where(options.where).select("doc_id")

    keyword = _keyword_leg(index, q.where(F.col("alpha_used") < 1), allowed, options, limit,
                           profile["terms"] or 0, limits)
    if profile["fallback"]:
        keyword = keyword.checkpoint()
    vector = _vector_leg(index, q, keyword, allowed, options, limit, profile, limits)
    ranked = hybrid.rank_candidates(hybrid.fuse(q, keyword, vector, options.fusion), limit)
    per_query = q.select("query_id", "query_lang", "alpha", "alpha_used", "top_k")
    ranked = ranked.join(per_query, "query_id").where(
        F.col("hybrid_rank") <= F.greatest(F.lit(hybrid.MIN_CANDIDATES), F.col("top_k")))
    if options.scorer is None:
        # Fetch texts only for the rows that will be returned.
        ranked = ranked.where(F.col("hybrid_rank") <= F.col("top_k"))
        kept = profile["all_k"] or 0
    else:
        kept = profile["all_candidates"] or 0
    columns = ("doc_id", "book_id", "para_id", "pali_paragraph", "translation_paragraph")
    if kept <= FETCH_IDS:
        # The lists are complete and few: only the texts of their documents are read.
        ranked = ranked.checkpoint()
        wanted = [r["doc_id"] for r in ranked.select("doc_id").distinct().collect()]
        payload = index.docs_of(wanted).select(*columns)
    else:
        payload = index.docs().select(*columns)
    if kept <= BROADCAST_HITS:
        ranked = F.broadcast(ranked)
    hits = payload.join(ranked, "doc_id").withColumn(
        "snippet", text.snippet("pali_paragraph", "translation_paragraph"))
    if options.scorer is not None:
        # Query texts, which may be long, meet the hits after the fetch and are never broadcast with them.
        hits = hits.join(q.select("query_id", "query"), "query_id")
    hits = hybrid.rerank(hits, options.scorer)
    if options.explain:
        hits = hits.withColumn("explain", F.struct(
            "bm25_score", "vector_score", "hybrid_score", "rerank_score"))
    return hits.select(*HIT_COLUMNS, *(["explain"] if options.explain else []))


def _keyword_leg(index: Index, q: DataFrame, allowed: DataFrame | None,
                 options: SearchOptions, limit: int, n_terms: int,
                 limits: DataFrame | None = None) -> DataFrame:
    terms = lexical.query_terms(q)
    distinct = terms.select("term").distinct()
    n_rows = n_terms * len(options.fields)
    if n_rows <= lexical.BROADCAST_TERM_ROWS:
        distinct = F.broadcast(distinct)
    weighted = lexical.weigh_terms(terms, index.term_stats(distinct), index.field_totals(),
                                   options.fields).checkpoint()
    posted, impacts = index.postings(), index.impacts() if index.settings.range_docs else None
    if allowed is not None:
        posted = posted.join(allowed, "doc_id", "left_semi")
    if n_terms <= lexical.PUSHED_TERMS:
        # The scan drops rows without any of them, and skips pages of the impacts, whose runs are in the order of terms.
        wanted = [r["term"] for r in weighted.select("term").distinct().collect()]
        posted = posted.where(F.col("term").isin(wanted))
        impacts = impacts if impacts is None else impacts.where(F.col("term").isin(wanted))
    n_postings = weighted.agg(F.sum("df")).first()[0] or 0
    few = n_rows <= lexical.BROADCAST_TERM_ROWS
    if impacts is not None and n_postings >= options.prune_from and (options.impact_ranges or not few):
        return lexical.bm25_impact_ranges(posted, impacts, weighted, limit, index.n_ranges, limits, one_of=one_of)
    if n_postings >= options.prune_from and few:
        return lexical.bm25_topk_pruned(posted, weighted, limit, limits)
    return lexical.bm25_topk(posted, weighted, limit, n_rows, limits=limits)


def _vector_leg(index: Index, q: DataFrame, keyword: DataFrame, allowed: DataFrame | None,
                options: SearchOptions, limit: int, profile,
                limits: DataFrame | None = None) -> DataFrame:
    """Vector hits for the queries that blend them in and, where the keyword leg found
    nothing for a keyword-only query, in its place."""
    wanted = q.where(F.col("embedding").isNotNull() & (F.col("alpha_used") > 0))
    if profile["fallback"]:
        unanswered = q.where(F.col("embedding").isNotNull() & (F.col("alpha_used") == 0)).join(
            keyword.select("query_id").distinct(), "query_id", "left_anti")
        wanted = wanted.unionByName(unanswered)
    if not profile["vector"] and not profile["fallback"]:
        return _no_vector_hits(q)
    if options.probes:
        return _stored_codes_leg(index, wanted, allowed, options, limit, limits)
    vectors = index.vectors(options.vector_name)
    if allowed is not None:
        vectors = vectors.join(allowed, "doc_id", "left_semi")
    return knn_topk(wanted, vectors, limit, lsh=options.lsh, limits=limits)


def _stored_codes_leg(index: Index, wanted: DataFrame, allowed: DataFrame | None, options: SearchOptions,
                      limit: int, limits: DataFrame | None) -> DataFrame:
    """Buckets near the queries, documents met there, and only then the vectors of those."""
    if index.settings.codes is None:
        raise ValueError("the index has no codes")
    # Met by several steps below; a fallback's keyword leg is not run again for each.
    wanted = wanted.select("query_id", "embedding").checkpoint()
    probed = codes.probe_rows(wanted, index.settings.codes, options.probes).checkpoint()
    buckets = probed.select("bucket").distinct().limit(FETCH_IDS + 1).collect()
    few = [r["bucket"] for r in buckets] if len(buckets) <= FETCH_IDS else None
    rows = index.codes(options.vector_name, few)
    if allowed is not None:
        rows = rows.join(allowed, "doc_id", "left_semi")
    if probed.count() <= codes.BROADCAST_PROBES:
        probed = F.broadcast(probed)
    pairs = codes.met_documents(rows, probed, options.shared_tables).checkpoint()
    met = pairs.select("doc_id").distinct().limit(FETCH_IDS + 1).collect()
    vectors = (index.vectors_of([r["doc_id"] for r in met], options.vector_name)
               if len(met) <= FETCH_IDS else index.vectors(options.vector_name))
    return codes.nearest_of(wanted, pairs, vectors, limit, limits)


def _no_vector_hits(q: DataFrame) -> DataFrame:
    return q.where(F.lit(False)).select(
        "query_id", F.lit("").alias("doc_id"), F.lit(0.0).alias("vector_score"),
        F.lit(0).alias("vector_rank"))


def nested_results(hits: DataFrame, queries: DataFrame | None = None,
                   options: SearchOptions | None = None) -> DataFrame:
    """One row per query: language, alpha and the array of its hits by rank.

    With ``queries`` (those of the search), also for queries without hits: their array is
    empty and ``alpha_used`` null."""
    columns = [c for c in HIT_COLUMNS if c not in ("query_id", "query_lang", "alpha",
                                                   "alpha_used")]
    nested = hits.groupBy("query_id").agg(
        F.first("query_lang").alias("query_lang"), F.first("alpha").alias("alpha"),
        F.first("alpha_used").alias("alpha_used"),
        F.sort_array(F.collect_list(F.struct(*columns))).alias("results"))
    if queries is None:
        return nested
    asked = analyse_queries(queries, options).select("query_id", "query_lang", "alpha")
    empty = F.array().cast(nested.schema["results"].dataType)
    return asked.join(nested.drop("query_lang", "alpha"), "query_id", "left").select(
        "query_id", "query_lang", "alpha", "alpha_used", F.coalesce("results", empty).alias("results"))


def answer(index: Index, queries: DataFrame, options: SearchOptions | None = None,
           generator: answer_ops.Generator | None = None) -> DataFrame:
    """Search, then one answer row per query."""
    hits = search(index, queries, options)
    asked = queries.select("query_id", "query", text.detect_lang("query").alias("query_lang"))
    return answer_ops.assemble_answers(asked, hits, generator)
