"""The registered queries: every operator over the whole test tables.

Each takes ``(spark, folder)``. Searches read an index that is built from the tables once
per application and kept in the shared work folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from duoglot.config import CorpusConfig
from duoglot.functions import text, vectors
from duoglot.operators.codes import Codes
from duoglot.operators import answers, corpus as corpus_ops, encode, knn, lexical, quality
from duoglot.plans import index as index_plan, ingest, search as search_plan
from duoglot.plans.search import SearchOptions
from duoglot.session import work_folder
from duoglot.sources import adapters, corpus as corpus_source
from duoglot.sources.index_tables import Index, ensure_index as create_if_absent, open_index
from duoglot.streaming.upsert import stream_upsert

ASCII = CorpusConfig(ascii_columns=True)
FIELDS = ("multilingual_concat", "pali_paragraph_ascii", "translation_paragraph_ascii")
LSH = (8, 6)
CODES = Codes(32, 8)
RANGE_DOCS = 64  # so that the small test tables have many ranges
PROBES = {"probes": 8, "shared_tables": 2}
_built: dict[tuple[str, str, str], str] = {}
_runs = iter(range(10**9))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run in the shared work folder."""
    app = spark.sparkContext.applicationId
    return f"{work_folder(spark)}/duoglot-{app}/{name}-{next(_runs)}"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.table(spark, folder, "documents")


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.documents_as_corpus(_documents(spark, folder))


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.conversations_as_corpus(adapters.table(spark, folder, "conversations"))


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.benchmark_as_queries(adapters.table(spark, folder, "benchmark"))


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")


def _index(spark: SparkSession, folder: str, kind: str) -> Index:
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _built:
        path = _folder(spark, kind)
        if kind == "documents":
            index_plan.build_index(spark, corpus_ops.build_corpus(_raw(spark, folder), ASCII),
                                   path, FIELDS, codes=CODES, range_docs=RANGE_DOCS)
        else:
            index_plan.build_index(spark, corpus_ops.build_corpus(_conversations(spark, folder)),
                                   path, vector_columns=index_plan.LANGUAGE_COLUMNS)
        _built[key] = path
    return open_index(spark, _built[key])


def _sparse(df: DataFrame, *keys: str) -> DataFrame:
    """Vectors in long form, without the zeros."""
    return (df.select(*keys, F.posexplode("embedding").alias("dim", "x")).where(F.col("x") != 0)
            .select(*keys, F.col("dim").cast("bigint").alias("dim"),
                    F.round(F.col("x").cast("double"), 6).alias("weight")))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "query_lang", "alpha", "alpha_used", F.col("rank").cast("bigint").alias("rank"),
        "doc_id", "book_id", "para_id", "bm25_score", "vector_score", "score", "score_type",
        F.md5("snippet").alias("snippet_md5"))


# --- corpus -------------------------------------------------------------------------

def corpus_ingest(spark, folder):
    return corpus_ops.build_corpus(_raw(spark, folder)).select(
        "doc_id", "book_id", "para_id", "pali_paragraph", "translation_paragraph",
        "multilingual_concat")


def corpus_dedup(spark, folder):
    """Key = source and language: many texts per key, exact copies collapse."""
    raw = _documents(spark, folder).select(
        F.col("source").alias("book_id"), F.col("lang").alias("para_id"),
        F.col("text").alias("pali_paragraph"), F.col("doc_id").alias("line"))
    return corpus_ops.build_corpus(raw, order_by=["line"]).select(
        "doc_id", "pali_paragraph", "line")


def corpus_fallback_concat(spark, folder):
    raw = _documents(spark, folder).select(
        F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("para_id"),
        F.col("text").alias("body"), F.col("lang").alias("note"),
        F.upper("lang").alias("note_ascii"))
    built = corpus_ops.build_corpus(raw)
    return built.select("doc_id", "body", "note", "multilingual_concat",
                        F.lit(len(built.columns)).cast("bigint").alias("n_columns"))


def multi_file_union(spark, folder):
    """English and other texts as two files with different, aliased columns."""
    documents = _documents(spark, folder)
    ids = [F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("para_id")]
    english = documents.where("lang <=> 'en'").select(*ids, F.col("text").alias("english_paragraph"))
    others = documents.where("NOT lang <=> 'en'").select(*ids, F.col("text").alias("pali_text"))
    raw = corpus_source.union_corpora([english, others])
    return corpus_ops.build_corpus(raw).select(
        "doc_id", "english_paragraph", "pali_text", "pali_paragraph", "translation_paragraph",
        "multilingual_concat")


def csv_ingest(spark, folder):
    """Tables → CSV with quoted line breaks → scan → corpus on storage → scan."""
    csv, out = _folder(spark, "csv"), _folder(spark, "corpus")
    (_raw(spark, folder).write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(csv))
    ingest.ingest_csv(spark, csv, out)
    return corpus_source.read_corpus(spark, out).select(
        "doc_id", "book_id", "para_id", "pali_paragraph", "translation_paragraph",
        "multilingual_concat")


def na_values(spark, folder):
    """Languages and sources as cells, one of each spelled as a missing-value mark."""
    cells = _documents(spark, folder).select(
        "doc_id", F.when(F.col("lang") == "de", "NA").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("source") == "src1", "null").otherwise(F.col("source")).alias("source"))
    return corpus_source.missing_to_null(cells, corpus_source.COMMON_NA_VALUES)


def run_summary(spark, folder):
    """What an ingest run and an index run report."""
    ingested = ingest.ingest_table(spark, _raw(spark, folder), _folder(spark, "corpus"))
    indexed = index_plan.index_summary(_index(spark, folder, "documents"))
    return ingested.select(F.lit("ingest").alias("run"), "rows", F.concat(
        F.array_join("id_fields", ","), F.lit(" / "),
        F.array_join("used_text_columns", ",")).alias("detail")).unionByName(
        indexed.select(F.lit("index").alias("run"), F.col("count").alias("rows"),
                       F.col("vector").alias("detail")))


# --- text ---------------------------------------------------------------------------

def fold_text(spark, folder):
    folded = corpus_ops.add_folded_columns(_documents(spark, folder).select("doc_id", "text"),
                                           ["text"])
    return folded.select("doc_id", "text_ascii")


def query_analysis(spark, folder):
    asked = _queries(spark, folder).select(
        F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query_id"), "query")
    told = _documents(spark, folder).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("query_id"),
        F.col("text").alias("query"))
    return search_plan.analyse_queries(asked.unionByName(told)).select(
        "query_id", "query_lang", "keyword_query", F.col("top_k").cast("bigint").alias("top_k"),
        "alpha")


def doc_uuid5(spark, folder):
    keyed = _raw(spark, folder).select(text.doc_key(["book_id", "para_id"]).alias("doc_id"))
    return keyed.select("doc_id", text.uuid5_dns("doc_id").alias("uuid"))


def nonempty_concat(spark, folder):
    c = adapters.table(spark, folder, "conversations")
    sides = [F.when(F.col("role") == role, F.col("text")) for role in ("user", "assistant")]
    return c.select("conv_id", "turn", text.concat_nonempty([*sides, F.lit("")]).alias("nonempty"),
                    text.concat_all([*sides, F.lit("")]).alias("every"))


def snippet(spark, folder):
    raw = _conversations(spark, folder).unionByName(_raw(spark, folder), allowMissingColumns=True)
    return raw.select("book_id", "para_id", text.citation_tag().alias("tag"),
                      text.snippet("pali_paragraph", "translation_paragraph").alias("snippet"))


# --- index --------------------------------------------------------------------------

def _upserted(spark, folder) -> Index:
    """All documents; then the non-English ones again with revised texts, plus new rows."""
    documents = _raw(spark, folder)
    revised = documents.where(F.col("pali_paragraph").isNotNull()).withColumn(
        "pali_paragraph", F.concat(F.lit("Revised: "), "pali_paragraph"))
    added = _queries(spark, folder).select(
        F.lit("bench").alias("book_id"), F.col("query_id").cast("string").alias("para_id"),
        F.lit(None).cast("string").alias("pali_paragraph"),
        F.col("query").alias("translation_paragraph"))
    path = _folder(spark, "upsert")
    index = index_plan.build_index(spark, corpus_ops.build_corpus(documents), path)
    return index_plan.upsert_index(
        index, corpus_ops.build_corpus(revised.unionByName(added)), batch="revision")


def index_upsert(spark, folder):
    return _upserted(spark, folder).docs().select(
        "uuid", "doc_id", "book_id", "para_id", F.md5("multilingual_concat").alias("text_md5"))


def upsert_term_stats(spark, folder):
    return _upserted(spark, folder).term_stats().select("term", "df")


def streaming_upsert(spark, folder):
    """The documents as a file stream into an index that holds them in upper case."""
    path = _folder(spark, "stream")
    before = _raw(spark, folder).withColumns({
        c: F.upper(c) for c in ("pali_paragraph", "translation_paragraph")})
    index_plan.build_index(spark, corpus_ops.build_corpus(before), path)
    documents = _documents(spark, folder)
    stream = spark.readStream.schema(documents.schema).parquet(f"{folder}/documents*.parquet")
    stream_upsert(adapters.documents_as_corpus(stream), path,
                  _folder(spark, "stream-state")).awaitTermination()
    return open_index(spark, path).docs().select(
        "uuid", "doc_id", F.md5("multilingual_concat").alias("text_md5"))


def postings(spark, folder):
    return _index(spark, folder, "documents").postings().where(
        F.col("field") == "multilingual_concat").select(
        "doc_id", "term", "tf", F.col("dl").cast("bigint").alias("dl"))


def term_stats(spark, folder):
    return _index(spark, folder, "documents").term_stats().select("field", "term", "df")


# --- vectors ------------------------------------------------------------------------

def hash_encode(spark, folder):
    docs = _documents(spark, folder).select("doc_id", "text")
    return _sparse(encode.hash_encode(docs, ["doc_id"], "text"), "doc_id")


def named_vectors(spark, folder):
    index = _index(spark, folder, "conversations")
    rows = [index.vectors(n).withColumn("vector_name", F.lit(n))
            for n in (*index_plan.LANGUAGE_COLUMNS, index_plan.FUSED)]
    return _sparse(corpus_source.union_corpora(rows), "doc_id", "vector_name")


def l2_normalize(spark, folder):
    """The embeddings, scaled by their row number and brought back to unit length."""
    scaled = adapters.table(spark, folder, "embeddings").withColumn(
        "embedding", F.transform("embedding", lambda x: (x * (F.col("vec_id") + 2)).cast("float")))
    unit = scaled.select("vec_id", vectors.l2_normalize("embedding").alias("embedding"))
    return unit.select("vec_id", F.posexplode("embedding").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"),
        F.round(F.col("x").cast("double"), 5).alias("x"))


def _knn(spark, folder, **options):
    e = _embeddings(spark, folder)
    found = knn.knn_topk(e.withColumnRenamed("doc_id", "query_id"), e, 10, **options)
    return found.select("query_id", "doc_id", F.col("vector_score").alias("score"),
                        F.col("vector_rank").cast("bigint").alias("rank"))


def knn_cosine(spark, folder):
    return _knn(spark, folder)


def knn_tiled(spark, folder):
    """The same search with both sides cut into tiles, as for large query tables."""
    return _knn(spark, folder, broadcast_queries=0, tile_queries=200, tile_docs=150)


def knn_lsh(spark, folder):
    return _knn(spark, folder, lsh=LSH)


# --- search -------------------------------------------------------------------------

def _search(spark, folder, kind="documents", queries=None, **options):
    return search_plan.search(
        _index(spark, folder, kind), _queries(spark, folder) if queries is None else queries,
        SearchOptions(**options))


def bm25_topk(spark, folder):
    return _hits(_search(spark, folder, vectors=False))


def bm25_fields(spark, folder):
    """Folded fields with weights; the folded Pali queries meet folded text."""
    return _hits(_search(spark, folder, vectors=False, fields={
        "pali_paragraph_ascii": 2.0, "translation_paragraph_ascii": 1.0}))


def bm25_salted(spark, folder):
    """BM25 by the shuffle join for query tables beyond the broadcast bound."""
    index = _index(spark, folder, "documents")
    asked = search_plan.analyse_queries(_queries(spark, folder))
    weighted = lexical.weigh_terms(lexical.query_terms(asked), index.term_stats(),
                                   index.field_totals(), lexical.DEFAULT_FIELDS)
    best = lexical.bm25_topk(index.postings(), weighted, 10, n_term_rows=1, broadcast_rows=0,
                             rows_per_split=100)
    return best.select("query_id", "doc_id", F.col("bm25_score").alias("score"),
                       F.col("bm25_rank").cast("bigint").alias("rank"))


def bm25_pruned(spark, folder):
    """Full keyword search by way of essential terms, as for many postings."""
    return _hits(_search(spark, folder, vectors=False, prune_from=0))


def bm25_impact_ranges(spark, folder):
    """Full keyword search by the bounds of document ranges, as for many query terms."""
    return _hits(_search(spark, folder, vectors=False, prune_from=0, impact_ranges=True))


def bm25_impact_batches(spark, folder):
    """The same in several batches of queries, as for more terms than can be broadcast."""
    index = _index(spark, folder, "documents")
    asked = search_plan.analyse_queries(_queries(spark, folder))
    weighted = lexical.weigh_terms(lexical.query_terms(asked), index.term_stats(),
                                   index.field_totals(), lexical.DEFAULT_FIELDS).checkpoint()
    n_terms = weighted.count()
    best = lexical.bm25_impact_ranges(index.postings(), index.impacts(), weighted, 10, index.n_ranges,
                                      term_rows=n_terms // 2 + 1, pair_rows=2 * n_terms * index.n_ranges)
    return best.select("query_id", "doc_id", F.col("bm25_score").alias("score"),
                       F.col("bm25_rank").cast("bigint").alias("rank"))


def hybrid_search(spark, folder):
    return _hits(_search(spark, folder))


def hybrid_rrf(spark, folder):
    return _hits(_search(spark, folder, fusion="rrf"))


def hybrid_alphas(spark, folder):
    """Every blend from keyword only to vector only, and different result sizes."""
    n = F.col("query_id")
    varied = _queries(spark, folder).withColumns({
        "alpha": (n % 5) / 4.0, "top_k": (5 + n % 10).cast("int")})
    return _hits(_search(spark, folder, queries=varied))


def _one_large(spark, folder):
    """One query asks for 1,500 hits, the others for 10."""
    return _queries(spark, folder).withColumn("top_k", F.when(F.col("query_id") == 0, 1500).otherwise(10))


def bm25_large_topk(spark, folder):
    return _hits(_search(spark, folder, queries=_one_large(spark, folder), vectors=False))


def hybrid_large_topk(spark, folder):
    return _hits(_search(spark, folder, queries=_one_large(spark, folder)))


def _vector_only(spark, folder):
    return _queries(spark, folder).withColumn("alpha", F.lit(1.0))


def search_lsh(spark, folder):
    """Vector search by the codes that the index keeps."""
    return _hits(_search(spark, folder, queries=_vector_only(spark, folder), **PROBES))


def lsh_recall(spark, folder):
    """How many of the ten nearest documents the search by codes finds."""
    exact = _search(spark, folder, queries=_vector_only(spark, folder)).select("query_id", "doc_id")
    found = _search(spark, folder, queries=_vector_only(spark, folder), **PROBES).select(
        "query_id", "doc_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_nearest"), F.count("found").alias("n_found"))


def search_filtered(spark, folder):
    return _hits(_search(spark, folder, where=F.col("translation_paragraph").isNotNull()
                         & F.col("book_id").like("src1%")))


def search_fallback(spark, folder):
    """Keyword-only queries whose words do not occur (the vector leg steps in), and
    queries without a vector (the keyword leg does)."""
    asked = _queries(spark, folder)
    encoded = asked.join(encode.hash_encode(asked, ["query_id"], "query"), "query_id")
    unknown = encoded.select((F.col("query_id") * 2).alias("query_id"),
                             F.md5("query").alias("query"), F.lit(0.0).alias("alpha"), "embedding")
    blind = asked.select((F.col("query_id") * 2 + 1).alias("query_id"), "query",
                         F.lit(0.5).alias("alpha"), F.lit(None).cast("array<float>")
                         .alias("embedding"))
    return _hits(_search(spark, folder, queries=unknown.unionByName(blind)))


def token_overlap(query, shown):
    wanted = F.array_distinct(text.tokens(query))
    found = F.size(F.array_intersect(wanted, text.tokens(shown)))
    return F.round(found / F.greatest(F.size(wanted), F.lit(1)), 6)


def rerank_overlap(spark, folder):
    return _hits(_search(spark, folder, "conversations", scorer=token_overlap))


def named_vector_search(spark, folder):
    return _hits(_search(spark, folder, "conversations", vector_name="pali", alpha=1.0))


def nested_results(spark, folder):
    nested = search_plan.nested_results(_search(spark, folder))
    return nested.select("query_id", "query_lang", "alpha", F.to_json(F.transform(
        "results", lambda r: F.struct(r["rank"].alias("rank"), r["doc_id"].alias("doc_id"),
                                      r["score_type"].alias("score_type")))).alias("results"))


def nested_results_all(spark, folder):
    """Every second query finds nothing, and has a row all the same."""
    asked = _nothing_found(spark, folder)
    hits = _search(spark, folder, queries=asked, vectors=False)
    nested = search_plan.nested_results(hits, asked)
    return nested.select("query_id", "query_lang", F.size("results").cast("bigint").alias("n_results"),
                         F.array_join(F.col("results")["doc_id"], " ").alias("doc_ids"))


def search_explain(spark, folder):
    hits = _search(spark, folder, explain=True)
    return hits.select("query_id", "doc_id", "explain.bm25_score", "explain.vector_score", "explain.hybrid_score")


# --- answers ------------------------------------------------------------------------

def _answers(spark, folder, kind, queries=None):
    return search_plan.answer(_index(spark, folder, kind),
                              _queries(spark, folder) if queries is None else queries)


def extractive_answer(spark, folder):
    return _answers(spark, folder, "conversations").select("query_id", "lang", "answer")


def extractive_answer_documents(spark, folder):
    return _answers(spark, folder, "documents").select("query_id", "lang", "answer")


def generator_answers(spark, folder):
    """A plugged-in generator; what it makes of a prompt is checked by the digest."""
    return search_plan.answer(_index(spark, folder, "conversations"), _queries(spark, folder),
                              generator=F.md5).select("query_id", "lang", "answer")


def _nothing_found(spark, folder):
    return _queries(spark, folder).select(
        "query_id", F.when(F.col("query_id") % 2 == 0, F.md5("query"))
        .otherwise(F.col("query")).alias("query"))


def answer_nothing_found(spark, folder):
    """Queries without a vector whose words do not occur, next to ones that find something."""
    index = _index(spark, folder, "conversations")
    return search_plan.answer(index, _nothing_found(spark, folder), SearchOptions(vectors=False)).select(
        "query_id", "lang", "answer", F.size("citations").cast("bigint").alias("n_citations"))


def rag_prompt(spark, folder):
    return _answers(spark, folder, "conversations").select("query_id", "lang", "prompt")


def citations(spark, folder):
    # Read twice below: searched once.
    hits = answers.display_texts(_search(spark, folder, "conversations", top_k=15)).checkpoint()
    texts = hits.select("query_id", "rank", "hit_label", "citation_text")
    cited = answers.assemble_answers(
        _queries(spark, folder).withColumn("query_lang", text.detect_lang("query")), hits)
    listed = cited.select("query_id", F.explode("citations").alias("c")).select(
        "query_id", "c.rank", "c.doc_id", "c.score", "c.score_type")
    return listed.join(texts, ["query_id", "rank"]).withColumn("rank", F.col("rank").cast("bigint"))


# --- quality ------------------------------------------------------------------------

def vector_audit(spark, folder):
    return quality.vector_audit(_embeddings(spark, folder))


def index_vector_audit(spark, folder):
    return quality.vector_audit(_index(spark, folder, "documents").vectors())


def pair_similarity(spark, folder):
    """Both sides of every conversation paragraph."""
    index = _index(spark, folder, "conversations")

    def side(name):
        return index.vectors(name).select(
            F.concat("doc_id", F.lit(f"/{name}")).alias("doc_id"), "embedding")

    pairs = index.docs().select(F.concat("doc_id", F.lit("/pali")).alias("left_id"),
                                F.concat("doc_id", F.lit("/en")).alias("right_id"))
    return quality.pair_similarity(pairs, side("pali").unionByName(side("en"))).select(
        "left_id", "right_id", "similarity")


def nearest_other(spark, folder):
    return quality.nearest_other(_embeddings(spark, folder).select("doc_id", "embedding"))


def class_similarity(spark, folder):
    return quality.class_similarity(_embeddings(spark, folder))


def ranking_audit(spark, folder):
    return quality.ranking_audit(_search(spark, folder), top_k=10)


def _judged(spark, folder):
    index = _index(spark, folder, "documents")
    posted = index.postings().where(F.col("field") == "multilingual_concat")
    judgments = quality.passage_judgments(_queries(spark, folder), index.docs(), posted)
    return quality.retrieval_quality(_search(spark, folder), judgments)


def retrieval_quality(spark, folder):
    return _judged(spark, folder)


def retrieval_quality_short(spark, folder):
    """Queries of one and two words, which many documents contain."""
    words = F.when(F.col("query_id") % 2 == 0, "^[^ ]+ [^ ]+").otherwise("^[^ ]+")
    asked = _queries(spark, folder).select("query_id", F.regexp_substr("query", words).alias("query"))
    index = _index(spark, folder, "documents")
    posted = index.postings().where(F.col("field") == "multilingual_concat")
    judgments = quality.passage_judgments(asked, index.docs(), posted)
    return quality.retrieval_quality(_search(spark, folder, queries=asked), judgments)


def retrieval_summary(spark, folder):
    return quality.quality_summary(_judged(spark, folder))


def _hashing_model():
    """The hashing encoder as a batch model, to exercise the plug-in."""
    import unicodedata

    class Letters(dict):
        """Character → itself if it is a letter, digit or mark, else a space; filled as characters turn up."""

        def __missing__(self, code):
            self[code] = chr(code) if unicodedata.category(chr(code))[0] in "LNM" else " "
            return self[code]

    letters, cells = Letters(), {}

    def cell(term):
        if term not in cells:
            digest = hashlib.md5(term.encode()).hexdigest()
            cells[term] = int(digest[:7], 16) % vectors.HASH_DIM, 1 if digest[7] < "8" else -1
        return cells[term]

    def predict(texts):
        out = np.zeros((len(texts), vectors.HASH_DIM), dtype=np.float64)
        for row, value in enumerate(texts):
            kept = value.lower().translate(letters)
            found = np.array([cell(term) for term in kept.split(" ") if term] or [cell("")])
            out[row] = np.bincount(found[:, 0], found[:, 1], vectors.HASH_DIM)
        return out

    return predict


def _model():
    return predict_batch_udf(_hashing_model, return_type=T.ArrayType(T.DoubleType()), batch_size=encode.MODEL_BATCH)


def encode_agreement(spark, folder):
    """Vectors of the index against the same texts encoded by a plugged-in batch model."""
    index = _index(spark, folder, "documents")
    model = predict_batch_udf(_hashing_model, return_type=T.ArrayType(T.DoubleType()),
                              batch_size=encode.MODEL_BATCH)
    other = encode.encode(index.docs().select("doc_id", "multilingual_concat"),
                          "multilingual_concat", model, id_col="doc_id")
    return quality.encode_agreement(index.vectors(), other)


def encode_reuse(spark, folder):
    """Two upserts through one vector store: every text is encoded, and so stored, once."""
    documents, store = _raw(spark, folder), _folder(spark, "vectors")
    revised = documents.withColumn("pali_paragraph", F.upper("pali_paragraph"))
    model = _model()
    index = index_plan.build_index(spark, corpus_ops.build_corpus(documents), _folder(spark, "reuse"),
                                   encoder=model, vector_store=store)
    index = index_plan.upsert_index(index, corpus_ops.build_corpus(revised), encoder=model, vector_store=store)
    return index.vectors().agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_if(F.abs(vectors.norm("embedding") - 1) < 1e-5).alias("n_unit"),
        F.lit(spark.read.parquet(store).count()).cast("bigint").alias("n_stored"))


def wordless_judgments(spark, folder):
    """What stands between the first two words of each query text, as a query of its own."""
    asked = _queries(spark, folder).select("query_id", F.regexp_substr(
        "query", F.lit(r"[^\p{L}\p{N}\p{M}]+")).alias("query")).where("query IS NOT NULL")
    index = _index(spark, folder, "documents")
    posted = index.postings().where(F.col("field") == "multilingual_concat")
    return quality.passage_judgments(asked, index.docs(), posted)


def encode_empty_texts(spark, folder):
    """Empty and missing texts through a plugged-in model."""
    kept = F.when(F.col("doc_id") % 7 > 1, F.col("text")).when(F.col("doc_id") % 7 == 1, F.lit(""))
    texts = _documents(spark, folder).select("doc_id", kept.alias("text"))
    model = predict_batch_udf(_hashing_model, return_type=T.ArrayType(T.DoubleType()),
                              batch_size=encode.MODEL_BATCH)
    found = encode.encode(texts, "text", model, id_col="doc_id")
    return _sparse(found, "doc_id")


def ensure_index(spark, folder):
    """Create the index if absent (twice), then fill it."""
    path = _folder(spark, "ensured")
    create_if_absent(spark, path)
    index = create_if_absent(spark, path)
    filled = index_plan.upsert_index(index, corpus_ops.build_corpus(_raw(spark, folder)))
    return filled.docs().select("uuid", "doc_id", F.md5("multilingual_concat").alias("text_md5"))


def compact_index(spark, folder):
    whole = index_plan.compact_index(_upserted(spark, folder), _folder(spark, "compacted"))
    return whole.term_stats().select("term", "df")


QUERIES = {f.__name__: f for f in (
    corpus_ingest, corpus_dedup, corpus_fallback_concat, multi_file_union, csv_ingest, na_values,
    run_summary, fold_text, query_analysis, doc_uuid5, nonempty_concat, snippet, index_upsert,
    upsert_term_stats, streaming_upsert, postings, term_stats, hash_encode, named_vectors,
    l2_normalize, knn_cosine, knn_tiled, knn_lsh, bm25_topk, bm25_fields, bm25_salted, bm25_pruned,
    hybrid_search, hybrid_rrf, hybrid_alphas, search_filtered, search_fallback, rerank_overlap,
    named_vector_search, nested_results, extractive_answer, extractive_answer_documents,
    answer_nothing_found, rag_prompt, citations, vector_audit, index_vector_audit,
    pair_similarity, nearest_other, class_similarity, ranking_audit, retrieval_quality,
    retrieval_summary, encode_agreement, nested_results_all, search_explain, generator_answers,
    retrieval_quality_short, encode_empty_texts, ensure_index, compact_index, bm25_large_topk,
    hybrid_large_topk, encode_reuse, wordless_judgments,
    search_lsh, lsh_recall, bm25_impact_ranges, bm25_impact_batches)}
