import math

import pytest
from pyspark.sql import functions as F

from duoglot.functions import text
from duoglot.operators import answers, hybrid, lexical, quality
from duoglot.operators.corpus import build_corpus
from duoglot.plans import search as plan
from duoglot.plans.index import (LANGUAGE_COLUMNS, build_index, compact_index, index_summary, upsert_index)
from duoglot.plans.search import SearchOptions
from duoglot.config import CorpusConfig
from duoglot.sources.index_tables import IndexSettings, ensure_index, open_index

# A small bilingual collection and questions with the paragraphs that answer them.
PARAGRAPHS = [
    ("book_1", "p1", "Dānaṃ sukhaṃ āvahati", "A gift brings happiness to the giver of gifts"),
    ("book_1", "p2", "Nadī sāgaraṃ gacchati", "The river flows on, clinging to no bank"),
    ("book_2", "p3", "Sati maggaṃ rakkhati", "Heedfulness guards the long path"),
    ("abh01a.att", "248", "Amaraṃ nāma nagaraṃ, dassaneyyaṃ manoramaṃ.", "There was a city named Amara, delightful and charming to behold."),
    ("abh01a.att", "253", "Sattaratanasampannaṃ, nānājanasamākulaṃ;", "Abundant with seven jewels, crowded with various people;"),
    ("abh01a.att", "442", "Tepajja pupphitā sabbe, dhuvaṃ buddho bhavissasi.", "All of them have blossomed today, you will surely become a Buddha."),
    ("abh01a.att", "443", "Latā vā yadi vā rukkhā, phalabhārā honti tāvade;", "Creepers or trees, all become laden with fruit immediately;"),
    ("abh01a.att", "1", None, "The Buddha taught the Dhamma in the city"),
    ("abh01a.att", "2", "Buddho dhammaṃ desesi", None),
]
RAW = "book_id string, para_id string, pali_paragraph string, translation_paragraph string"
FIELDS = ("multilingual_concat", "pali_paragraph_ascii", "translation_paragraph_ascii")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    corpus = build_corpus(spark.createDataFrame(PARAGRAPHS, RAW), CorpusConfig(ascii_columns=True))
    return build_index(spark, corpus, str(tmp_path_factory.mktemp("index") / "i"), FIELDS,
                       vector_columns=LANGUAGE_COLUMNS)


def asked(spark, *texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, query string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def by_query(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r)
    return out


def brute_bm25(query):
    docs = {}
    for book, para, p, t in PARAGRAPHS:
        whole = f"{p or ''} \n {t or ''}".lower()
        docs[f"{book}:{para}"] = "".join(c if c.isalnum() or c in "\n " else " " for c in whole).split()
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    scores = {}
    for term in set("".join(c if c.isalnum() else " " for c in query.lower()).split()):
        df = sum(term in d for d in docs.values())
        for key, d in docs.items():
            tf = d.count(term)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                scores[key] = scores.get(key, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
    return sorted(((round(s, 6), k) for k, s in scores.items()), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("query", ["the city of jewels", "Dhamma gift", "become a Buddha"])
def test_bm25_matches_brute_force(spark, index, query):
    hits = by_query(plan.search(index, asked(spark, query), SearchOptions(vectors=False, alpha=0.0)))[0]
    want = brute_bm25(query)
    assert [h["doc_id"] for h in hits] == [k for _, k in want][:10]
    assert [h["bm25_score"] for h in hits] == pytest.approx([s for s, _ in want][:10], abs=2e-6)


def test_worked_questions_find_their_paragraphs(spark, index):
    questions = asked(spark, "which things happened to plants when trees became laden with fruit",
                      "ancient city delightful to behold", "abundant jewels crowded with people")
    judged = spark.createDataFrame([(0, "abh01a.att", "443"), (1, "abh01a.att", "248"), (2, "abh01a.att", "253")],
                                   "query_id long, book_id string, para_id string")
    quality_rows = quality.retrieval_quality(plan.search(index, questions), judged, ["book_id", "para_id"])
    assert [r["reciprocal_rank"] for r in quality_rows.collect()] == [1.0, 1.0, 1.0]
    assert quality.quality_summary(quality_rows).first()["hit_rate"] == 1.0


def test_scores_and_counts_hold_for_every_query(spark, index):
    hits = plan.search(index, asked(spark, "anicca", "What is Abhidhamma?", "Buddha Dhamma city", top_k=5))
    for r in quality.ranking_audit(hits, top_k=5).collect():
        assert r["non_increasing"] and r["within_unit"] and r["within_top_k"]


def test_alpha_ends_choose_one_leg(spark, index):
    keyword = by_query(plan.search(index, asked(spark, "Dhamma city", alpha=0.0)))[0]
    assert all(h["vector_score"] is None and h["bm25_score"] is not None for h in keyword)
    vector = by_query(plan.search(index, asked(spark, "Dhamma city", alpha=1.0)))[0]
    assert all(h["bm25_score"] is None and h["vector_score"] is not None for h in vector)
    assert len(vector) == len(PARAGRAPHS)


def test_without_vectors_alpha_is_reported_and_not_used(spark, index):
    hit = by_query(plan.search(index, asked(spark, "Dhamma"), SearchOptions(vectors=False)))[0][0]
    assert (hit["alpha"], hit["alpha_used"], hit["score_type"]) == (0.5, 0.0, "hybrid")


def test_vector_leg_steps_in_when_no_word_occurs(spark, index):
    vector = [1.0] + [0.0] * 767
    q = spark.createDataFrame([(0, "zzz", 0.0, vector), (1, "zzz", 0.0, None)],
                              "query_id long, query string, alpha double, embedding array<float>")
    hits = by_query(plan.search(index, q))
    assert 1 not in hits and len(hits[0]) == len(PARAGRAPHS)
    assert [h["score"] for h in hits[0]] == [h["vector_score"] for h in hits[0]]


def test_folded_fields_meet_folded_queries(spark, index):
    q = asked(spark, "āvahati")
    plain = by_query(plan.search(index, q, SearchOptions(vectors=False)))
    folded = by_query(plan.search(index, q, SearchOptions(vectors=False, fields={"pali_paragraph_ascii": 1.0})))
    assert plain == {} and [h["doc_id"] for h in folded[0]] == ["book_1:p1"]


def test_filter_applies_to_both_legs(spark, index):
    hits = by_query(plan.search(index, asked(spark, "Dhamma Buddha"), SearchOptions(where=F.col("book_id") == "book_1")))
    assert {h["book_id"] for h in hits[0]} == {"book_1"}


def test_no_queries_give_no_hits_and_no_answers(spark, index):
    none = spark.createDataFrame([], "query_id long, query string")
    assert plan.search(index, none).count() == 0
    assert plan.answer(index, none).count() == 0


def test_a_query_without_words_still_has_vector_hits(spark, index):
    hits = by_query(plan.search(index, asked(spark, "…", "")))
    assert len(hits[0]) == len(hits[1]) == len(PARAGRAPHS)
    nothing = plan.answer(index, asked(spark, "…"), SearchOptions(vectors=False)).first()
    assert nothing["answer"] == "No matching passages found for: …" and nothing["citations"] == []


def test_named_vector(spark, index):
    hits = by_query(plan.search(index, asked(spark, "Sati maggaṃ rakkhati"), SearchOptions(alpha=1.0, vector_name="pali")))[0]
    assert hits[0]["doc_id"] == "book_2:p3" and hits[0]["score"] == 1.0 and hits[0]["vector_score"] == 1.0


def test_tiled_approximate_leg_is_a_subset(spark, index):
    q = asked(spark, "The river flows on, clinging to no bank")
    hits = by_query(plan.search(index, q, SearchOptions(alpha=1.0, vector_name="en", lsh=(8, 4))))[0]
    assert hits[0]["doc_id"] == "book_1:p2"


def test_salted_join_gives_the_same_scores(spark, index):
    q = plan.analyse_queries(asked(spark, "the Buddha and the Dhamma of the city", "all jewels"))
    weighted = lexical.weigh_terms(lexical.query_terms(q), index.term_stats(), index.field_totals(), lexical.DEFAULT_FIELDS)
    one = lexical.bm25_topk(index.postings(), weighted, 5, 10)
    other = lexical.bm25_topk(index.postings(), weighted, 5, 10, broadcast_rows=0, rows_per_split=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


@pytest.mark.parametrize("limit", [1, 2, 5, 50])
def test_pruned_search_is_exact(spark, index, limit):
    q = plan.analyse_queries(asked(spark, "the Buddha and the Dhamma of the city", "all jewels", "gift",
                                   "there was a city named amara with the creepers"))
    weighted = lexical.weigh_terms(lexical.query_terms(q), index.term_stats(), index.field_totals(), lexical.DEFAULT_FIELDS)
    one = lexical.bm25_topk(index.postings(), weighted, limit, 10)
    other = lexical.bm25_topk_pruned(index.postings(), weighted, limit)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_pruned_search_shuffles_the_best_rows_only(spark, index):
    """Also in a session that wants all keys of a join clustered, as Spark does by default."""
    q = plan.analyse_queries(asked(spark, "the Buddha and the Dhamma of the city")).checkpoint()
    weighted = lexical.weigh_terms(lexical.query_terms(q), index.term_stats(), index.field_totals(),
                                   lexical.DEFAULT_FIELDS).checkpoint()
    best = lexical.bm25_topk_pruned(index.postings(), weighted, 5)
    shown = best._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in shown.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("doc_id" in line.split("hashpartitioning")[1] for line in shuffles)


def test_postings_are_not_shuffled_for_broadcast_terms(spark, index):
    q = plan.analyse_queries(asked(spark, "Dhamma")).checkpoint()
    weighted = lexical.weigh_terms(lexical.query_terms(q), index.term_stats(), index.field_totals(),
                                   lexical.DEFAULT_FIELDS).checkpoint()
    best = lexical.bm25_topk(index.postings(), weighted, 5, 1)
    text_plan = best._jdf.queryExecution().executedPlan().toString()
    assert text_plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in text_plan


def test_explanation_and_nested_form(spark, index):
    hits = plan.search(index, asked(spark, "Dhamma"), SearchOptions(explain=True))
    row = hits.first()
    assert row["explain"]["hybrid_score"] == row["score"]
    nested = plan.nested_results(plan.search(index, asked(spark, "Dhamma city"))).first()
    assert [r["rank"] for r in nested["results"]] == list(range(1, len(nested["results"]) + 1))


# --- fusion, rerank, final score ------------------------------------------------------

def candidates(spark, scores, top_k=10):
    rows = [(0, "q", f"d{i}", str(i), i + 1, s, top_k) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id long, query string, doc_id string, snippet string, "
                                       "hybrid_rank int, hybrid_score double, top_k int")


def test_rerank_orders_cuts_and_is_stable(spark):
    given = {"0": 0.58, "1": 0.95, "2": 0.72, "3": 0.72, "4": 0.45}
    scorer = lambda q, s: F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(v))])[s]
    rows = hybrid.rerank(candidates(spark, [0.1] * 5, top_k=4), scorer).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["d1", "d2", "d3", "d0"]
    assert [r["score"] for r in rows] == [0.95, 0.72, 0.72, 0.58]
    assert {r["score_type"] for r in rows} == {"reranked"}


def test_without_reranker_hybrid_order_stands(spark):
    rows = hybrid.rerank(candidates(spark, [0.9, 0.5, None], top_k=3)).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"], r["score_type"]) for r in rows] == [
        ("d0", 0.9, "hybrid"), ("d1", 0.5, "hybrid"), ("d2", 1e-9, "fallback")]


def test_fusion_of_two_legs(spark):
    q = spark.createDataFrame([(0, 0.5, 10)], "query_id long, alpha_used double, top_k int")
    kw = spark.createDataFrame([(0, "a", 4.0, 1), (0, "b", 2.0, 2)], "query_id long, doc_id string, bm25_score double, bm25_rank int")
    vec = spark.createDataFrame([(0, "b", 0.8, 1), (0, "c", 0.8, 2)], "query_id long, doc_id string, vector_score double, vector_rank int")
    rows = {r["doc_id"]: r["hybrid_score"] for r in hybrid.fuse(q, kw, vec).collect()}
    assert rows == {"a": 0.5, "b": 0.5, "c": 0.5}
    rrf = {r["doc_id"]: r["hybrid_score"] for r in hybrid.fuse(q, kw, vec, "rrf").collect()}
    assert rrf["b"] == round(0.5 / 61 + 0.5 / 62, 6)
    with pytest.raises(ValueError):
        hybrid.fuse(q, kw, vec, "other")


# --- answers --------------------------------------------------------------------------

CONTEXTS = {
    "english": [("b", str(i), f"pāli {i}", f"line {i} " + "word " * 30) for i in range(12)],
    "saṃsāra ñ": [("b", "1", "p", None), ("b", "2", None, "t"), ("b", "3", " ", ""), ("b", "4", "x", "  ")],
    "long": [("b", "1", None, "w" * 700)],
    "spaced": [("b", "1", None, "ab " * 400 + "\n"), ("b", "2", "p", "t")],
    "nothing": [],
}
HEAD = "Extractive bilingual answer (context-stitched)\n\nSummary:\n"
LINE = "line {} word word word word word word word word word word word word word word word word word word word word word word word word word word word word word word"
# Written out by hand, one per entry of CONTEXTS. A shown line of "english" has 156 characters: the fourth one
# passes 600, the cut at 600 falls into its last words.
ANSWERS = [
    HEAD + " ".join(LINE.format(i) for i in range(3)) + " line 3" + " word" * 24 + "…\n\nCitations:\n"
    + "[b:0]\n" + LINE.format(0) + "\npāli 0\n\n[b:1]\n" + LINE.format(1) + "\npāli 1\n\n[b:2]\n" + LINE.format(2)
    + "\npāli 2\n\n[b:3]\n" + LINE.format(3) + "\npāli 3\n\n[b:4]\n" + LINE.format(4) + "\npāli 4\n\n[b:5]\n"
    + LINE.format(5) + "\npāli 5\n",
    HEAD + "p t\n\nCitations:\n[b:1]\np\n\n\n[b:2]\n\nt\n\n[b:4]\nx\n\n",
    HEAD + "w" * 600 + "…\n\nCitations:\n[b:1]\n" + "w" * 700 + "\n\n",
    HEAD + "ab " * 199 + "ab…\n\nCitations:\n[b:1]\n" + "ab " * 399 + "ab\n\n\n[b:2]\nt\np\n",
    "No matching passages found for: nothing",
]


@pytest.fixture(scope="module")
def told(spark):
    queries, hits = [], []
    for i, (query, contexts) in enumerate(CONTEXTS.items()):
        queries.append((i, query))
        hits += [(i, r + 1, f"{b}:{p}", b, p, pali, tr, "s", 0.5, "hybrid") for r, (b, p, pali, tr) in enumerate(contexts)]
    q = spark.createDataFrame(queries, "query_id long, query string").withColumn("query_lang", text.detect_lang("query"))
    h = spark.createDataFrame(hits, "query_id long, rank int, doc_id string, book_id string, para_id string, "
                                    "pali_paragraph string, translation_paragraph string, snippet string, score double, score_type string")
    return q, h


def test_extractive_answers(told):
    q, h = told
    rows = answers.assemble_answers(q, h.withColumn("query_lang", F.lit("x"))).orderBy("query_id").collect()
    assert [r["lang"] for r in rows] == ["en", "pali", "en", "en", "en"]
    for r, expected, contexts in zip(rows, ANSWERS, CONTEXTS.values()):
        assert r["answer"] == expected
        assert [c["rank"] for c in r["citations"]] == list(range(1, min(10, len(contexts)) + 1))


def test_prompt_and_generator(told):
    q, h = told
    rows = answers.assemble_answers(q, h, generator=lambda prompt: F.upper(prompt)).orderBy("query_id").collect()
    assert rows[1]["prompt"] == ("Answer in pali. Use only the context and cite [book_id:para_id].\n\nQuestion: saṃsāra ñ"
                                 "\n\nContext:\n[b:1] p\n\n[b:2] t\n\n[b:3]  \n\n[b:4] x /   \n")
    assert rows[4]["prompt"].endswith("Context:\n\n")
    assert rows[0]["prompt"].count("[b:") == 12
    assert all(r["answer"] == r["prompt"].upper() for r in rows)


def test_display_texts(told):
    row = answers.display_texts(told[1].where("query_id = 1 and rank = 1")).first()
    assert (row["hit_label"], row["citation_text"]) == ("[b:1] · doc=b:1", "[b:1]\np\n")


# --- index life cycle -----------------------------------------------------------------

def corpus_of(spark, rows):
    return build_corpus(spark.createDataFrame(rows, RAW))


def test_upsert_replaces_adds_and_counts(spark, tmp_path):
    path = str(tmp_path / "i")
    first = build_index(spark, corpus_of(spark, PARAGRAPHS), path)
    assert index_summary(first).first().asDict() == {"count": 9, "vector": "multilingual"}
    changed = [("book_1", "p1", "navaṃ", "new words"), ("new", "1", None, "added"), ("new", "1", None, "added again")]
    second = upsert_index(first, corpus_of(spark, changed), batch="b1")
    assert upsert_index(second, corpus_of(spark, PARAGRAPHS), batch="b1").generations == second.generations
    docs = {r["doc_id"]: r for r in second.docs().collect()}
    assert len(docs) == 10 and docs["book_1:p1"]["translation_paragraph"] == "new words"
    assert docs["new:1"]["translation_paragraph"] == "added again"       # the larger text wins
    assert second.vectors().count() == 10
    fresh = build_index(spark, corpus_of(spark, [*PARAGRAPHS[1:], changed[0], changed[2]]), str(tmp_path / "j"))
    for a, b in ((second.term_stats(), fresh.term_stats()), (second.postings(), fresh.postings()),
                 (second.docs(), fresh.docs())):
        assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
    assert second.field_totals() == fresh.field_totals()
    compact = compact_index(second, str(tmp_path / "k"))
    assert len(compact.generations) == 1 and compact.docs().count() == 10
    q = asked(spark, "new words added", "Buddha Dhamma")
    results = [sorted(map(repr, plan.search(i, q).collect())) for i in (second, fresh, compact)]
    assert results[0] == results[1] == results[2]


def test_version_column_decides(spark, tmp_path):
    rows = corpus_of(spark, [("b", "1", "zz", None), ("b", "1", "aa", None)]).withColumn(
        "version", F.when(F.col("pali_paragraph") == "aa", 2).otherwise(1))
    index = build_index(spark, rows, str(tmp_path / "i"), order=[F.desc("version")])
    assert index.docs().first()["pali_paragraph"] == "aa"


def test_ensure_index_creates_once(spark, tmp_path):
    path = str(tmp_path / "i")
    created = ensure_index(spark, path, IndexSettings(buckets=2))
    assert created.docs().count() == 0 and created.settings.buckets == 2
    again = ensure_index(spark, path, IndexSettings(buckets=5))
    assert again.settings.buckets == 2 and again.generations == created.generations
    filled = upsert_index(again, corpus_of(spark, PARAGRAPHS))
    assert filled.docs().count() == 9
    assert plan.search(filled, asked(spark, "Dhamma")).count() > 0


def test_unfinished_generation_is_invisible(spark, tmp_path):
    path = str(tmp_path / "i")
    index = build_index(spark, corpus_of(spark, PARAGRAPHS), path)
    index.write_bucketed("docs", index.docs(), "000002-dead")     # an attempt that never finished
    assert open_index(spark, path).docs().count() == 9


def test_index_opens_after_the_catalog_forgot_it(spark, tmp_path):
    from duoglot.sources.index_tables import BUCKETED, table_name
    path = str(tmp_path / "i")
    build_index(spark, corpus_of(spark, PARAGRAPHS), path)
    for kind in BUCKETED:
        spark.sql(f"DROP TABLE {table_name(path, kind)}")
    index = open_index(spark, path)
    assert index.docs().count() == 9 and index.vectors().count() == 9


def test_texts_without_any_word_have_a_unit_vector(spark, tmp_path):
    index = build_index(spark, corpus_of(spark, [("b", "1", "…", None), ("b", "2", "word", None)]), str(tmp_path / "i"))
    assert quality.vector_audit(index.vectors()).first()["n_not_unit"] == 0
    assert index.vectors().count() == 2


def test_corpus_must_have_the_required_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="book_id"):
        build_index(spark, spark.createDataFrame([("d", "t")], "doc_id string, multilingual_concat string"), str(tmp_path / "i"))



def formatted(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_hits_are_fetched_by_id(spark, tmp_path):
    rows = [("b", str(i), f"pāli {i}", f"text number {i} of many") for i in range(400)]
    index = build_index(spark, corpus_of(spark, rows), str(tmp_path / "it's here"), buckets=16)
    some = index.docs_of(["b:7", "b:300", "absent"])
    assert sorted(r["doc_id"] for r in some.collect()) == ["b:300", "b:7"]
    # Without a join above it the planner shows no buckets unless told so; files are skipped either way.
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(auto)
    spark.conf.set(auto, "false")
    try:
        shown = formatted(index.docs_of(["b:7", "b:300", "absent"]))
    finally:
        spark.conf.set(auto, before)
    pruned = [line for line in shown.splitlines() if "SelectedBucketsCount" in line]
    assert pruned and all(int(line.split(":")[1].split()[0]) <= 3 for line in pruned)
    assert "In(doc_id, [absent,b:300,b:7])" in shown
    assert index.docs_of([f"b:{i}" for i in range(0, 400, 2)]).count() == 200
    assert index.docs_of([]).count() == 0
    with pytest.raises(ValueError):
        index.docs_of(["x"] * 1_001)
    hits = plan.search(index, asked(spark, "number 7"), SearchOptions(top_k=2))
    docs = [line for line in formatted(hits).splitlines() if "PushedFilters" in line]
    assert any("(doc_id, [b:" in line or "EqualTo(doc_id,b:" in line for line in docs)
    assert hits.count() == 2


def test_many_hits_are_joined(spark, index, monkeypatch):
    q = asked(spark, "Buddha Dhamma", "the city")
    few = sorted(map(repr, plan.search(index, q).collect()))
    monkeypatch.setattr(plan, "FETCH_IDS", 0)
    assert sorted(map(repr, plan.search(index, q).collect())) == few


@pytest.mark.parametrize("fetched", [1_000, 0])
def test_upsert_statistics_come_from_the_old_texts(spark, tmp_path, monkeypatch, fetched):
    from duoglot.sources import index_tables
    monkeypatch.setattr(index_tables, "FETCH_IDS", fetched)
    index = build_index(spark, corpus_of(spark, PARAGRAPHS), str(tmp_path / "i"), FIELDS[:1])
    read = []
    table = index_tables.Index._table
    monkeypatch.setattr(index_tables.Index, "_table", lambda self, kind: (read.append(kind), table(self, kind))[1])
    new = [(b, p, (pali or "") + " navaṃ", t) for b, p, pali, t in PARAGRAPHS[:4]]
    second = upsert_index(index, corpus_of(spark, new))
    assert "postings" not in read
    fresh = build_index(spark, corpus_of(spark, [*new, *PARAGRAPHS[4:]]), str(tmp_path / "j"), FIELDS[:1])
    assert sorted(map(repr, second.term_stats().collect())) == sorted(map(repr, fresh.term_stats().collect()))
    assert second.field_totals() == fresh.field_totals()


def test_compaction_doubles_buckets_by_bytes(spark, tmp_path):
    from duoglot.plans.index import fitting_buckets
    assert [fitting_buckets(n, 4, 100) for n in (0, 400, 401, 1700)] == [4, 4, 8, 32]
    index = build_index(spark, corpus_of(spark, PARAGRAPHS), str(tmp_path / "i"), buckets=2)
    twice = compact_index(index, str(tmp_path / "j"), bucket_bytes=200)
    assert twice.settings.buckets in (4, 8)
    assert sorted(map(repr, twice.docs().collect())) == sorted(map(repr, index.docs().collect()))
    assert sorted(map(repr, twice.postings().collect())) == sorted(map(repr, index.postings().collect()))


def test_own_limits(spark):
    from duoglot.operators.topk import top_by_own_limit
    import random
    draw = random.Random(2)
    rows = [(q, f"d{i}", float(draw.randint(0, 30))) for q in range(6) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id long, doc_id string, score double").repartition(5)
    limits = {0: 3, 1: 1, 2: 250, 3: 1000, 4: 0}
    wanted = spark.createDataFrame(list(limits.items()), "query_id long, limit int")
    got = {}
    for r in top_by_own_limit(df, wanted, "score").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for q, n in limits.items():
        want = sorted(((d, s) for p, d, s in rows if p == q), key=lambda x: (-x[1], x[0]))[:n]
        assert got.get(q, []) == want
    assert 5 not in got and top_by_own_limit(df.limit(0), wanted, "score").count() == 0


def test_own_limits_cut_in_the_task(spark, monkeypatch):
    from duoglot.operators import topk
    monkeypatch.setattr(topk, "LIST_ROWS", 10)
    df = spark.range(0, 5000, 1, 1).select(F.lit(1).alias("query_id"), F.col("id").cast("string").alias("doc_id"),
                                           F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("score"))
    limits = spark.createDataFrame([(1, 40)], "query_id int, limit int")
    got = [r["doc_id"] for r in topk.top_by_own_limit(df, limits, "score").orderBy("rank").collect()]
    assert got == [r["doc_id"] for r in df.orderBy(F.desc("score"), "doc_id").limit(40).collect()]


@pytest.mark.parametrize("tiles", [{}, {"broadcast_queries": 0, "tile_queries": 2, "tile_docs": 7}])
def test_nearest_with_own_limits(spark, tiles):
    from duoglot.operators.knn import knn_topk
    import numpy as np
    draw = np.random.default_rng(4)
    unit = [v / np.linalg.norm(v) for v in draw.normal(size=(60, 5))]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "doc_id long, embedding array<float>")
    queries = docs.where("doc_id < 4").withColumnRenamed("doc_id", "query_id")
    limits = spark.createDataFrame([(0, 2), (1, 30), (3, 1)], "query_id long, limit int")
    whole = [tuple(r) for r in knn_topk(queries, docs, 60).collect()]
    own = {0: 2, 1: 30, 3: 1}
    got = [tuple(r) for r in knn_topk(queries, docs, 30, limits=limits, **tiles).collect()]
    assert sorted(got) == sorted(r for r in whole if r[3] <= own.get(r[0], 0))


def test_judgments_of_short_and_wordless_queries(spark, index):
    docs = {r["doc_id"]: r["multilingual_concat"] for r in index.docs().collect()}
    queries = ["a", "an", "the", "Buddh", "gift of", "ā nāma", "jewels, crowded", ", ", "", ";", "…", ".", " \n ",
               "city named Amara", "x", "seven jewels, crowded with"]
    table = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    posted = index.postings().where(F.col("field") == "multilingual_concat")
    judged = quality.passage_judgments(table, index.docs(), posted)
    assert {tuple(r) for r in judged.collect()} == {
        (i, d) for i, q in enumerate(queries) for d, t in docs.items() if q in t}
    assert judged.count() == judged.distinct().count()
    plan_text = judged._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan_text and "Cartesian" not in plan_text
    assert quality.passage_judgments(table.limit(0), index.docs(), posted).count() == 0


def test_a_text_of_many_queries_is_looked_for_once(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "one, two three"), ("b", "one two"), ("c", "three"), ("d", None)],
                                 "doc_id string, multilingual_concat string")
    posted = lexical.postings(docs).checkpoint()
    asked_for = []
    found = quality.containing_terms
    monkeypatch.setattr(quality, "containing_terms", lambda asked, vocabulary: asked_for.append(
        asked.count()) or found(asked, vocabulary))
    rows = [(i, [" ", ", ", "thre"][i % 3]) for i in range(30)] + [(3, " "), (40, None), (None, " "), (None, "|")]
    queries = spark.createDataFrame(rows, "query_id long, query string")
    got = sorted(map(tuple, quality.passage_judgments(queries, docs, posted).collect()))
    texts = {r["doc_id"]: r["multilingual_concat"] or "" for r in docs.collect()}
    assert got == sorted((i, d) for i, q in rows if i is not None and q is not None for d in texts if q in texts[d])
    assert asked_for == [1, 2]
