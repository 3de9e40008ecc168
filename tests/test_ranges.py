import random

import pytest
from pyspark.sql import functions as F

from duoglot.operators import lexical
from duoglot.operators.corpus import build_corpus
from duoglot.plans import search as plan
from duoglot.plans.index import build_index, compact_index, upsert_index
from duoglot.plans.search import SearchOptions
from duoglot.sources.index_tables import ensure_index, one_of, open_index

RAW = "book_id string, para_id string, pali_paragraph string, translation_paragraph string"
WORDS = [f"w{i}" for i in range(60)]


def paragraphs(seed, books=6, each=20):
    """Every book prefers words of its own, so that ranges differ."""
    draw = random.Random(seed)
    def text(book):
        return " ".join(WORDS[min(59, int(draw.expovariate(0.2)) + 8 * book)] for _ in range(draw.randint(1, 30)))
    return [(f"b{b}", str(p), text(b), text(b) if p % 3 else None) for b in range(books) for p in range(each)]


@pytest.fixture(scope="module", params=[1, 4, 1024])
def index(request, spark, tmp_path_factory):
    """Two generations, the second one replacing some rows of the first."""
    path = str(tmp_path_factory.mktemp("ranges") / "i")
    first = build_index(spark, build_corpus(spark.createDataFrame(paragraphs(1), RAW)), path,
                        ("multilingual_concat", "pali_paragraph"), buckets=3, range_docs=request.param)
    return upsert_index(first, build_corpus(spark.createDataFrame(paragraphs(2)[::5], RAW)))


def weights(spark, index, fields=None):
    asked = spark.createDataFrame([(1, "w0 w1 w9 w30"), (2, "w3 w3 w17"), (3, "w41 absent"), (4, "absent"),
                                   (5, " ".join(WORDS)), (6, ""), (7, "w0")], "query_id long, query string")
    terms = lexical.query_terms(plan.analyse_queries(asked))
    return lexical.weigh_terms(terms, index.term_stats(), index.field_totals(),
                               fields or lexical.DEFAULT_FIELDS).checkpoint()


def rows(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "bm25_score", "bm25_rank").collect()))


@pytest.mark.parametrize("limit", [1, 3, 200])
def test_ranges_give_the_same_lists(spark, index, limit):
    for fields in (None, {"multilingual_concat": 1.0, "pali_paragraph": 2.5}):
        weighted = weights(spark, index, fields)
        want = rows(lexical.bm25_topk(index.postings(), weighted, limit, 10))
        got = lexical.bm25_impact_ranges(index.postings(), index.impacts(), weighted, limit, index.n_ranges, one_of=one_of)
        assert rows(got) == want and want


def test_batches_and_shuffled_pairs(spark, index):
    weighted = weights(spark, index)
    want = rows(lexical.bm25_topk(index.postings(), weighted, 4, 10))
    got = lexical.bm25_impact_ranges(index.postings(), index.impacts(), weighted, 4, index.n_ranges, term_rows=9, pair_rows=20)
    assert rows(got) == want


def test_limits_per_query(spark, index):
    weighted = weights(spark, index)
    limits = spark.createDataFrame([(1, 2), (2, 30), (3, 1), (5, 7), (7, 5)], "query_id long, limit long")
    want = rows(lexical.bm25_topk(index.postings(), weighted, 30, 10, limits=limits))
    got = lexical.bm25_impact_ranges(index.postings(), index.impacts(), weighted, 30, index.n_ranges, limits)
    assert rows(got) == want


def test_bounds_hold_for_every_document(spark, index):
    weighted = weights(spark, index)
    bounds = {(r["query_id"], r["doc_range"]): r["bound"] for r in lexical.range_bounds(index.impacts(), weighted).collect()}
    scores = (index.postings().join(weighted, ["field", "term"]).groupBy("query_id", "doc_id", "doc_range")
              .agg(F.sum(lexical._impact()).alias("score")).collect())
    assert scores and all(r["score"] <= bounds[r["query_id"], r["doc_range"]] + 1e-9 for r in scores)
    # A range lies within one generation and holds no more documents than it may.
    sizes = index.postings().groupBy("doc_range").agg(F.count_distinct("doc_id").alias("n")).collect()
    assert max(r["n"] for r in sizes) <= index.settings.range_docs and len(sizes) <= index.n_ranges


def test_ranges_in_a_search(spark, index):
    asked = spark.createDataFrame([(1, "w0 w1 w9", 3), (2, "w17 w30", 150)], "query_id long, query string, top_k int")
    for where in (None, F.col("book_id") == "b1"):
        plain = plan.search(index, asked, SearchOptions(vectors=False, where=where))
        ranged = plan.search(index, asked, SearchOptions(vectors=False, where=where, prune_from=0, impact_ranges=True))
        assert sorted(map(str, plain.collect())) == sorted(map(str, ranged.collect()))


def test_ranges_are_left_out_and_pushed_to_the_scan(spark, tmp_path):
    corpus = build_corpus(spark.createDataFrame(paragraphs(3), RAW))
    index = build_index(spark, corpus, str(tmp_path / "i"), buckets=1, range_docs=10)
    weighted = weights(spark, index).where("query_id = 1")
    pushed = []
    def noted(column, values):
        pushed.append(len(values))
        return one_of(column, values)
    best = lexical.bm25_impact_ranges(index.postings(), index.impacts(), weighted, 2, index.n_ranges, one_of=noted)
    shown = best._jdf.queryExecution().executedPlan().toString()
    assert pushed[-1] < 12 and "doc_range" in shown.split("PushedFilters")[1]
    assert "Exchange hashpartitioning(doc_id" not in shown


def test_without_ranges_and_after_compaction(spark, tmp_path):
    corpus = build_corpus(spark.createDataFrame(paragraphs(4), RAW))
    none = build_index(spark, corpus, str(tmp_path / "none"), range_docs=0)
    asked = spark.createDataFrame([(1, "w0 w1 w9")], "query_id long, query string")
    options = SearchOptions(vectors=False, prune_from=0, impact_ranges=True)
    with pytest.raises(ValueError):
        none.impacts()
    want = sorted(map(str, plan.search(none, asked, options).collect()))
    some = build_index(spark, corpus, str(tmp_path / "some"), range_docs=7)
    whole = compact_index(some, str(tmp_path / "whole"))
    assert open_index(spark, str(tmp_path / "whole")).settings.range_docs == 7
    assert sorted(map(str, plan.search(whole, asked, options).collect())) == want
    empty = ensure_index(spark, str(tmp_path / "empty"))
    assert plan.search(empty, asked, options).count() == 0


def test_work_does_not_grow_with_the_number_of_ranges(spark, tmp_path, monkeypatch):
    corpus = build_corpus(spark.createDataFrame(paragraphs(5), RAW))
    index = build_index(spark, corpus, str(tmp_path / "i"), buckets=3, range_docs=1)
    weighted = weights(spark, index)
    batches, pushed, slices = [], [], []
    by_ranges, within = lexical._best_by_ranges, lexical._scores_within
    monkeypatch.setattr(lexical, "_best_by_ranges", lambda *a: batches.append(1) or by_ranges(*a))
    monkeypatch.setattr(lexical, "_scores_within", lambda *a: slices.append(a[3]) or within(*a))
    def noted(column, values):
        pushed.append(len(values))
        return one_of(column, values)
    got = lexical.bm25_impact_ranges(index.postings(), index.impacts(), weighted, 5, index.n_ranges, pair_rows=80)
    assert rows(got) == rows(lexical.bm25_topk(index.postings(), weighted, 5, 10)) and len(batches) == 1
    # No list is full, so every range of the 120 is scored, in slices.
    want = rows(lexical.bm25_topk(index.postings(), weighted, 200, 10))
    limits = spark.createDataFrame([(q, 200) for q in range(1, 8)], "query_id long, limit long")
    for own in (None, limits):
        slices.clear()
        got = by_ranges(index.postings(), index.impacts(), F.broadcast(weighted), 200, own, 80, noted)
        assert rows(got) == want and want
        assert len(slices) > 4 and max(slices[1:]) <= 80
    # A condition of long lists is tested row by row.
    assert pushed and max(pushed) <= 100
