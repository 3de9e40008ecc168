"""Postings and bounds are formed where the texts are; what a build and a search move and read."""

import glob

import pytest
from pyspark.sql import functions as F

from duoglot.functions.text import tokens
from duoglot.operators import lexical
from duoglot.operators.corpus import build_corpus
from duoglot.plans.index import build_index
from duoglot.sources.index_tables import one_of

FIELDS = ("multilingual_concat", "pali_paragraph")


def docs(spark):
    texts = [None, "", "...", "a b a", "ā Ā x", "long " * 40 + "b"] + [f"w{i % 5} w{i % 7} b" for i in range(60)]
    return spark.createDataFrame([(f"d{i:03}", i // 4, t, t if i % 3 else None) for i, t in enumerate(texts)],
                                 "doc_id string, doc_range long, multilingual_concat string, pali_paragraph string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_postings_count_words_without_grouping(spark):
    found = lexical.postings(docs(spark), FIELDS, ["doc_range"])
    assert found.dtypes == [("doc_id", "string"), ("field", "string"), ("term", "string"), ("tf", "bigint"),
                            ("dl", "int"), ("doc_range", "bigint")]
    wanted = None
    for name in FIELDS:
        words = docs(spark).select("doc_id", F.lit(name).alias("field"), F.explode(tokens(name)).alias("term"),
                                   F.size(tokens(name)).alias("dl"), "doc_range")
        part = words.groupBy("doc_id", "field", "term", "dl", "doc_range").agg(F.count(F.lit(1)).alias("tf"))
        wanted = part if wanted is None else wanted.unionByName(part)
    assert rows(found) == rows(wanted.select(*found.columns))
    assert "Aggregate" not in plan(found) and "Exchange" not in plan(found)


@pytest.mark.parametrize("run_rows", [1, 7, 1_000_000])
def test_bounds_of_neighbours_are_those_of_the_postings(spark, run_rows):
    some = docs(spark).coalesce(1)
    found = lexical.impacts_of_docs(some, FIELDS, run_rows)
    wanted = lexical.impact_ranges(lexical.postings(some, FIELDS, ["doc_range"]))
    assert found.columns == wanted.columns and rows(found) == rows(wanted)
    assert "Exchange" not in plan(found) and "Sort" not in plan(found)


def test_index_keeps_ranges_together_and_small(spark, tmp_path):
    # Later buckets have larger files: read by size, not by bucket, they would come in another order.
    raw = [(f"b{i % 3}", str(i), " ".join(f"w{i}x{j}" for j in range(i * i % 97)), f"t{i % 4} text") for i in range(100)]
    corpus = build_corpus(spark.createDataFrame(
        raw, "book_id string, para_id string, pali_paragraph string, translation_paragraph string"))
    index = build_index(spark, corpus, str(tmp_path / "i"), FIELDS, buckets=5, range_docs=8)
    assert rows(index.impacts()) == rows(lexical.impact_ranges(index.postings()).select(*index.impacts().columns))
    for kind in ("docs", "postings", "vectors", "impacts", "term_stats"):
        files = glob.glob(f"{tmp_path}/i/{kind}/**/*.parquet", recursive=True)
        assert files and all(".zstd." in name for name in files)
    for name in glob.glob(f"{tmp_path}/i/postings/**/*.parquet", recursive=True):
        ranges = [r[0] for r in spark.read.parquet(name).coalesce(1).select("doc_range").collect()]
        assert ranges == sorted(ranges)


def test_batches_are_filled(spark, tmp_path, monkeypatch):
    assert lexical._batches({0: (3, 1), 1: (5, 1), 2: (4, 1), 3: (20, 1)}, (8, 9)) == [[3], [1, 0], [2]]
    raw = [(f"b{i % 3}", str(i), f"w{i % 5} w{i % 7} w{i % 11}", None) for i in range(80)]
    corpus = build_corpus(spark.createDataFrame(
        raw, "book_id string, para_id string, pali_paragraph string, translation_paragraph string"))
    index = build_index(spark, corpus, str(tmp_path / "i"), buckets=2, range_docs=4)
    asked = spark.createDataFrame([(q, f"w{q % 5}") for q in range(40)], "query_id long, keyword_query string")
    weighted = lexical.weigh_terms(lexical.query_terms(asked), index.term_stats(), index.field_totals(),
                                   lexical.DEFAULT_FIELDS).checkpoint()
    batches, by_ranges = [], lexical._best_by_ranges
    monkeypatch.setattr(lexical, "_best_by_ranges", lambda *a: batches.append(1) or by_ranges(*a))
    got = lexical.bm25_impact_ranges(index.postings(), index.impacts(), weighted, 3, index.n_ranges, term_rows=21,
                                     one_of=one_of)
    assert rows(got) == rows(lexical.bm25_topk(index.postings(), weighted, 3, 40).select(*got.columns))
    assert 2 <= len(batches) <= 3
