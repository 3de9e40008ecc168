"""Approximate search by stored codes next to a plain computation of it."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoglot.operators import codes as c
from duoglot.operators.knn import _planes, knn_topk
from duoglot.plans.index import CONCAT, build_index, compact_index, upsert_index
from duoglot.plans.search import SearchOptions, search
from duoglot.sources.index_tables import open_index

SPEC = c.Codes(5, 4)
SCHEMA = "doc_id string, vector_name string, embedding array<float>"


def unit(rows, seed, width=12):
    v = np.random.default_rng(seed).normal(size=(rows, width)).astype(np.float32)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def tables(spark, n_docs=150, n_queries=9):
    docs, queries = unit(n_docs, 1), unit(n_queries, 2)
    d = spark.createDataFrame([(f"d{i:03}", "v", x.tolist()) for i, x in enumerate(docs)]
                              + [("none", "v", None)], SCHEMA)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)],
                              "query_id long, embedding array<float>")
    return docs, queries, d, q


def distances(vector, spec):
    margins = np.floor(vector.astype(float) @ _planes(len(vector), spec.tables * spec.bits).T * 10_000 + 0.5)
    return margins.astype(int).reshape(spec.tables, spec.bits).tolist()


def plain_probes(vector, spec, probes):
    """Every flip of signs, written out one by one."""
    found = set()
    for table, margins in enumerate(distances(vector, spec)):
        ways = []
        for signs in itertools.product((0, 1), repeat=spec.bits):
            cost = sum(m * m for m, s in zip(margins, signs) if s != (m >= 0))
            ways.append((cost, int("".join(map(str, signs)), 2)))
        found |= {(table << spec.bits) + code for _, code in sorted(ways)[:probes]}
    return found


@pytest.mark.parametrize("probes", [1, 3, 16, 99])
def test_probes(spark, probes):
    _, queries, _, q = tables(spark)
    rows = c.probe_rows(q, SPEC, probes).collect()
    assert len(rows) == len(queries) * SPEC.tables * min(probes, 16)
    for i, vector in enumerate(queries):
        assert {r["bucket"] for r in rows if r["query_id"] == i} == plain_probes(vector, SPEC, probes)


@pytest.mark.parametrize("shared", [1, 2, 4])
def test_nearest_of_met_documents(spark, shared):
    docs, queries, d, q = tables(spark)
    pairs = c.met_documents(c.code_rows(d, SPEC), c.probe_rows(q, SPEC, 3), shared)
    want = []
    for i, query in enumerate(queries):
        probed = plain_probes(query, SPEC, 3)
        scored = []
        for j, doc in enumerate(docs):
            own = plain_probes(doc, SPEC, 1)
            if len(own & probed) >= shared:
                scored.append((-round(float(query.astype(float) @ doc.astype(float)), 6), f"d{j:03}"))
        want += [(i, doc, -score, n + 1) for n, (score, doc) in enumerate(sorted(scored)[:7])]
    for broadcast_queries in (100, 0):
        rows = c.nearest_of(q, pairs, d, 7, broadcast_queries=broadcast_queries).collect()
        got = sorted((r["query_id"], r["doc_id"], r["vector_score"], r["vector_rank"]) for r in rows)
        assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in sorted(want)]
        assert np.allclose([s for _, _, s, _ in got], [s for _, _, s, _ in sorted(want)], atol=1e-6)


def test_all_buckets_are_the_exact_search(spark):
    _, _, d, q = tables(spark)
    pairs = c.met_documents(c.code_rows(d, SPEC), c.probe_rows(q, SPEC, 16))
    assert sorted(c.nearest_of(q, pairs, d, 5).collect()) == sorted(knn_topk(q, d, 5).collect())


def test_empty_sides_and_bounds(spark):
    _, _, d, q = tables(spark)
    none = c.met_documents(c.code_rows(d.limit(0), SPEC), c.probe_rows(q, SPEC, 3))
    assert c.nearest_of(q, none, d, 5).count() == 0
    unasked = c.met_documents(c.code_rows(d, SPEC), c.probe_rows(q.limit(0), SPEC, 3))
    assert c.nearest_of(q.limit(0), unasked, d, 5).count() == 0
    zero = spark.createDataFrame([("z", "v", [0.0] * 12)] * 2, SCHEMA)
    assert sorted(r["bucket"] for r in c.code_rows(zero, SPEC).collect()) == sorted(
        2 * [16 * t + 15 for t in range(5)])
    for wrong in ((0, 4), (3, 0), (3, c.MAX_BITS + 1)):
        with pytest.raises(ValueError):
            c.Codes(*wrong)


def paragraphs(spark, texts):
    return spark.createDataFrame([(i, "b", i, t, t) for i, t in texts.items()],
                                 f"doc_id string, book_id string, para_id string, {CONCAT} string, pali_paragraph string")


def test_index_keeps_codes_through_upserts(spark, tmp_path):
    words = "river stone cloud meadow lantern harbour winter copper".split()
    texts = {f"b:{i}": " ".join(words[(i * k) % 8] for k in range(1, 6)) for i in range(40)}
    index = build_index(spark, paragraphs(spark, texts), str(tmp_path / "index"), codes=c.Codes(6, 3))
    index = upsert_index(index, paragraphs(spark, {"b:3": "harbour winter", "b:77": "winter harbour harbour"}))
    index = open_index(spark, index.path)
    assert index.settings.codes == c.Codes(6, 3)
    assert index.codes().count() == 6 * 41
    assert index.codes(buckets=list(range(8))).where("bucket >= 8").count() == 0
    queries = spark.createDataFrame([(1, "winter harbour", 1.0), (2, "stone cloud river", 1.0)],
                                    "query_id long, query string, alpha double")
    whole = SearchOptions(probes=8, top_k=12)
    columns = ("query_id", "rank", "doc_id", "score")
    exact = sorted(search(index, queries, SearchOptions(top_k=12)).select(*columns).collect())
    assert sorted(search(index, queries, whole).select(*columns).collect()) == exact
    again = compact_index(index, str(tmp_path / "compacted"))
    assert again.codes().count() == 6 * 41
    only = SearchOptions(probes=8, where=F.col("doc_id") == "b:77")
    assert [r["doc_id"] for r in search(again, queries, only).collect()] == ["b:77"] * 2


def test_search_by_codes_needs_codes(spark, tmp_path):
    index = build_index(spark, paragraphs(spark, {"b:1": "a"}), str(tmp_path / "plain"))
    queries = spark.createDataFrame([(1, "a", 1.0)], "query_id long, query string, alpha double")
    with pytest.raises(ValueError, match="no codes"):
        search(index, queries, SearchOptions(probes=2)).collect()
