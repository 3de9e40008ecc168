import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import types as T

from duoglot.functions import vectors
from duoglot.operators import encode, knn, quality

SENTENCES = ["Hello world", "This is a test sentence", "नमस्ते दुनिया", "こんにちは世界", "three", "a", "3", "!", ""]


def brute_hash(text):
    v = np.zeros(768)
    for term in (text.lower().replace("!", "").split() or [""]):
        digest = hashlib.md5(term.encode()).hexdigest()
        v[int(digest[:7], 16) % 768] += 1 if digest[7] < "8" else -1
    return v / np.linalg.norm(v)


def encoded(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r["id"]: np.array(r["embedding"]) for r in encode.hash_encode(df, ["id"], "text", **options).collect()}


def test_hash_encoder_matches_its_definition(spark):
    found = encoded(spark, SENTENCES)
    assert len(found) == len(SENTENCES)
    for i, text in enumerate(SENTENCES):
        assert found[i].shape == (768,)
        assert np.allclose(found[i], brute_hash(text), atol=1e-6)
        assert abs(np.linalg.norm(found[i]) - 1) < 1e-5


def test_hash_encoder_is_deterministic_and_can_skip_normalising(spark):
    assert all((a == b).all() for a, b in zip(encoded(spark, SENTENCES).values(),
                                              encoded(spark, SENTENCES).values()))
    raw = encoded(spark, ["a a b"], normalize=False)[0]
    assert sorted(abs(raw[raw != 0])) == [1, 2]


def test_normalize_dot_and_cosine(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(
        vectors.l2_normalize("a").alias("u"), vectors.l2_normalize("z").alias("z"),
        vectors.dot("a", "a").alias("d"), vectors.cosine(vectors.l2_normalize("a"), vectors.l2_normalize("a")).alias("c")).first()
    assert np.allclose(row["u"], [0.6, 0.8]) and row["z"] == [0.0, 0.0]
    assert row["d"] == 25.0 and row["c"] == 1.0


def toy_vectors(texts):
    return np.array([[len(t), sum(map(ord, t)) % 97 + 1.0] for t in texts])


def toy_encoder():
    def make():
        import numpy

        def predict(texts):
            return numpy.array([[len(t), sum(map(ord, t)) % 97 + 1.0] for t in texts])
        return predict
    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=encode.MODEL_BATCH)


@pytest.mark.parametrize("reuse", [True, False])
def test_model_plug_in(spark, reuse):
    rows = [(i, "same text" if i % 3 else None) for i in range(60)] + [(60, "other"), (61, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = encode.encode(df, "text", toy_encoder(), id_col="id", reuse=reuse, rows_per_split=5).collect()
    assert sorted(r["id"] for r in out) == list(range(62))
    for r in out:
        want = toy_vectors([r["text"] or ""])[0]
        assert np.allclose(r["embedding"], want / np.linalg.norm(want), atol=1e-6)


def test_empty_texts_can_be_an_error(spark):
    df = spark.createDataFrame([(1, "")], "id long, text string")
    with pytest.raises(Exception, match="cannot encode an empty text"):
        encode.encode(df, "text", toy_encoder(), reuse=False, on_empty="error").collect()
    with pytest.raises(ValueError):
        encode.encode(df, "text", toy_encoder(), reuse=False, on_empty="skip")


def test_nothing_in_nothing_out(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert encode.hash_encode(df, ["id"], "text").count() == 0
    assert encode.encode(df, "text", toy_encoder()).count() == 0


def test_named_texts(spark):
    df = spark.createDataFrame([("d", "p", None)], "doc_id string, pali_paragraph string, translation_paragraph string")
    rows = encode.named_texts(df, {"pali": "pali_paragraph", "en": "translation_paragraph"})
    assert {r["vector_name"]: r["text"] for r in rows.collect()} == {"pali": "p", "en": "", "multilingual": "p"}
    with pytest.raises(ValueError):
        encode.named_texts(df, {"pali": "pali_paragraph", "zh": "absent"})


def unit_rows(n, width, seed, copies=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, width))
    if copies:
        m[-copies:] = m[0]
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    return m


def brute_knn(q, d, k, skip=False):
    out = {}
    s = np.floor(np.abs(q.astype(float) @ d.astype(float).T) * 1e6 + 0.5) / 1e6 * np.sign(q.astype(float) @ d.astype(float).T)
    for i in range(len(q)):
        ids = [j for j in range(len(d)) if not (skip and i == j)]
        out[i] = sorted(ids, key=lambda j: (-s[i, j], f"d{j:04d}" if not skip else j))[:k]
    return out


@pytest.mark.parametrize("options", [{}, {"broadcast_queries": 0, "tile_queries": 7, "tile_docs": 11},
                                     {"broadcast_queries": 0}])
def test_knn_is_exact_with_many_copies(spark, options):
    q, d = unit_rows(20, 16, 1), unit_rows(300, 16, 2, copies=100)   # a third are copies
    q[0] = d[0]
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    ds = spark.createDataFrame([(f"d{i:04d}", v.tolist()) for i, v in enumerate(d)] + [("none", None)],
                               "doc_id string, embedding array<float>")
    got = {}
    for r in knn.knn_topk(qs, ds, 15, **options).orderBy("query_id", "vector_rank").collect():
        got.setdefault(r["query_id"], []).append(int(r["doc_id"][1:]))
    assert got == brute_knn(q, d, 15)


def test_large_limit_uses_two_stage_ranking(spark):
    q, d = unit_rows(2, 8, 3), unit_rows(1500, 8, 4)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    ds = spark.createDataFrame([(f"d{i:04d}", v.tolist()) for i, v in enumerate(d)], "doc_id string, embedding array<float>")
    rows = knn.knn_topk(qs, ds, 1200).orderBy("query_id", "vector_rank").collect()
    want = brute_knn(q, d, 1200)
    assert [int(r["doc_id"][1:]) for r in rows] == want[0] + want[1]


def test_widths_must_agree(spark):
    qs = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    ds = spark.createDataFrame([("a", [1.0])], "doc_id string, embedding array<float>")
    with pytest.raises(Exception, match="different width"):
        knn.knn_topk(qs, ds, 1).collect()


def test_lsh_finds_most_neighbours(spark):
    rng = np.random.default_rng(5)
    base = unit_rows(40, 32, 6)
    d = np.repeat(base, 8, axis=0) + rng.normal(scale=0.05, size=(320, 32))
    d = (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)
    ds = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id long, embedding array<float>")
    qs = ds.withColumnRenamed("doc_id", "query_id")
    near = {(r["query_id"], r["doc_id"]) for r in knn.knn_topk(qs, ds, 5, lsh=(8, 6), tile_docs=50).collect()}
    exact = {(r["query_id"], r["doc_id"]) for r in knn.knn_topk(qs, ds, 5).collect()}
    assert len(near & exact) / len(exact) > 0.95


def test_vector_audit_finds_faults(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0, 0.0])], "doc_id long, embedding array<float>")
    row = quality.vector_audit(df).first()
    assert (row["n_vectors"], row["min_dim"], row["max_dim"], row["n_zero"], row["n_not_unit"]) == (3, 2, 3, 1, 2)


def test_nearest_other_and_pairs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "doc_id long, embedding array<float>")
    rows = {r["doc_id"]: (r["nearest_id"], r["is_distinct"]) for r in quality.nearest_other(df).collect()}
    assert rows == {1: (2, False), 2: (1, False), 3: (1, True)}
    pairs = spark.createDataFrame([(1, 3), (3, 1), (1, 1)], "left_id long, right_id long")
    sims = {(r["left_id"], r["right_id"]): r["similarity"] for r in quality.pair_similarity(pairs, df).collect()}
    assert sims[(1, 3)] == sims[(3, 1)] == 0.0 and math.isclose(sims[(1, 1)], 1.0)


def test_stored_vectors_are_reused(spark, tmp_path, monkeypatch):
    """A model that stamps what it computes: later jobs get the stamps of the first one."""
    store = str(tmp_path / "store")

    def model(stamp):
        return lambda text: F.array(F.length(text).cast("float"), F.lit(float(stamp)).cast("float"))

    first = spark.createDataFrame([(i, f"text {i % 4}") for i in range(20)] + [(20, None)], "id long, text string")
    got = encode.encode(first, "text", model(1), normalize=False, store=store)
    assert {tuple(r["embedding"]) for r in got.collect()} == {(6.0, 1.0), (0.0, 1.0)} and got.count() == 21
    assert spark.read.parquet(store).count() == 5
    for few in (1_000, 0):
        monkeypatch.setattr(encode, "FETCH_IDS", few)
        more = spark.createDataFrame([(1, "text 1"), (2, ""), (3, f"other {few}")], "id long, text string")
        rows = encode.encode(more, "text", model(2), normalize=False, store=store).collect()
        assert {r["id"]: r["embedding"][1] for r in rows} == {1: 1.0, 2: 1.0, 3: 2.0}
    assert spark.read.parquet(store).count() == 7
    assert encode.encode(first.limit(0), "text", model(3), store=store).count() == 0


def test_text_vectors_are_those_of_the_encoder_without_a_shuffle(spark):
    from duoglot.operators import encode, words
    texts = [("a", "x y x 你好 Ünï x"), ("b", ""), ("c", None), ("d", "!!"), ("e", "é é"), ("f", "w " * 5000),
             ("g", " ".join(f"w{i}" for i in range(3000)))]
    df = spark.createDataFrame(texts, "doc_id string, text string").coalesce(1)
    found = encode.text_vectors(df, ["doc_id"], "text")
    assert "Exchange" not in found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    want = {r[0]: list(r[1]) for r in encode.hash_encode(df, ["doc_id"], "text").collect()}
    assert {r[0]: list(r[1]) for r in found.collect()} == want and len(want) == len(texts)


def test_words_in_parts(monkeypatch):
    import pyarrow as pa
    from duoglot.operators import words
    monkeypatch.setattr(words, "PART_WORDS", 3)
    monkeypatch.setattr(words, "PART_ROWS", 2)
    lists = [["a", "b"], ["a"], ["c"] * 5, [], [], [], ["d", "a"], ["e"]]
    whole = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([["z"], *lists])], names=["n", "words"])
    got = []
    for part, row, terms, code in words.word_rows(whole.slice(1)):
        assert part.num_rows <= 2
        found = [[] for _ in range(part.num_rows)]
        for r, c in zip(row, code):
            found[r].append(terms[int(c)].as_py())
        got += list(zip(part.column("n").to_pylist(), found))
    assert got == list(zip(range(1, 9), lists))


def test_batch_model_looks_at_a_character_once(monkeypatch):
    import unicodedata
    from duoglot_checks import queries
    seen, category = [], unicodedata.category
    predict = queries._hashing_model()
    monkeypatch.setattr(unicodedata, "category", lambda c: seen.append(c) or category(c))
    out = predict(["ab ab, ba", "", "ab", " "])
    assert len(seen) == len(set(seen)) and (out[1] == out[3]).all() and (out[0] != 0).sum() <= 2
    assert abs(out[0]).sum() == 3 and abs(out[2]).sum() == 1


def test_small_tiles_do_not_multiply_the_rows(spark, monkeypatch):
    import numpy as np
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(120, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[60:70] = vectors[50:60]          # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, embedding array<float>")
    queries = rows.withColumnRenamed("doc_id", "query_id").withColumn("_limit", F.lit(5).cast("long"))
    parts = []
    real = F.ceil
    monkeypatch.setattr(knn.F, "ceil", lambda c: parts.append(real(c)) or real(c))
    one = F.lit(0).alias("_all")
    found = knn._tiled(queries.select("*", one), rows.select("*", one), ["_all"], False, 3, 4)
    # One list of each query: both sides are one part, however small the tiles.
    assert found.count() == 120 * 5 and len(parts) == 2
    monkeypatch.setattr(knn, "HELD_CELLS", 1)
    assert knn._tiled(queries.select("*", one), rows.select("*", one), ["_all"], False, 30, 40).count() > 120 * 5
    exact = np.floor(np.abs(vectors.astype(float) @ vectors.T.astype(float)) * 1e6 + 0.5) / 1e6 * np.sign(vectors.astype(float) @ vectors.T)
    for skip in (False, True):
        for options in ({}, {"broadcast_queries": 0, "tile_queries": 3, "tile_docs": 4}):
            got = {}
            for r in knn.knn_topk(queries.drop("_limit"), rows, 5, skip_same=skip, **options).collect():
                got.setdefault(r["query_id"], {})[r["vector_rank"]] = (r["doc_id"], r["vector_score"])
            for q in range(120):
                order = [int(d) for d in np.lexsort((np.arange(120), -exact[q])) if not (skip and d == q)][:5]
                assert [got[q][i + 1][0] for i in range(5)] == order


@pytest.mark.parametrize("options", [{}, {"broadcast_queries": 0, "tile_queries": 3, "tile_docs": 4}])
def test_an_id_that_comes_often_is_still_left_out(spark, options):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(30, 4))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors) for _ in range(4)],
                                 "doc_id long, embedding array<float>")
    found = knn.knn_topk(rows.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "query_id"), rows, 1,
                         skip_same=True, **options).collect()
    scores = vectors @ vectors.T - 9 * np.eye(30)
    assert {r["query_id"]: r["doc_id"] for r in found} == {i: int(scores[i].argmax()) for i in range(30)}
