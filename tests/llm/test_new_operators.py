"""Importance resampling, personal data and whitening against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duoglot.llm import importance, personal_data, queries, whitening


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- importance resampling -----------------------------------------------------------

def word_list(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_features(text, longest, buckets):
    words = word_list(text)
    return [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets
            for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent, least, longest, buckets, seed):
    s = Counter(b for _, t in docs for b in plain_features(t, longest, buckets))
    t = Counter(b for text in target for b in plain_features(text, longest, buckets))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc_id, text in docs:
        found = plain_features(text, longest, buckets)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(word_list(text)), len(found), weight, score, None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("length", [1, 2, 63, 64, 65, 128, 129, 4095, 4097, 300_000])
def test_crc_of_spans(length):
    data = np.frombuffer(np.random.default_rng(length).bytes(length + 200), dtype=np.uint8)
    starts = np.array([0, 100, 200])
    lengths = np.array([length, length, 1])
    want = [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts, lengths)]
    assert importance.crc32_spans(data, starts, lengths).tolist() == want


def test_features_do_not_cross_texts():
    texts = ["Ab cd", None, "ef", "", "é1-Zz " * 3, "x" * 1000 + " y", "gh"]
    row, bucket, n_words = importance.features(pa.array(texts), 3, 1000)
    want = sorted((i, b) for i, t in enumerate(texts) for b in plain_features(t, 3, 1000))
    assert sorted(zip(row.tolist(), bucket.tolist())) == want
    assert n_words.tolist() == [len(word_list(t)) for t in texts]


@pytest.mark.parametrize("longest", [1, 2])
def test_resample_equals_plain(spark, longest):
    draw = np.random.default_rng(3)
    vocabulary = ["alpha", "Beta", "GAMMA9", "дом", "e", "zeta-eta", "w" * 90]
    docs = [(int(i), " ".join(draw.choice(vocabulary, draw.integers(0, 60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (None, "alpha " * 30), (502, "beta " * 40_000)]
    docs += [(7, docs[7][1])] * 2
    target = ["beta beta alpha", None, "GAMMA9 дом"]
    table = spark.createDataFrame([(d, t, "x", 1.5) for d, t in docs], "doc_id long, text string, rank string, score double")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(table, aim, percent=25, least_words=20, longest=longest, buckets=50, seed=7)
    got = sorted(rows(found, "doc_id", "n_words", "n_features", "weight", "score", "rank"), key=repr)
    assert got == plain_resample(docs, target, 25, 20, longest, 50, 7)


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none.select("text")).collect() == []


def test_ranks_over_partitions(spark):
    table = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(40)).alias("v")).repartition(13)
    got = rows(importance.ranked(table, [F.desc("v"), F.col("id")]), "id", "v", "rank")
    want = sorted(got, key=lambda r: (-r[1], r[0]))
    assert [r[2] for r in want] == list(range(1, 5001))


# --- personal data -------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_base(text):
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PLAIN.items()
                    for m in re.finditer(pattern, text or "") if passes(kind, m.group()))


HARD = [
    "a@b.c_d@e.f and x@y z@w.v. ..@a.b", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 0001.02.3.255 1.2.3.256",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111114111 4111  1111", "+1 (555) 010-2030. +12 +1234567890123456 ++49 30 1234567-",
    "é" * 70 + "a@b.cd 😀 1.2.3.4", "4111111111111111@x.org", "+41 4111 1111 1111 1111 1.2.3.4", None, "", " ",
    "a" * 2_000, "1" * 3_000, "a-" * 1_000, "1.1." * 3_000, "a@" * 2_000, "+1" * 2_000, "1 " * 3_000,
    "x@y.z " * 3_000, "10.0.0.1 " * 700, "a.b" * 700 + "@c.de",
]
# Megabytes, where the plain patterns would take the square of the length; with what they find.
LONG = [("a" * 2_000_000, ""), ("1" * 1_000_000, ""), ("a-" * 500_000, ""), ("a@" * 500_000, ""), ("1 " * 500_000, ""),
        ("é" * 1_000_000 + " a@b.cd", "email:1000001:1000007"), ("a.b" * 400_000 + "@c.de", "email:0:1200005"),
        ("word " * 400_000 + "10.0.0.1", "ip:2000000:2000008")]


def test_base_spans_equal_plain(spark):
    texts = [*HARD, *[t for t, _ in LONG]]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = dict(rows(personal_data.personal_data(table), "doc_id", "base"))
    assert got == dict(enumerate([*map(plain_base, HARD), *[found for _, found in LONG]]))


def plain_discovery(docs, least_support=3, confident=0.8, rounds=3):
    """Values found by contexts in short texts of the form `word word identifier …`."""
    occurrences, edges = Counter(), Counter()
    for text in docs:
        letters = [w.lower() for w in re.findall(r"[^\W\d_]+", text)]
        occurrences.update(zip(letters, letters[1:]))
        taken = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in plain_base(text).split(",") if x)]
        spans = taken + [(m.start(), m.end(), None) for m in re.finditer(r"\b[A-Z0-9-]*[0-9][A-Z0-9-]*", text)
                         if not any(s < m.end() and m.start() < e for s, e, _ in taken)
                         and len(re.sub("[^0-9]", "", m.group())) >= 4]
        for start, end, kind in spans:
            before = re.search(r"([^\W\d_]+)[^\w]{1,3}([^\W\d_]+)[^\w]{1,4}$", text[:start])
            if before:
                edges[(before[1].lower(), before[2].lower()), text[start:end].lower(), kind] += 1
    found = {}
    for _ in range(rounds):
        mass, support = defaultdict(float), Counter()
        for (context, value, kind), n in edges.items():
            known = {kind: 1.0} if kind else {k: c for (v, k), c in found.items() if v == value}
            for k, c in known.items():
                mass[context, k] += n * c
                support[context, k] += 1
        good = {key: min(1.0, m / occurrences[key[0]]) for key, m in mass.items() if support[key] >= least_support}
        good = {key: c for key, c in good.items() if c >= confident}
        doubt = defaultdict(lambda: 1.0)
        for (context, value, kind) in edges:
            if kind is None:
                for (c, k), conf in good.items():
                    if c == context:
                        doubt[value, k] *= max(1 - conf, 1e-12)
        found = {key: 1 - d for key, d in doubt.items() if 1 - d >= confident}
    return {(k, v) for v, k in found}


def bootstrapping_corpus():
    docs = [f"please call us at +1 555 010 20{i:02d} today" for i in range(20)]
    docs += ["please call us at 0305-55512 today"]             # no base phone, known context
    docs += [f"my number is{s} 0305-55512 thanks" for s in ("", ":")] + [
        f"my number is +1 555 010 77{i}7 thanks" for i in range(8)]
    docs += ["my number is 77-88-99-00 thanks"]                # found in the second round
    docs += [f"send it to the office{i} at version 2.0.{i}" for i in range(5)]
    docs += [f"of the 10.0.0.{i} and of the rest of the day" for i in range(9)]
    docs += ["of the 123456 things"]                            # a common pair of words, no context
    return docs


def test_contexts_discover_identifiers(spark):
    docs = bootstrapping_corpus()
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = personal_data.personal_data(table)
    more = {(personal_data.KINDS[m["kind"]], docs[r["doc_id"]][m["start"]:m["end"]].lower())
            for r in found.collect() for m in r["more"]}
    assert more == plain_discovery(docs)
    assert ("phone", "0305-55512") in more and ("phone", "77-88-99-00") in more
    assert "123456" not in {v for _, v in more}
    for r in found.collect():
        assert r["base"] == plain_base(docs[r["doc_id"]])
        assert not r["base"] or set(r["base"].split(",")) <= set(r["spans"].split(","))


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = bootstrapping_corpus()
    table = spark.createDataFrame([(None, docs[20])] * 3 + list(enumerate(docs)), "doc_id long, text string")
    got = rows(personal_data.personal_data(table).where("doc_id IS NULL"), "spans")
    assert got == [("phone:18:28",)] * 3
    none = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.personal_data(none).collect() == []


def test_running_sums(spark):
    values = list(range(1, 1500))
    df = spark.createDataFrame([(values,), ([],), ([5],)], "v array<int>")
    got = [r[0] for r in df.select(personal_data._running(F.col("v"))).collect()]
    assert got == [[sum(values[:i]) for i in range(len(values))], [], [0]]


# --- whitening -----------------------------------------------------------------------

def vectors_table(spark, data):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in data],
                                 "vec_id long, embedding array<float>, whitened string, n int").repartition(3)


def plain_whitening(entries, count):
    x = np.array(entries, dtype=np.float64)
    n = len(x)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:count]
    return values[order], vectors[:, order], centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_equals_plain(spark):
    draw = np.random.default_rng(5)
    data = (draw.normal(size=(300, 12)) @ draw.normal(size=(12, 12))).astype(np.float32)
    table = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [(900, None), (901, [float("nan")] * 12), (902, [float("inf")] + [0.0] * 11), (903, [None] + [1.0] * 11)]
    got = whitening.whiten(vectors_table(spark, table + bad + [(None, table[0][1])]), count=5).collect()
    entries = [[math.floor(1024 * c) + 100000 for c in v] for v in data.astype(float).tolist()]
    entries.append(entries[0])
    _, _, white, explained = plain_whitening(entries, 5)
    n = len(entries)
    sums = [sum(c) for c in zip(*entries)]
    assert len(got) == n * 5 and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        at = r["vec_id"] if r["vec_id"] is not None else 300
        k = r["component"] - 1
        signs.setdefault(k, math.copysign(1, r["whitened"] * white[at, k]))
        assert abs(r["whitened"] * signs[k] - white[at, k]) < 1e-8
        assert abs(r["explained"] - explained[k]) < 1e-12
        assert int(r["deviation"]) == sum((n * x - s) ** 2 for x, s in zip(entries[at], sums))
    assert got[0]["identity_error"] < 1e-9


def test_components_are_exact_to_doubles():
    draw = np.random.default_rng(2)
    x = draw.integers(-400, 400, (60, 10)).astype(object)
    matrix = [[int(v) for v in r] for r in 60 * (x.T @ x) - np.outer(x.sum(axis=0), x.sum(axis=0))]
    primes = np.array(whitening.primes_for(whitening.coefficient_bits(matrix)))
    residues = whitening.hessenberg_polynomials(matrix, primes)
    # The polynomial modulo a prime is zero at no other place than the determinant says.
    for q, row in list(zip(primes.tolist(), residues.tolist()))[:3]:
        assert row[-1] == 1 and (row[-2] + sum(matrix[i][i] for i in range(10))) % q == 0


def test_root_counts():
    polynomial = [1]
    for root in (0, 0, 3, 7, 7, 100):
        polynomial = [a - root * b for a, b in zip([0, *polynomial], [*polynomial, 0])]
    assert [whitening.roots_above(polynomial, at) for at in (-1, 0, 2, 3, 6, 7, 99, 100)] == [6, 4, 4, 3, 3, 1, 1, 0]
    roots, bits = whitening.largest_roots(polynomial, 5)
    assert [r >> bits for r in roots] == [100, 7, 7, 3]


def test_equal_and_missing_variances(spark):
    corners = [(2 * i + s, [s * 1.0 if j == i else 0.0 for j in range(4)] + [0.5]) for i in range(4) for s in (-1, 1)]
    got = whitening.whiten(vectors_table(spark, corners), count=8).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4}        # the fifth dimension does not vary
    assert got[0]["identity_error"] < 1e-9
    assert all(abs(r["explained"] - 0.25) < 1e-12 for r in got)


def test_whitening_of_few_and_uneven_vectors(spark):
    assert whitening.whiten(vectors_table(spark, [])).collect() == []
    assert whitening.whiten(vectors_table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(vectors_table(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    assert whitening.whiten(vectors_table(spark, [(1, None), (2, [])])).collect() == []
    got = whitening.whiten(vectors_table(spark, [(1, [1.0]), (2, [1.0, 3.0]), (3, [1.0, 0.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(1, 1), (2, 1), (3, 1)]


def test_huge_entries_stay_exact(spark):
    data = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [1e10, 3.0]), (3, [5e5, -4.0])]
    moments = whitening.scatter(vectors_table(spark, data))
    def entry(c):
        return max(-(1 << 62), min(1 << 62, math.floor(1024 * float(np.float32(c)))))
    x = [[entry(c) for c in v] for _, v in data]
    want = [[4 * sum(r[i] * r[j] for r in x) - sum(r[i] for r in x) * sum(r[j] for r in x) for j in range(2)] for i in range(2)]
    assert moments.matrix == want
    assert whitening.whiten(vectors_table(spark, data)).count() == 8


# --- the registered queries ----------------------------------------------------------

def test_registered_queries_return_their_contracts(spark):
    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    found = queries.op11_importance_resampling(spark, folder)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and found.count() == n
    private = queries.op12_personal_data(spark, folder)
    assert private.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    texts = dict(rows(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text"))
    for r in private.collect():
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [base.count(k) for k in PLAIN]
    white = queries.op13_whitening(spark, folder)
    assert dict(white.dtypes)["deviation"] == "bigint" and white.first()["identity_error"] < 1e-4
