"""Every operator against brute force or the public library, on small and awkward tables:
nulls, empty and long texts, ties and repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duoglot.llm import (byte_bpe, chat_format, components, language_id, multi_index, near_dedup, packing,
                         page_text, quality, substring_dedup, token_counts)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# Extra columns with names that operators use themselves.
SCHEMA = "doc_id long, text string, n_tokens string, start int, block string, lang string, kept string"


def corpus_rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") + rng.choice(["", "x", "é"]) for _ in range(60)) for _ in range(4)]
    texts: list[str | None] = [None, "", " \n\t", "One", "it's <|endoftext|> 日本 <|endoftext|>", "a" * 3000,
                               "word " * 3000, "\u00a0x\u2003y\x1cz", "A b\nA b\nc # $ %"]
    for _ in range(60):
        texts.append(" ".join(rng.choice([*passages, "x y", "z " * 9, "Straße İstanbul ΣΑΣ"])
                              for _ in range(rng.randint(1, 4))))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[20]), (None, texts[21]), (None, None), rows[30], rows[30], (200, texts[22].upper())]
    rng.shuffle(rows)
    return [(i, t, "x", 1, None, "en", "k") for i, t in rows]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(corpus_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df, *columns):
    return Counter(tuple(row[c] for c in columns) for row in df.collect())


def test_substring_dedup(corpus, empty):
    def expected(length):
        least: dict[tuple, int] = {}
        for doc, text, *_ in corpus_rows():
            if doc is not None:
                found = split(text)
                for at in range(len(found) - length + 1):
                    window = tuple(found[at:at + length])
                    least[window] = min(doc, least.get(window, doc))
        out = Counter()
        for doc, text, *_ in corpus_rows():
            found, cut = split(text), set()
            for at in range(len(found) - length + 1) if doc is not None else ():
                if least[tuple(found[at:at + length])] < doc:
                    cut.update(range(at, at + length))
            left = " ".join(w for i, w in enumerate(found) if i not in cut)
            out[doc, len(found), len(cut), left] += 1
        return out

    for length, k in ((50, 12), (8, 3)):
        got = Counter((r.doc_id, r.n_words, r.n_removed, " ".join(split(r.kept_text)))
                      for r in substring_dedup.cut_passages(corpus, length, k).collect())
        assert got == expected(length)
    assert substring_dedup.cut_passages(empty).count() == 0


def test_substring_dedup_with_clashing_columns(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    names = ["_doc", "_key", "_spans", "doc", "text_key", "row", "spans", "start", "n", "a.b"]
    rows = [(1, passage, *["x"] * len(names)), (2, "so " + passage, *["y"] * len(names)), (3, None, *[None] * len(names))]
    table = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r["doc_id"]: r for r in substring_dedup.cut_passages(table).collect()}
    assert (got[2]["n_removed"], got[2]["kept_text"], got[1]["n_removed"]) == (60, "so", 0)
    assert [got[i][n] for i in (1, 2, 3) for n in names] == ["x"] * len(names) + ["y"] * len(names) + [None] * len(names)


def test_token_counts(corpus, empty):
    tokenizer = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(corpus, BYTES, public_tokenizers.PATTERN, ("<|endoftext|>",))
    want = Counter()
    for doc, text, *_ in corpus_rows():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want[doc, len((text or "").encode()), n, n > 512] += 1
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty, BYTES, public_tokenizers.PATTERN).count() == 0


def test_whole_tokens_are_proved():
    proved, tokenizer = token_counts.whole_tokens(BYTES), Tokenizer.from_file(BYTES)
    for text in random.Random(1).sample(sorted(proved), 500):
        if re.fullmatch(r" ?[A-Za-z]+", text):
            assert len(tokenizer.encode(text, add_special_tokens=False).ids) == 1


def test_byte_bpe_round_trip(corpus, empty):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    encoded = byte_bpe.encode(corpus, RANKS, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, r.n_tokens, bytes(r.token_ids), bytes(r.decoded))
                  for r in byte_bpe.decode(encoded, RANKS).collect())
    want = Counter()
    for doc, text, *_ in corpus_rows():
        ids = encoding.encode_ordinary(text or "")
        want[doc, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()] += 1
    assert got == want
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_merge_equals_library():
    ranks = byte_bpe.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("abcth e日é!") for _ in range(rng.randint(1, 60)))
        got = [i for w in re.findall(r"[^ ]+", piece) for i in byte_bpe.merge(w.encode(), ranks)]
        want = [i for w in re.findall(r"[^ ]+", piece) for i in encoding._encode_single_piece(w.encode())]
        assert got == want


def test_packing(corpus, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(corpus, WORDS, 256).collect()
    want = Counter()
    for doc, text, *_ in corpus_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at:at + 256]
            want[doc, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(places) <= math.ceil(total / 256) + 2
    assert packing.pack_documents(empty, WORDS, 256).count() == 0


def test_bin_completion_finds_the_optimum():
    # Best fit decreasing needs three sequences here, two are enough.
    counts = np.bincount([6, 5, 5, 4, 3, 3, 2, 2], minlength=16)
    found = packing.bin_completion(counts, 15)
    assert sum(p.times for p in found) == 2
    used = np.bincount([n for p in found for n in p.lengths for _ in range(p.times)], minlength=16)
    assert (used == counts).all()


def test_quality_statistics(corpus, empty):
    got = quality.judge(corpus, [(quality.Test("symbol_share", True, 0.1),)])
    want = Counter()
    for doc, text, *_ in corpus_rows():
        found, seen, dups, cover = split(text), set(), 0, set()
        for line in (text or "").split("\n"):
            if split(line):
                dups += line in seen
                seen.add(line)
        grams = Counter(zip(found, found[1:], found[2:]))
        for at, gram in enumerate(zip(found, found[1:], found[2:])):
            if grams[gram] > 1:
                cover.update((at, at + 1, at + 2))
        chars, symbols = sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or ""))
        failed = len(found) < 50 or 100 * len(cover) > 50 * len(found)
        want[doc, len(found), chars, symbols, dups, len(cover), failed,
             not failed and symbols <= 0.1 * chars] += 1
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   "base_failed", "kept") == want
    assert quality.judge(empty, []).count() == 0


def test_quality_rules_are_learned(spark, sf, empty):
    documents, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    rules = quality.quality_rules(documents, labels)
    judged = quality.judge(documents, rules).join(labels, "doc_id").where("NOT base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    right = counts.get((1, True), 0) + counts.get((0, False), 0)
    assert right >= 0.95 * sum(counts.values()) and not counts.get((1, False))
    assert quality.quality_rules(empty, labels) == []
    assert quality.quality_rules(documents, labels.limit(0)) == []
    assert quality.keep(documents, rules).columns == documents.columns


def test_chat_escape_is_reversible():
    rng = random.Random(4)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "|end|>", "<|turn|>", "a", "<<SYS>>", "|text|>"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text
        assert not any(control in escaped for control in chat_format.CONTROL)


def test_chat_format(spark):
    said = [(1, 0, "system", "<s>"), (1, 1, "user", None), (1, 2, "assistant", "[INST] \\</s>日"),
            (2, None, None, "x"), (2, 0, "assistant", ""), (3, 0, "user", "y"), (3, 0, "user", "y"),
            (3, 1, "assistant", "z" * 5000), (3, 2, "assistant", "<|end|>"), (None, 0, "assistant", "n")]
    schema = "conv_id long, turn long, role string, text string, token_ids string"
    table = spark.createDataFrame([(*row, "clash") for row in said], schema)
    formatted = chat_format.format_turns(table, RANKS, public_tokenizers.PATTERN)
    got = {r.conv_id: r for r in chat_format.read_back(formatted, RANKS, public_tokenizers.PATTERN).collect()}
    own = defaultdict(list)
    for conv, turn, role, text in sorted(said, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    assert set(got) == set(own)
    for conv, turns in own.items():
        learned = "".join(text for role, text in turns if role == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    nothing = chat_format.format_turns(table.limit(0), RANKS, public_tokenizers.PATTERN)
    assert chat_format.read_back(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def all_segmentations(word, model, at, known):
    """Sum of the products of all ways to cut a word, and the expected uses of each piece, by recursion."""
    def cuts(rest):
        if not rest:
            yield 1.0, ()
        for k in range(1, len(rest) + 1):
            piece = rest[:k]
            p = model.weights[known[piece], at] if piece in known else language_id.UNKNOWN if k == 1 else 0.0
            if p:
                for q, more in cuts(rest[k:]):
                    yield p * q, (piece, *more)
    found = list(cuts(word))
    total = sum(p for p, _ in found)
    uses = Counter()
    for p, pieces in found:
        for piece in pieces:
            uses[piece] += p / total
    return total, uses


@pytest.fixture(scope="module")
def piece_model():
    rng = random.Random(3)
    known = {p: i for i, p in enumerate(sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(60)}))}
    weights = np.array([[rng.random(), rng.random()] for _ in known])
    return language_id.Model(("x", "y"), known, language_id.prefix_tree(known), weights / weights.sum(axis=0))


def test_language_forward_sums_all_segmentations(piece_model):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdéz") for _ in range(rng.randint(1, 11))) for _ in range(200)]
    got = piece_model.forward(words)
    for at in (0, 1):
        want = [math.log(all_segmentations(w, piece_model, at, piece_model.pieces)[0]) for w in words]
        assert np.allclose(got[:, at], want, rtol=1e-10)


def test_language_long_words_are_not_cut(piece_model, monkeypatch):
    """Beyond 40 letters, and over the blocks of the lattice, the sums are those of plain doubles."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdéz") for _ in range(n)) for n in (41, 60, 95)]
    table = piece_model.table()
    want = [np.log(language_id.ahead(piece_model.lattice([w]), table, 1)[-1][0]) for w in words]
    monkeypatch.setattr(language_id, "BLOCK_LETTERS", 7)
    assert np.allclose(piece_model.forward(words), want, rtol=1e-10)
    assert np.isfinite(piece_model.forward(["ab" * 20_000])).all()


def test_language_expected_pieces(spark, piece_model, monkeypatch):
    words = {("x", "abcab"): 3, ("x", "ddéz"): 1, ("y", "abcab"): 2, ("y", "éééaab"): 5}
    counts = spark.createDataFrame([(*key, n) for key, n in words.items()], "lang string, word string, n long")
    want = Counter()
    for (lang, word), n in words.items():
        for piece, use in all_segmentations(word, piece_model, "xy".index(lang), piece_model.pieces)[1].items():
            if piece in piece_model.pieces:
                want[lang, piece_model.pieces[piece]] += n * use
    got = {(r.lang, r.row): r.n for r in language_id.expected_pieces(counts, piece_model).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # The same for one long word, whose sums are logarithms.
    long = spark.createDataFrame([("x", "abcdé" * 9, 2)], "lang string, word string, n long")
    uses = {r.row: r.n for r in language_id.expected_pieces(long, piece_model).collect()}
    lattice = piece_model.lattice(["abcdé" * 9])
    weights = piece_model.table()[:, :1]
    front, back = language_id.ahead(lattice, weights, 1), language_id.behind(lattice, weights, 1)
    plain = Counter()
    for s, pieces in enumerate(lattice):
        for k, _, rows in pieces:
            plain[int(rows[0])] += 2 * float(front[s][0, 0] * weights[rows[0], 0] * back[s + k][0, 0] / front[-1][0, 0])
    plain.pop(len(piece_model.pieces), None)
    assert set(uses) == set(plain) and all(abs(uses[k] - plain[k]) < 1e-9 for k in plain)


def test_language_words_keep_marks():
    assert language_id.letter_words("हिन्दी e\u0301t\u00e9 1a2 \u0301 x_y") == ["हिन्दी", "e\u0301t\u00e9", "a", "x", "y"]
    assert language_id.letter_words("Z" * 5000) == ["z" * 5000]


def test_language_id(spark, sf, corpus, empty):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    fold = language_id.fold_of()
    model = language_id.train(documents.where(fold != 2), PIECES)
    found = language_id.identify(documents.where(fold == 2), model)
    rows = found.select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    odd = {r.text: (r.lang_pred, r.score) for r in language_id.identify(corpus, model).collect()}
    assert odd[None] == odd[""] == odd[" \n\t"] == ("und", 0.0)
    assert all(0 <= score <= 1 for _, score in odd.values())
    assert language_id.train(empty, PIECES) is None
    assert {r.lang_pred for r in language_id.identify(corpus, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def brute_neighbours(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for query, q in good:
        if query % 2 == 0:
            found = sorted((-float(q @ v / (np.sqrt(q @ q) * np.sqrt(v @ v))), i) for i, v in good if i != query)
            out[query] = [(i, -s) for s, i in found[:k]]
    return out


def test_multi_index(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(80)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 2.0]) for i in range(20)]
    rows += [(200, None), (202, [0.0] * 6), (204, [float("nan")] + [1.0] * 5), (206, [None] + [1.0] * 5),
             (208, [float("inf")] + [1.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    got = defaultdict(list)
    for r in multi_index.search(table, table.where("vec_id % 2 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_neighbours(rows, 5)
    assert set(got) == set(want)
    for query, found in want.items():
        assert [round(s, 9) for _, s in got[query]] == [round(s, 9) for _, s in found]
        assert [i for i, _ in got[query]] == [i for i, _ in found]
    few = table.where("vec_id < 3")
    assert multi_index.search(few, few, k=5).count() == 6
    assert multi_index.search(table.limit(0), table.limit(0)).count() == 0


def test_multi_index_ties(spark):
    """Multiples by powers of two have exactly the same cosine: the smallest ids win."""
    base = np.random.default_rng(1).normal(size=8)
    rows = [(i, (base * 2.0 ** (i - 50)).tolist()) for i in range(100)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = multi_index.search(table, table.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_multi_index_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = multi_index.search(table, table.where("vec_id % 2 = 0"), k=5, candidates=50, share=0.6)
    got = defaultdict(set)
    for r in found.collect():
        got[r.query_id].add(r.vec_id)
    want = brute_neighbours(rows, 5)
    assert sum(len(got[q] & {i for i, _ in own}) for q, own in want.items()) >= 0.9 * 5 * len(want)


def brute_components(rows, size, percent):
    sets = defaultdict(list)
    for doc, text, *_ in rows:
        found = [w.encode().lower() for w in split(text)]
        own = set(zip(*[found[i:] for i in range(size)])) if len(found) >= size else {tuple(found)} if found else set()
        sets[doc].append(own)
    docs = [d for d in sets if d is not None]
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in docs}


def edited_rows(seed: int = 6) -> list[tuple]:
    rng = random.Random(seed)
    rows = corpus_rows()
    for group in range(3):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([6, 30, 150]))]
        for i in range(40):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 9999)}"
            rows.append((1000 + 100 * group + i, " ".join(text), "x", 1, None, "en", "k"))
    return rows


def test_near_duplicates(spark, empty, monkeypatch):
    rows = edited_rows()
    table = spark.createDataFrame(rows, SCHEMA)
    for size, block in ((4, near_dedup.CHUNK_ROWS), (5, 3)):
        monkeypatch.setattr(near_dedup, "CHUNK_ROWS", block)
        want = brute_components(rows, size, 80)
        got = near_dedup.near_duplicates(table, 0.8, size).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == want.get(r.doc_id)
            assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(7)
    pool = near_dedup.mixed(np.arange(4000, dtype=np.uint64))
    sets = [np.sort(pool[:3000]), np.sort(pool[500:3500]), np.sort(rng.permutation(pool)[:1])]
    regs, own = near_dedup.registers(sets)
    n = np.array([3000])
    assert abs(near_dedup.estimate(regs[:1], regs[1:2], n, n)[0] - 2500 / 3500) < 0.15
    assert own[2] == 1 and len(set(regs[2])) == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r.id: r.component for r in components.connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


PAGES = [
    ("http://a.example/1", "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><header>Site</header><article>"
     "<h1>T&amp;A</h1><p>One <b>two</b>.<p>Th<i>ree</i></article><section class='comments'>bad</section></body>",
     "T&A One two. Three"),
    ("http://a.example/2", "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>U</h1><p>x\n y"
     "<div class='newsletter'>Sign</div><script>var a='</p>';</script></article><footer>f</footer>", "U x y"),
    ("http://b.example/1", "<div>same words</div><div id=main>first text</div>", "first text"),
    ("http://b.example/2", "<div>same words</div><div id=main>second text</div>", "second text"),
    ("http://b.example/3", "<div>same words</div><div id=main>third &eacute;</div>", "third \u00e9"),
    (None, "plain < text <b>bold", "plain < text bold"), (None, None, ""), ("bad url", "", ""),
    ("http://c.example", "<p class=\"x>unclosed " + "a" * 2000, None)]


def test_page_text(spark):
    rows = [(i, url, page, "clash") for i, (url, page, _) in enumerate(PAGES)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for hosts in (100_000, 0):
        got = {r.page_id: r for r in page_text.extract(table, broadcast_hosts=hosts).collect()}
        assert len(got) == len(PAGES)
        for i, (url, _, text) in enumerate(PAGES):
            assert got[i].url == url and got[i].n_chars == len(got[i].text)
            if text is not None:
                assert got[i].text == text
    assert page_text.extract(table.limit(0)).count() == 0


def neutral_host(host, n, optional=()):
    """Pages without telling names: a frame of equal text, links that change, an article of two blocks, an aside on some."""
    rows = []
    for i in range(n):
        links = "".join(f"<li><a href=/{i}{k}>go {i} {k}</a></li>" for k in range(9))
        aside = "<div class=k7><div class=k8>always this</div></div>" if i in optional else ""
        rows.append((f"http://{host}/{i}", f"<html><body><div class=k1><h1>Site of all</h1>We sell lamps</div><ul class=k2>{links}</ul>"
                     f"<div class=k3><div class=k4><h1>Title {i}</h1>by writer {i * 7}</div><div class=k5><p>Body {i} "
                     f"<i>goes</i> on {'and on ' * (i + 9)}</p>{aside}<p>End {i}</p></div></div><div class=k6>All rights</div>",
                     f"Title {i} by writer {i * 7} Body {i} goes on {'and on ' * (i + 9)}End {i}"))
    return rows


def test_page_text_by_classes_alone(spark):
    rows = neutral_host("n.example", 12, {1, 4, 5, 7, 8, 9, 11}) + neutral_host("m.example", 4)
    rows += [(url, page, text) for url, page, text in rows[:3]]
    table = spark.createDataFrame([(i, url, page) for i, (url, page, _) in enumerate(rows)],
                                  "page_id long, url string, html string")
    template = {r.host: r for r in page_text.templates(page_text.occurrences(table, "html", "url"), table, "url").collect()}
    assert {r.region for r in template.values()} == {"html/body/div.k3"}
    assert set(template["n.example"].template_text) == {"html/body/div.k1", "html/body/div.k6",
                                                       "html/body/div.k3/div.k5/div.k7/div.k8"}
    assert template["n.example"].dull == ["html/body/ul.k2"]
    for hosts in (100_000, 0):
        got = {r.page_id: r.text for r in page_text.extract(table, broadcast_hosts=hosts).collect()}
        assert got == {i: text for i, (*_, text) in enumerate(rows)}


def test_equivalence_classes(spark):
    rows = neutral_host("n.example", 9, {1, 4, 5, 7, 8}) + neutral_host("m.example", 4, {0})
    table = spark.createDataFrame([(i, url, page) for i, (url, page, _) in enumerate(rows)],
                                  "page_id long, url string, html string")
    tokens = page_text.supported(page_text.occurrences(table, "html", "url"), table, "url")
    found = page_text.classes(tokens)
    got = {}
    for r in tokens.join(found.drop("support"), ["host", "vector", "pages"]).collect():
        got.setdefault((r.host, r.vector, r.pages, r.size, r.valid, r.slot), set()).add(r.token)
    want = {}
    for host, n in (("n.example", 9), ("m.example", 4)):
        counts = [page_text.read_page(page)[0] for url, page, _ in rows if host in url]
        for token in set().union(*counts):
            want.setdefault((host, tuple(c.get(token, 0) for c in counts)), set()).add(token)
    assert sorted((k[0], sorted(v)) for k, v in got.items()) == sorted((k[0], sorted(v)) for k, v in want.items())
    for (host, vector), members in want.items():
        key = next(k for k, v in got.items() if k[0] == host and v == members)
        seen = [n for n in vector if n]
        assert key[2:5] == (len(seen), len(members), max(seen) == 1 and 2 * len(seen) >= len(vector))
        paths = [t.partition(">")[0].split("/") for t in members]
        around = [p for p in range(len(paths[0]) + 1) if all(q[:p] == paths[0][:p] for q in paths)
                  and "/".join(paths[0][:p]) not in members]
        assert key[5] == "/".join(paths[0][:max(around)])
    optional = [k for k, v in got.items() if "html/body/div.k3/div.k5/div.k7" in v]
    assert {k[5] for k in optional} == {"html/body/div.k3/div.k5"} and sorted(k[4] for k in optional) == [False, True]


def test_pages_nested_very_deep(spark):
    page = "<article>" + "<div class=x>" * 30_000 + "inner text" + "<div class=ad>buy <div>now</div></div>" + "</div>" * 30_000 + " end"
    table = spark.createDataFrame([(1, "http://d.example/1", page)], "page_id long, url string, html string")
    assert page_text.extract(table).first().text == "inner text end"


def test_small_tables_are_not_dealt_over_many_files(spark):
    import glob

    from duoglot.llm import common
    assert len(common.stored(spark.range(0, 100, 1, 20), "few").inputFiles()) > 1
    kept = common.stored(spark.range(0, 100, 1, 20), "few", 100, file_rows=50)
    assert len(kept.inputFiles()) == 2 and sorted(r.id for r in kept.collect()) == list(range(100))
    assert common.stored(spark.range(0), "none", 0).count() == 0
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(name, None) for name in names]
    try:
        for name, value in zip(names, ("20", "false")):
            spark.conf.set(name, value)
        links = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
        common.work_folder(spark)
        there = lambda: len(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/rdd-*/part-*"))
        old = there()
        got = components.connected_components(links)
        new = there() - old
        assert {r.id: r.component for r in got.collect()} == {i: 0 for i in range(51)}
        assert 20 < new < 40  # the first links, then a file a round
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_pipeline_of_many_small_files_writes_few(spark, tmp_path):
    import corpus_pipeline

    from duoglot.llm import common
    text = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(i, f"{text} {i}") for i in range(80)], "doc_id long, text string").repartition(40).write.parquet(
        str(tmp_path / "documents.parquet"))
    size = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a partition for each file
    try:
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert docs.rdd.getNumPartitions() == 40
        assert common.gathered(docs).rdd.getNumPartitions() == common.LEAST_PARTS
        packed = corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))
        assert packed.count() == 80 and packed.rdd.getNumPartitions() <= common.LEAST_PARTS
        assert common.gathered(docs.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", size)
