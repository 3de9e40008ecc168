"""Language identification by unigram piece models that sum over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability per piece.
The probability of a word is the sum over every way to cut it into pieces, by the
forward algorithm; a text's is the product over its words. Training counts the words of each
language in one shuffle with map-side sums, and re-estimates the probabilities by expectation-maximisation over the distinct
words: expected piece counts of all segmentations, summed by piece in Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F, types as T

from duoglot.llm.common import chunks, no_finer, stored

MAX_LANGUAGES = 200
# Letters and the marks that combine with them; a run begins with a letter.
LETTER_RUNS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PIECES = regex.compile(r"[\p{L}\p{M}]+")
PLAIN_DOUBLES = 40   # letters; the sums of longer words would leave the range of doubles: logarithms
BLOCK_LETTERS = 5_000
TOGETHER = 60_000    # letters whose lattices are formed at once
REMEMBERED = 400_000
UNDETERMINED = "und"
UNKNOWN = 1e-7       # probability of a letter that is no piece


def vocabulary(path: str) -> list[str]:
    """Letter pieces of a sentencepiece model, lower case, without word marks."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).replace("\u2581", "").lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if PIECES.fullmatch(p)})


def letter_words(text: str | None) -> list[str]:
    """Runs of letters in lower case, whatever their length."""
    return LETTER_RUNS.findall(text.lower()) if text else []


def prefix_tree(pieces: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, targets, rows)``: edges as sorted ``node * 2**21 + code point`` with the node they lead
    to, and the row of the piece that ends at each node, or -1. Node 0 is the root."""
    edges, ends = {}, [-1]
    for piece, row in pieces.items():
        node = 0
        for letter in piece:
            key = node << 21 | ord(letter)
            if key not in edges:
                edges[key] = len(ends)
                ends.append(-1)
            node = edges[key]
        ends[node] = row
    keys = np.array(sorted(edges), np.int64)
    return keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64)


@dataclass(frozen=True)
class Model:
    """Sent to executors as a plain tuple of its fields."""

    languages: tuple[str, ...]
    pieces: dict[str, int]      # piece → row
    tree: tuple[np.ndarray, np.ndarray, np.ndarray]
    weights: np.ndarray         # (pieces, languages): probabilities

    def parts(self) -> tuple:
        return self.languages, self.pieces, self.tree, self.weights

    def table(self) -> np.ndarray:
        """The probabilities, and a last row for letters that are no piece."""
        return np.vstack([self.weights, np.full(len(self.languages), UNKNOWN)])

    def lattice(self, words: list[str]) -> list[list[tuple]]:
        """For words of one length: for each start the pieces found there, as ``(letters, words,
        rows)``; ``words`` is None where all words have one (a single letter, known or not)."""
        keys, targets, ends = self.tree
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes.reshape(n, size).T.astype(np.int64).ravel()     # by letter, then by word
        starts = np.arange(n * size)
        nodes = np.zeros(n * size, np.int64)
        out: list[list[tuple]] = [[] for _ in range(size)]
        k = 0
        while len(starts):
            k += 1
            if len(keys):
                key = nodes << 21 | codes[starts + (k - 1) * n]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                on = keys[at] == key
                nodes = targets[at[on]]
            else:
                on, nodes = np.zeros(len(starts), bool), nodes[:0]
            if k == 1:
                rows = np.full(n * size, len(self.pieces), np.int64)
                found = ends[nodes]
                rows[on] = np.where(found >= 0, found, len(self.pieces))
                for s in range(size):
                    out[s].append((1, None, rows[s * n:(s + 1) * n]))
                starts = starts[on]
            else:
                starts = starts[on]
                is_piece = ends[nodes] >= 0
                place, rows = starts[is_piece], ends[nodes[is_piece]]
                cuts = np.searchsorted(place, np.arange(size + 1) * n)
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[s], cuts[s + 1])
                    out[s].append((k, place[part] - s * n, rows[part]))
            room = starts < (size - k) * n
            starts, nodes = starts[room], nodes[room]
        return out

    def blocks(self, word: str, backward: bool = False) -> Iterator[tuple[int, list]]:
        """The lattice of one long word, some thousand starts at a time."""
        reach = max(map(len, self.pieces), default=1) - 1
        begins = range(0, len(word), BLOCK_LETTERS)
        for begin in reversed(begins) if backward else begins:
            yield begin, self.lattice([word[begin:begin + BLOCK_LETTERS + reach]])[:BLOCK_LETTERS]

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of every word in every language, all segmentations summed."""
        out = np.empty((len(words), len(self.languages)))
        table, by_size = self.table(), {}
        for at, word in enumerate(words):
            by_size.setdefault(len(word), []).append(at)
        for size, places in by_size.items():
            if size > PLAIN_DOUBLES:
                for i in places:
                    out[i] = log_sums(self, words[i], np.log(table))[-1]
                continue
            step = max(1, TOGETHER // size)
            for first in range(0, len(places), step):
                some = places[first:first + step]
                out[some] = np.log(ahead(self.lattice([words[i] for i in some]), table, len(some))[-1])
        return out


def ahead(lattice: list[list[tuple]], weights: np.ndarray, n: int) -> list[np.ndarray]:
    """Forward sums after 0, 1, … letters, each ``(words, columns of weights)``."""
    sums = [np.ones((n, weights.shape[1]))] + [np.zeros((n, weights.shape[1])) for _ in lattice]
    for s, pieces in enumerate(lattice):
        for k, words, rows in pieces:
            if words is None:
                sums[s + k] += sums[s] * weights[rows]
            else:
                sums[s + k][words] += sums[s][words] * weights[rows]
    return sums


def behind(lattice: list[list[tuple]], weights: np.ndarray, n: int) -> list[np.ndarray]:
    """Backward sums before the end, from every letter on."""
    sums = [np.zeros((n, weights.shape[1])) for _ in lattice] + [np.ones((n, weights.shape[1]))]
    for s in range(len(lattice) - 1, -1, -1):
        for k, words, rows in lattice[s]:
            if words is None:
                sums[s] += sums[s + k] * weights[rows]
            else:
                sums[s][words] += sums[s + k][words] * weights[rows]
    return sums


def log_sums(model: Model, word: str, logs: np.ndarray, backward: bool = False) -> np.ndarray:
    """The sums of one word as logarithms, ``(letters + 1, columns)``."""
    out = np.full((len(word) + 1, logs.shape[1]), -np.inf)
    out[-1 if backward else 0] = 0.0
    for begin, lattice in model.blocks(word, backward):
        places = range(len(lattice))
        for s in reversed(places) if backward else places:
            for k, _, rows in lattice[s]:
                low, high = begin + s, begin + s + k
                to, source = (low, high) if backward else (high, low)
                np.logaddexp(out[to], out[source] + logs[rows[0]], out=out[to])
    return out


def word_counts(documents: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, word, n)``; each task sums what it has read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            langs = [lang for lang, own in held.items() for _ in range(len(own))]
            found = [word for own in held.values() for word in own]
            counts = [n for own in held.values() for n in own.values()]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(counts, pa.int64())],
                names=["lang", "word", "n"])

        for part in chunks(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, held.values())) > REMEMBERED:
                yield flush()
        yield flush()

    rows = documents.selectExpr(f"`{lang_col}` AS lang", f"`{text_col}` AS text").where(
        "lang IS NOT NULL AND text IS NOT NULL")
    return (rows.mapInArrow(run, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def expected_pieces(counts: DataFrame, model: Model) -> DataFrame:
    """``(lang, row, n)``: expected uses of each piece, forward times backward over total."""
    shared = counts.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        index = {lang: i for i, lang in enumerate(model.languages)}
        size = len(model.pieces)
        totals, table = np.zeros((size + 1, len(model.languages))), model.table()

        def add(lattice, weights, uses_of, at) -> None:
            found = [(rows, uses_of(s, k, words, weights[rows])) for s, pieces in enumerate(lattice)
                     for k, words, rows in pieces]
            totals[:, at] += np.bincount(np.concatenate([r for r, _ in found]),
                                         np.concatenate([u for _, u in found]), size + 1)

        for batch in batches:
            groups: dict[tuple[str, int], list] = {}
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                groups.setdefault((lang, len(word)), []).append((word, n))
            for (lang, letters), found in groups.items():
                at = index[lang]
                weights = table[:, at:at + 1]
                if letters > PLAIN_DOUBLES:
                    logs = np.log(weights)
                    for word, n in found:
                        front, back = log_sums(model, word, logs), log_sums(model, word, logs, backward=True)
                        for begin, lattice in model.blocks(word):
                            add(lattice, logs, lambda s, k, _, w: n * np.exp(
                                front[begin + s] + w[0] + back[begin + s + k] - front[-1]), at)
                    continue
                step = max(1, TOGETHER // letters)
                for first in range(0, len(found), step):
                    some, counts_ = zip(*found[first:first + step])
                    lattice = model.lattice(list(some))
                    front, back = ahead(lattice, weights, len(some)), behind(lattice, weights, len(some))
                    share = np.array(counts_) / front[-1][:, 0]

                    def uses(s, k, words, w):
                        w = w[:, 0]
                        if words is None:
                            return front[s][:, 0] * w * back[s + k][:, 0] * share
                        return front[s][words, 0] * w * back[s + k][words, 0] * share[words]

                    add(lattice, weights, uses, at)
        totals = totals[:size]
        rows, langs = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.languages[i] for i in langs], pa.string()), pa.array(rows, pa.int64()),
             pa.array(totals[rows, langs], pa.float64())], names=["lang", "row", "n"])

    return (counts.mapInArrow(run, "lang string, row long, n double")
            .groupBy("lang", "row").agg(F.sum("n").alias("n")))


def train(documents: DataFrame, path: str, rounds: int = 2, lang_col: str = "lang",
          text_col: str = "text", smoothing: float = 0.5) -> Model | None:
    """A model from all rows with language and text; None where there are none.

    What comes to the driver is one number per piece and language: bounded by the
    vocabulary and ``MAX_LANGUAGES``, beyond which it raises.
    """
    pieces = vocabulary(path)
    counts = stored(no_finer(word_counts(documents, lang_col, text_col), documents), "language-words")
    languages = tuple(sorted(row.lang for row in counts.select("lang").distinct()
                             .limit(MAX_LANGUAGES + 1).collect()))
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = {piece: i for i, piece in enumerate(pieces)}
    tree = prefix_tree(rows)
    shape = (len(pieces), len(languages))
    # Starts with short pieces no likelier than long ones of the same letters.
    weights = np.repeat(np.array([[30.0 ** -len(p)] for p in pieces]), shape[1], axis=1)
    model = Model(languages, rows, tree, weights / weights.sum(axis=0))
    for _ in range(rounds):
        totals = np.zeros(shape)
        for lang, row, n in expected_pieces(counts, model).collect():
            totals[row, languages.index(lang)] = n
        totals += smoothing
        model = Model(languages, rows, tree, totals / totals.sum(axis=0))
    return model


def identify(documents: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score`` (the posterior, all languages being
    equally likely before). Texts that are null or have no letter, and all texts without a
    model, get ``und`` and 0. Only the text is looked at. Columns of these two names are replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model and model.parts())
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    source = documents.select(*kept)
    schema = T.StructType([*source.schema, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and Model(*shared.value)
        known: dict[str, int] = {}  # word → row of logs
        logs = np.zeros((0, len(model.languages) if model else 0))
        for part in chunks(batches, text_col):
            found = [letter_words(text) if model else [] for text in part.column(text_col).to_pylist()]
            if len(known) > REMEMBERED:
                known, logs = {}, logs[:0]
            new = list(set().union(*found).difference(known))
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new))))
                logs = np.concatenate([logs, model.forward(new)])
            names, scores = [UNDETERMINED] * len(found), [0.0] * len(found)
            some = [at for at, text in enumerate(found) if text]
            if some:
                every = list(chain.from_iterable(found))
                rows = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
                firsts = np.cumsum([0, *[len(found[at]) for at in some[:-1]]])
                totals = np.add.reduceat(logs[rows], firsts, axis=0)
                odds = np.exp(totals - totals.max(axis=1, keepdims=True))
                best = odds.argmax(axis=1)
                for at, language, share in zip(some, best.tolist(), (odds.max(axis=1) / odds.sum(axis=1)).tolist()):
                    names[at], scores[at] = model.languages[language], share
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=schema.names)

    return source.mapInArrow(run, schema)


def fold_of(id_col: str = "doc_id") -> Column:
    """The remainder that tells held-out rows: crc32 of the id as text, modulo 4 (null: 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4, F.lit(0))
