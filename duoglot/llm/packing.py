"""Best-fit packing of token pieces into sequences by bin completion.

Texts are tokenised in one pass; only pieces' lengths and checksums travel on. How many
pieces there are of each length is a table of at most ``capacity`` rows. Bin completion with
branch and bound works on that table: best fit gives an incumbent, whose most wasteful sequences are taken apart and
completed anew, around the longest piece left, by fillings that no other filling dominates. The plan is a bounded list of patterns; pieces find their sequence by their rank
among the pieces of equal length, in a broadcast join with the plan's slots.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T
from tokenizers import Tokenizer

from duoglot.llm.common import Idle, chunks, no_finer, stored, words
from duoglot.llm.token_counts import byte_letters

REMEMBERED = 400_000
RANK_ROWS = 1_000_000


class WordEncoder:
    """Ids of a word as little-endian 32-bit numbers.

    Words of printable Latin letters, digits and punctuation are cut by the tokenizer's own
    split pattern, and each piece is merged once; all other words, and those that may hold a special string,
    go through the whole tokenizer.
    """

    # Characters whose lower case and normal form stand for themselves alone.
    plain = regex.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            splits = json.load(file)["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.known = self.tokenizer.model, byte_letters(), {}
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def pieces(self, text: str) -> list[str]:
        if text.isalpha():
            return [text.lower()]
        if text[:-1].isalpha() and text[-1] in ".,":
            return [text[:-1].lower(), text[-1]]
        return self.split(text.lower())

    def __call__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if "<|" in text or not (text.isascii() and text.isprintable() or self.plain.fullmatch(text)):
            return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        pieces, known = self.pieces(text), self.known
        for piece in pieces:
            if piece not in known:
                mapped = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
                known[piece] = b"".join([self.packed[token.id] for token in self.model.tokenize(mapped)])
        ids = b"".join(map(known.__getitem__, pieces))
        if len(known) > REMEMBERED // 2:
            self.known = {}
        return ids


class Stems(dict):
    """Ids of lower-case words of a to z, each merged once while it is remembered."""

    def __init__(self, encode: WordEncoder):
        super().__init__()
        self.tokenize, self.packed = encode.model.tokenize, encode.packed

    def __missing__(self, stem: bytes) -> bytes:
        packed = self.packed
        ids = b"".join([packed[token.id] for token in self.tokenize(stem.decode())])
        if len(self) >= REMEMBERED:
            self.clear()
        self[stem] = ids
        return ids


class Remembered(dict):
    """Ids by word; a word that is missing is encoded. Once full, words not met since the last
    time it was full are forgotten.

    Most words are letters from A to z, and often a full stop or comma: these are told by their bytes and put
    together from what is known of their stem."""

    def __init__(self, encode: WordEncoder):
        super().__init__()
        self.encode, self.older, self.stems = encode, {}, Stems(encode)
        self.stops = {ord(stop): encode(stop.encode()) for stop in ".,"}
        self.idle = Idle(self.forget)

    def forget(self) -> None:
        """All words; the vocabulary stays."""
        self.clear()
        self.older, self.encode.known = {}, {}
        self.stems.clear()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.stems[word.lower()]
            elif word[-1] in self.stops and word[:-1].isalpha():
                ids = self.stems[word[:-1].lower()] + self.stops[word[-1]]
            else:
                ids = self.encode(word)
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


@lru_cache(1)
def remembered(path: str) -> Remembered:
    """One for all tasks of a Python worker: the vocabulary is loaded once."""
    return Remembered(WordEncoder(path))


def token_pieces(documents: DataFrame, path: str, capacity: int, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: token ids of each text and then ``end_id``,
    cut every ``capacity`` ids.

    For tokenizers that drop white space, so that the words of a text can be encoded one by
    one: each task remembers the ids of words it has met. A null text counts as empty.
    """
    id_type = documents.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path)
        with known.idle.in_use():
            for part in chunks(batches, "text"):
                texts = [words(text) for text in part.column("text").to_pylist()]
                rows: list[tuple] = []
                for doc, text in zip(part.column("id").to_pylist(), texts):
                    ids = b"".join(map(known.__getitem__, text)) + end
                    rows.extend((doc, at // width, at // 4, min(width, len(ids) - at) // 4,
                                 zlib.crc32(ids[at:at + width])) for at in range(0, len(ids), width))
                columns = list(zip(*rows))
                kinds = [part.column("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=schema.names)

    return (documents.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
            .mapInArrow(run, schema))


@dataclass(frozen=True)
class Pattern:
    lengths: tuple[int, ...]  # of the pieces of a sequence, longest first
    times: int


class Steps:
    """How many steps a search may still take."""

    def __init__(self, left: int):
        self.left = left

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def dominated(lengths: tuple[int, ...], room: int, others: list[int]) -> bool:
    """Whether one of ``others`` (lengths of pieces left out) could stand for some of the pieces of a filling, or
    just be added: it is at least as long as they are together, and longer by no more than the ``room`` left.
    What it replaced would fit wherever it was, so the filling need not be looked at."""
    sums: dict[int, int] = {}
    for x in others:
        own = x if x in lengths else 0
        if own not in sums:
            # Bit n: some pieces of other lengths than x are n long together.
            reached = 1
            for n in lengths:
                if n != own:
                    reached |= reached << n
            sums[own] = reached
        least = max(0, x - room)
        if (sums[own] >> least) & ((1 << (x - least + 1)) - 1):
            return True
    return False


def fillings(counts: Mapping[int, int], room: int, slack: int, steps: Steps) -> Iterator[tuple[int, ...]]:
    """All undominated ways to fill ``room`` with pieces of ``counts`` (length → number) that leave no more than
    ``slack``, long pieces first. Ends early only when ``steps`` are used up."""
    there = sorted((n for n, k in counts.items() if n <= room and k), reverse=True)
    rest = [0] * (len(there) + 1)
    for at in range(len(there) - 1, -1, -1):
        rest[at] = rest[at + 1] + there[at] * counts[there[at]]

    def extend(at: int, room: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        while at < len(there) and there[at] > room:
            at += 1
        if at == len(there):
            if room <= slack:
                used = Counter(chosen)
                if not dominated(chosen, room, [n for n in there if counts[n] > used[n]]):
                    yield chosen
            return
        for first in range(at, len(there)):
            if room - rest[first] > slack or not steps.take():
                return
            n = there[first]
            for k in range(min(counts[n], room // n), 0, -1):
                yield from extend(first + 1, room - k * n, chosen + (n,) * k)

    return extend(0, room, ())


def complete_bins(counts: Mapping[int, int], bins: int, capacity: int,
                  steps: Steps) -> list[tuple[int, ...]] | None:
    """``counts`` packed into ``bins`` sequences, or None if that cannot be or was not found within ``steps``.

    Sequence by sequence around the longest piece left, depth first over its undominated fillings; a branch ends
    when the waste so far exceeds what ``bins`` sequences can waste in all.
    """
    def pack_rest(left: Counter, slack: int) -> list[tuple[int, ...]] | None:
        if not left:
            return []
        longest = max(left)
        others = left - Counter([longest])
        for filling in fillings(others, capacity - longest, slack, steps):
            found = pack_rest(others - Counter(filling), slack - (capacity - longest - sum(filling)))
            if found is not None:
                return [(longest, *filling), *found]
            if steps.left <= 0:
                break
        return None

    slack = bins * capacity - sum(n * k for n, k in counts.items())
    if slack < 0 or bins < 1 and counts:
        return None
    found = pack_rest(Counter(counts), slack)
    # Sequences not needed stay away; more than ``bins`` would waste more than the slack.
    return found if found is not None and len(found) <= bins else None


def fill_up(counts: np.ndarray, lengths: tuple[int, ...], room: int) -> tuple[int, ...]:
    """``lengths`` with the longest pieces that still fit, one after the other."""
    left, used = room - sum(lengths), dict.fromkeys(lengths, 0)
    for n in lengths:
        used[n] += 1
    out = list(lengths)
    while left > 0:
        fits = [n for n in np.flatnonzero(counts[:left + 1]) if n and counts[n] > used.get(n, 0)]
        if not fits:
            break
        n = int(fits[-1])
        out.append(n)
        used[n] = used.get(n, 0) + 1
        left -= n
    return tuple(sorted(out, reverse=True))


def times(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    values, need = np.unique(lengths, return_counts=True)
    return int((counts[values] // need).min())


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """The incumbent: longest piece first, then always the longest that fits."""
    counts, out = counts.copy(), []
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        lengths = fill_up(counts, (longest,), capacity)
        n = times(counts, lengths)
        np.subtract.at(counts, list(lengths), n)
        out.append(Pattern(lengths, n))
    return out


def wasteful_part(packed: Counter, capacity: int, width: int, in_turn: bool) -> Counter:
    """Sequences to take apart, those that waste most first: at least ``width`` and as many as waste one sequence's
    worth together. ``in_turn``, one of each of ``width`` patterns (more if they don't suffice) after the other,
    so that unlike sequences come together; otherwise pattern by pattern."""
    patterns = sorted(packed, key=lambda x: (sum(x), -len(x), x))
    taken, waste, n = Counter(), 0, 0
    while waste < capacity or n < width:
        offered = [x for x in patterns[:width if in_turn else None] if taken[x] < packed[x]]
        if not offered:
            if not in_turn or width >= len(patterns):
                break
            width *= 2
            continue
        for lengths in offered:
            own = capacity - sum(lengths)
            k = 1
            if not in_turn:
                k = min(packed[lengths], max(width - n, -(-max(0, capacity - waste) // own) if own else 0))
            taken[lengths] += k
            waste += k * own
            n += k
            if waste >= capacity and n >= width:
                break
        if not in_turn:
            break
    return +taken if waste >= capacity else Counter()


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 1_000_000,
                   most_bins: int = 400) -> list[Pattern]:
    """Patterns that use up ``counts`` (pieces by length), in as few sequences as found.

    The incumbent is the best-fit packing. While it needs more sequences than the lower bound, sequences that
    waste much are taken apart, and branch and bound looks for a packing of their pieces that needs one less;
    a found one is used as often as its patterns repeat, those that repeat most first. After a failure twice as many are taken. Ends at the lower
    bound, or when no such part (of up to ``most_bins`` sequences) is improved, each within 40th of the
    ``nodes`` steps in all; the incumbent is a whole packing at any time.
    """
    counts = np.asarray(counts, np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    bound = max(-(-total // capacity), int(counts[capacity // 2 + 1:].sum()))
    packed: Counter = Counter()
    for pattern in best_fit_decreasing(counts, capacity):
        packed[pattern.lengths] += pattern.times
    left, width, in_turn, seen = nodes, 4, True, set()
    # Patterns that repeat often are improved together first: ``level`` copies count as one.
    level = 16 ** int(np.log2(max(packed.values(), default=1)) // 4)
    while packed.total() > bound and left > 0:
        if width > most_bins:
            if level == 1:
                break
            level, width, in_turn = level // 16, 4, True
        often = Counter({lengths: n // level for lengths, n in packed.items() if n >= level})
        taken = wasteful_part(often, capacity, width, in_turn)
        better = None
        part = tuple(sorted(taken.items()))
        if taken and taken.total() <= most_bins and part not in seen:
            seen.add(part)
            pieces: Counter = Counter()
            for lengths, n in taken.items():
                for length in lengths:
                    pieces[length] += n
            steps = Steps(min(left, -(-nodes // 40)))
            left -= steps.left
            better = complete_bins(pieces, taken.total() - 1, capacity, steps)
            left += max(0, steps.left)
        if better is None:
            width, in_turn = (width, False) if in_turn else (2 * width, True)
            continue
        repeat = min(packed[lengths] // n for lengths, n in taken.items())
        for lengths, n in taken.items():
            packed[lengths] -= n * repeat
        for lengths in better:
            packed[tuple(sorted(lengths, reverse=True))] += repeat
        packed, width, in_turn = +packed, 4, True
    return [Pattern(lengths, n) for lengths, n in sorted(packed.items(), reverse=True)]


def pack(pieces: DataFrame, capacity: int, nodes: int = 1_000_000) -> DataFrame:
    """``pieces`` (any rows with a ``length`` from 1 to ``capacity``) with ``sequence_id``
    and ``offset``: sequences have no gaps and no overlaps.

    Read three times, so give a stored table. Equal rows get places of their own. An
    empty table gives an empty one. Other columns, except the two, are kept.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    keys = pieces.columns
    # Ranks are taken within (length, part) of about RANK_ROWS rows, so that a length that
    # many pieces share is no single task's; the starts of the parts are prefix sums.
    totals = {row.length: row.n for row in
              pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in totals):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    for n, found in totals.items():
        counts[n] = found
    patterns = bin_completion(counts, capacity, nodes)
    slots, filled, base = [], np.zeros(capacity + 1, np.int64), 0
    for pattern in patterns:
        offset = 0
        for n in pattern.lengths:
            slots.append((n, int(filled[n]), int(filled[n]) + pattern.times, base, offset))
            filled[n] += pattern.times
            offset += n
        base += pattern.times
    slot_table = spark.createDataFrame(
        slots, "length long, from_rank long, to_rank long, base long, offset long")
    parts = spark.createDataFrame([(n, int(-(-found // RANK_ROWS))) for n, found in totals.items()],
                                  "length long, parts long")
    salted = (pieces.join(F.broadcast(parts), "length")
              .withColumn("part", F.pmod(F.xxhash64(*keys), "parts")).drop("parts"))
    by_length = Window.partitionBy("length").orderBy("part")
    starts = (salted.groupBy("length", "part").agg(F.count("*").alias("n"))
              .select("length", "part", (F.sum("n").over(by_length) - F.col("n")).alias("before")))
    within = Window.partitionBy("length", "part").orderBy(*keys)
    ranked = (salted.withColumn("in_part", F.row_number().over(within) - 1)
              .join(F.broadcast(starts), ["length", "part"])
              .withColumn("rank", F.col("in_part") + F.col("before")))
    # One row per slot; there are at most as many as pieces in all patterns.
    fits = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("from_rank")) & (
        F.col("rank") < F.col("to_rank"))
    return (ranked.alias("p").join(F.broadcast(slot_table).alias("s"), fits)
            .select(*[F.col(f"p.{key}") for key in keys],
                    (F.col("base") + F.col("rank") - F.col("from_rank")).alias("sequence_id"),
                    "offset"))


def pack_documents(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    Every row of ``documents`` is packed, repeated and null ids too; a null or empty text
    has one piece with only ``end_id``.
    """
    pieces = stored(token_pieces(documents, path, capacity, end_id, id_col, text_col), "token-pieces")
    return no_finer(pack(pieces, capacity), documents)
