"""Token counts by the whole-token shortcut.

Most pre-tokens of a byte-level BPE vocabulary are single tokens. Which vocabulary strings
encode alone as one token is proved once, offline, over the whole vocabulary (its size is
fixed); the proved set is sent to the executors. A count then looks up every pre-token and
merges only the rest. One pass over the table, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T
from tokenizers import Tokenizer

from duoglot.llm.common import chunks

REMEMBERED = 200_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


def whole_tokens(path: str) -> set[str]:
    """The vocabulary strings that the merges alone turn into exactly one token."""
    tokenizer = Tokenizer.from_file(path)
    letters = {letter: byte for byte, letter in byte_letters().items()}
    proved = set()
    for name in tokenizer.get_vocab(with_added_tokens=False):
        if all(letter in letters for letter in name) and len(tokenizer.model.tokenize(name)) == 1:
            try:
                proved.add(bytes(letters[letter] for letter in name).decode())
            except UnicodeDecodeError:
                pass  # part of a character: never a pre-token of its own
    return proved


class PieceCounts(dict):
    """Tokens of a pre-token: 1 for the proved ones, merged by the vocabulary's rules for
    others, of which a bounded number is remembered."""

    def __init__(self, whole: set[str], path: str):
        super().__init__(dict.fromkeys(whole, 1))
        self._limit = len(self) + REMEMBERED
        self._model = Tokenizer.from_file(path).model
        self._letters = byte_letters()

    def __missing__(self, piece: str) -> int:
        letters = self._letters
        count = len(self._model.tokenize("".join(letters[b] for b in piece.encode())))
        if len(self) < self._limit and len(piece) < 100:
            self[piece] = count
        return count


def count_tokens(documents: DataFrame, path: str, pattern: str, specials: tuple[str, ...] = (),
                 limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``, one row per row of ``documents``.

    ``pattern`` splits texts into pre-tokens; ``specials`` are strings that the tokenizer
    takes as one token wherever they occur. A null text counts as empty: 0 bytes, 0 tokens.
    Null and repeated ids are kept as they are; other columns are not read.
    """
    spark = documents.sparkSession
    proved = spark.sparkContext.broadcast(whole_tokens(path))
    id_type = documents.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()),
                           T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(proved.value, path)
        pieces = regex.compile(pattern)
        special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        one = counts.__getitem__
        for part in chunks(batches, "text"):
            n_tokens = []
            for text in part.column("text").to_pylist():
                if special and special.search(text):
                    found = len(special.findall(text))
                    n_tokens.append(found + sum(sum(map(one, pieces.findall(rest)))
                                                for rest in special.split(text)))
                else:
                    n_tokens.append(sum(map(one, pieces.findall(text))))
            total = pa.array(n_tokens, pa.int64())
            n_bytes = pc.binary_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), n_bytes, total, pc.greater(total, limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return (documents.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
            .mapInArrow(run, schema))
