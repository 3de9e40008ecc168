"""Words of a batch of texts, numbered for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Words and rows that are handled at once; a longer text is a part of its own.
PART_WORDS = 500_000
PART_ROWS = 2_048


def word_rows(batch: pa.RecordBatch, column: str = "words") -> Iterator[
        tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray]]:
    """Parts of ``batch`` with, for every word of its list column, the row within the part, the different
    words, and the word's place among those."""
    ends = batch.column(column).offsets.to_numpy()[1:].astype(np.int64)
    start, before = 0, int(batch.column(column).offsets[0].as_py()) if batch.num_rows else 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, before + PART_WORDS, side="right"))
        stop = max(start + 1, min(stop, start + PART_ROWS, batch.num_rows))
        part = batch.slice(start, stop - start)
        words = part.column(column)
        coded = words.flatten().dictionary_encode()
        lengths = np.diff(words.offsets.to_numpy())
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        yield part, np.repeat(np.arange(part.num_rows), lengths), coded.dictionary, code
        start, before = stop, int(ends[stop - 1])


def word_runs(batch: pa.RecordBatch, column: str = "words") -> Iterator[
        tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray]]:
    """Parts of ``batch`` with one entry per row and different word of it, in the order of rows: the row within the
    part, the word, and how often it occurs there."""
    for part, row, terms, code in word_rows(batch, column):
        key = np.sort(row * max(1, len(terms)) + code)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.diff(first, append=len(key))
        yield part, key // max(1, len(terms)), terms.take(pa.array(key % max(1, len(terms)))), times
