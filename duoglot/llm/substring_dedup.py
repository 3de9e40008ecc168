"""Removal of repeated passages by De Bruijn compaction.

A window of ``length`` consecutive words is an edge of a De Bruijn graph (its nodes are the
windows one word shorter). Edges are grouped by their anchor, the window's smallest k-mer
by hash: equal windows have equal anchors, and a run of consecutive windows with one
anchor is a path of edges. The rows of the shuffles are paths, not windows:

1. Every text becomes paths ``(anchor, path hash, start, windows)``.
2. Per anchor, partial sums tell the smallest and largest document and whether all paths are
   equal. Anchors of one document drop out. Where all paths are equal, the path is
   nonbranching: all its edges have the same documents, so it stays compacted, and a join gives each of its
   places the smallest document.
3. Where paths differ, the path branches: one place per distinct path is looked up by its source
   coordinates (a join with the texts), its windows are hashed one by one, and the smallest
   document of each window is joined back to the path and from there to its places.
4. Windows that also start in a smaller document mark their words; texts are cut in a last join.

Windows are told apart by 128 bits: the anchor's hash and the window's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from duoglot.llm.common import chunks, no_finer, stored, words

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def powers(size: int, inverse: bool) -> np.ndarray:
    base = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)) if inverse else MULTIPLIER
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any run of words by prefix sums of a polynomial in the words' own hashes."""

    def __init__(self, text: list[bytes]):
        own = pd.util.hash_array(np.array(text, dtype=object), hash_key="duoglot-passages", categorize=True)
        size = 1 << max(10, len(text).bit_length())
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(own * powers(size, False)[:len(text)], out=self.sums[1:])
        self.back = powers(size, True)

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def paths(texts: list[list[bytes]], length: int, k: int) -> tuple[np.ndarray, ...]:
    """``(text, anchor, path, start, windows)`` of all runs of windows with one anchor."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    flat = [w for t in texts for w in t]
    if not len(flat) or sizes.max() < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    hashes = Hashes(flat)
    at = np.arange(len(flat) - k + 1)
    smallest = sliding_min(hashes.runs(at, at + k), length - k + 1)
    # Windows that cross the end of a text are none.
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.arange(len(smallest))
    inside = owner[first] == owner[first + length - 1]
    new = np.ones(len(first), bool)
    new[1:] = (smallest[1:] != smallest[:-1]) | (owner[1:len(first)] != owner[:len(first) - 1]) | ~inside[:-1]
    new &= inside
    start = np.flatnonzero(new)
    # A path ends before the next one begins or where its text has no more windows.
    stop = np.minimum(np.append(start[1:], len(first)), ends[owner[start]] - length + 1)
    path = hashes.runs(start, stop + length - 1) + (stop - start).astype(np.uint64)
    return (owner[start], smallest[start].view(np.int64), path.view(np.int64),
            start - (ends - sizes)[owner[start]], stop - start)


def repeated_spans(documents: DataFrame, length: int = 50, k: int = 12, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc, text_key, start, windows)``: runs of windows (first word from 0, how many)
    that also start in a document with a smaller id. Rows with a null id take no part."""
    docs = keyed(documents, id_col, text_col).where("doc IS NOT NULL")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            owner, anchor, path, start, n = paths(
                [words(t) for t in part.column("text").to_pylist()], length, k)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(rows), part.column("text_key").take(rows), pa.array(anchor),
                 pa.array(path), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["doc", "text_key", "anchor", "path", "start", "n"])

    found = docs.mapInArrow(find, "doc long, text_key long, anchor long, path long, start int, n int")
    shared = (found.groupBy("anchor")
              .agg(F.min("doc").alias("min_doc"), F.max("doc").alias("max_doc"),
                   (F.min("path") != F.max("path")).alias("branching"))
              .where("min_doc < max_doc").select("anchor", "min_doc", "branching"))
    places = stored(no_finer(found.join(shared, "anchor"), documents), "passage-paths")
    whole = places.where("NOT branching AND doc > min_doc").select("doc", "text_key", "start", "n")

    branching = places.where("branching")
    distinct = (branching.groupBy("anchor", "path")
                .agg(F.min("doc").alias("least"), F.min(F.struct("doc", "text_key", "start", "n")).alias("at")))
    sources = (distinct.groupBy("at.doc", "at.text_key")
               .agg(F.collect_list(F.struct("anchor", "path", "at.start", "at.n")).alias("paths")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            for doc, text, own in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "paths"))):
                hashes = Hashes(words(text))
                start = np.array([p["start"] for p in own])
                n = np.array([p["n"] for p in own])
                index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = np.repeat(start, n) + index
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([p["anchor"] for p in own], n)),
                     pa.array(np.repeat([p["path"] for p in own], n)),
                     pa.array(index.astype(np.int32)),
                     pa.array(hashes.runs(first, first + length).view(np.int64)),
                     pa.array(np.full(len(first), doc))],
                    names=["anchor", "path", "i", "window", "doc"])

    texts = docs.join(sources, ["doc", "text_key"])
    edges = texts.select("doc", "text", "paths").mapInArrow(
        windows, "anchor long, path long, i int, window long, doc long")
    least = edges.groupBy("anchor", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    by_path = (edges.join(least.where("least < most").drop("most"), ["anchor", "window"])
               .groupBy("anchor", "path").agg(F.collect_list(F.struct("i", "least")).alias("windows")))
    single = (branching.join(by_path, ["anchor", "path"])
              .select("doc", "text_key", "start", F.explode("windows").alias("w"))
              .where("doc > w.least").select("doc", "text_key", (F.col("start") + F.col("w.i")).alias("start"),
                                             F.lit(1).alias("n")))
    # A path of one document that others have too, though no two documents share a window
    # with different paths, is covered by ``least``: it is the smallest of the same path.
    same = (branching.join(distinct.select("anchor", "path", "least"), ["anchor", "path"])
            .where("doc > least").select("doc", "text_key", "start", "n"))
    return whole.unionByName(single).unionByName(same)


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as ``(doc, text, text_key)``; equal ids with different texts stay apart."""
    return documents.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc", f"coalesce(`{text_col}`, '') AS text",
                                f"xxhash64(`{text_col}`) AS text_key")


def cut_passages(documents: DataFrame, length: int = 50, k: int = 12, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``documents`` with ``n_words``, ``n_removed`` and ``kept_text``.

    Each word is removed that a window of ``length`` words covers whose words also start
    in a document with a smaller id. ``kept_text`` is the text as it was if nothing is removed, otherwise the kept words
    joined by one space. Rows of one id are one document: they don't repeat each other. A null
    id keeps its text; a null text counts as empty. Columns of the new names are replaced.
    """
    kept = [c for c in documents.columns if c not in ("n_words", "n_removed", "kept_text")]
    # The row travels as one column: whatever its columns are called, they meet no name used here.
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    spans = (repeated_spans(documents, length, k, id_col, text_col).groupBy("doc", "text_key")
             .agg(F.collect_set(F.struct("start", "n")).alias("spans")))
    schema = T.StructType([*[f for f in documents.schema if f.name in kept], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            total, removed, texts = [], [], []
            for text, spans_ in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                found = words(text)
                total.append(len(found))
                if spans_:
                    marks = np.zeros(len(found) + 1, np.int64)
                    np.add.at(marks, [s["start"] for s in spans_], 1)
                    np.add.at(marks, [s["start"] + s["n"] + length - 1 for s in spans_], -1)
                    covered = np.cumsum(marks[:-1]) > 0
                    text = b" ".join(w for w, c in zip(found, covered) if not c).decode("utf-8", "surrogatepass")
                    removed.append(int(covered.sum()))
                else:
                    text = text or ""
                    removed.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                part.column("row").flatten()
                + [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                names=schema.names)

    cuts = rows.join(spans, ["doc", "text_key"], "left").select("row", "text", "spans").mapInArrow(cut, schema)
    return no_finer(cuts, documents)
