"""Importance resampling towards a target distribution with hashed word features
(Xie et al. 2023), the buckets by CRC-32 from a position table.

A text's words are lower-cased (A to Z only) runs of letters, digits and characters beyond ASCII.
Its features are all runs of 1 to ``longest`` consecutive words, joined by one space; a feature's
bucket is the CRC-32 of its UTF-8 bytes modulo the number of buckets.

CRC-32 is linear apart from a constant per length: the checksum of a span is the exclusive or of one
contribution per byte, which depends on the byte and its distance from the end of the span, and the
checksum of as many zero bytes. So all spans of a batch are hashed together: contributions are looked
up in a table (distance × byte) and combined by ``bitwise_xor.reduceat`` over the spans. The table
covers ``BLOCK`` distances; longer spans consist of several blocks, whose results are folded in
pairs, the left one moved on by the length of what follows.

Steps, each a Spark job over whole tables:

1. count features per bucket in both corpora (a task hands on one row per bucket it met);
2. turn the counts into one whole-number gain per bucket (driver: as many rows as buckets);
3. sum the gains of every document, add Gumbel noise from a hash of its id;
4. sort the documents long enough by score; ranks are places within a sorted partition plus the
   rows of the partitions before it, so no task sees more than its share.

Null or wordless texts have no features and weight 0; they are not drawn while ``least_words`` is
above 0. Null ids count as an empty id in the hash. Every row gets its own result, repeated rows too;
equal scores are ordered by id, and rows equal in that as well by their place in the stored table.
Further columns of the input are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from duoglot.llm.common import chunks, stored

BLOCK = 64                # bytes of a span that one table look-up covers
SLICE_BYTES = 1 << 20     # span bytes hashed at once

# Bytes that do not belong to a word.
BREAKS = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[BREAKS] = False


@cache
def position_table() -> np.ndarray:
    """What byte ``b`` at distance ``d`` from the end adds to a checksum, at ``d * 256 + b``."""
    rows = []
    for distance in range(BLOCK):
        rest = bytes(distance)
        zero = zlib.crc32(b"\0" + rest)
        rows.append([zlib.crc32(bytes([b]) + rest) ^ zero for b in range(256)])
    return np.array(rows, dtype=np.uint32).ravel()


@cache
def length_constants(upto: int = 4096) -> np.ndarray:
    """Checksums of 0, 1, 2, … zero bytes."""
    values = [0]
    for _ in range(upto):
        values.append(zlib.crc32(b"\0", values[-1]))
    return np.array(values, dtype=np.uint32)


def _constants(lengths: np.ndarray) -> np.ndarray:
    table = length_constants()
    out = table[np.minimum(lengths, len(table) - 1)]
    for at in np.nonzero(lengths >= len(table))[0]:
        out[at] = zlib.crc32(bytes(int(lengths[at])))
    return out


@cache
def _moves(level: int) -> np.ndarray:
    """4 × 256 table: what a state becomes when ``BLOCK * 2**level`` more bytes follow."""
    if level:
        half = _moves(level - 1)
        return _moved(half.ravel(), level - 1).reshape(4, 256)
    rest = bytes(BLOCK)
    zero = zlib.crc32(rest)
    return np.array([[zlib.crc32(rest, b << 8 * k) ^ zero for b in range(256)] for k in range(4)],
                    dtype=np.uint32)


def _moved(states: np.ndarray, level: int) -> np.ndarray:
    table = _moves(level)
    return (table[0][states & 255] ^ table[1][(states >> 8) & 255]
            ^ table[2][(states >> 16) & 255] ^ table[3][states >> 24])


def _fold(blocks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One state per span from its blocks; the first block of a span is the one at its end."""
    level = 0
    while len(blocks) > len(counts):
        firsts = np.cumsum(counts) - counts
        place = np.arange(len(blocks)) - np.repeat(firsts, counts)
        right, left = blocks[place % 2 == 0], place % 2 == 1
        halves = (counts + 1) // 2
        target = np.repeat(np.cumsum(halves) - halves, counts) + place // 2
        right[target[left]] ^= _moved(blocks[left], level)
        blocks, counts, level = right, halves, level + 1
    return blocks


def crc32_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each non-empty span ``data[start:start + length]``; spans may overlap."""
    out = np.zeros(len(starts), dtype=np.uint32)
    if not len(starts):
        return out
    table = position_table()
    counts = (lengths + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(starts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = (starts + lengths)[owner] - place * BLOCK
    begins = np.maximum(ends - BLOCK, starts[owner])
    sizes = ends - begins
    blocks = np.empty(len(owner), dtype=np.uint32)
    filled = np.cumsum(sizes)
    at = 0
    while at < len(owner):
        before = filled[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(filled, before + SLICE_BYTES, "right")))
        n = sizes[at:upto]
        first = filled[at:upto] - n - before
        index = np.arange(int(n.sum()))
        position = index + np.repeat(begins[at:upto] - first, n)
        distance = np.repeat(first + n - 1, n) - index
        blocks[at:upto] = np.bitwise_xor.reduceat(table[distance * 256 + data[position]], first)
        at = upto
    return _fold(blocks, counts) ^ _constants(lengths)


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, bucket)`` of every feature, ordered by row, and the number of words per row."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw else np.zeros(0, np.uint8)
    data, offsets = _LOWER[data], offsets - offsets[0]
    inside = _IN_WORD[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[edges]              # a word ends with its text
    closes[edges - 1] |= inside[edges - 1]
    starts, ends = np.nonzero(begins)[0], np.nonzero(closes)[0] + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(row, minlength=len(texts)).astype(np.int64)
    if longest > 1:
        # The same words with one space between them: a run of words is one span.
        sizes = ends - starts
        first = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int(sizes.sum()) + len(sizes), 0x20, dtype=np.uint8)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        joined[np.repeat(first, sizes) + within] = data[np.repeat(starts, sizes) + within]
        data, starts, ends = joined, first, first + sizes
    rows, hashes = [], []
    for n in range(1, longest + 1):
        last = np.arange(n - 1, len(starts))
        head = last - (n - 1)
        same = row[head] == row[last]
        head, last = head[same], last[same]
        rows.append(row[head])
        hashes.append(crc32_spans(data, starts[head], ends[last] - starts[head]) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(hashes).astype(np.int64), n_words


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1,
                  buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)``: features of all texts per bucket; buckets without any are left out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in chunks(batches, "text"):
            _, found, _ = features(batch.column("text"), longest, buckets)
            total += np.bincount(found, minlength=buckets)
        met = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())],
                                         names=["bucket", "n"])

    return (texts.select(F.col(text_col).cast("string").alias("text"))
            .mapInArrow(count, "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """One gain per bucket, ``floor(1000 * ln(ratio of the smoothed shares))``, from two tables
    of :func:`bucket_counts`. At most one row per bucket comes to the driver."""
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (source, target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t)))
            for b in range(buckets)]


def weigh(docs: DataFrame, gains: list[int], longest: int = 1) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row: the sum of its features' gains."""
    table = np.array(gains, dtype=np.int64)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            row, found, n_words = features(batch.column("text"), longest, len(table))
            n_features = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
            weight = np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(weight, row, table[found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        add_up, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def with_score(weighed: DataFrame, seed: int = 2024) -> DataFrame:
    """Add ``score``: the weight plus Gumbel noise (in thousandths) from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    uniform = (h.cast("double") + 0.5) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("bigint"))


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Number all rows in ``order`` from 1, without bringing them together: after a distributed
    sort a row's place is its place in its partition plus the rows of the partitions before."""
    key = F.monotonically_increasing_id()
    placed = stored(rows.orderBy(*order).withColumn("_key", key), "importance-order").select(
        "*", F.shiftright("_key", 33).alias("_part"))
    # One row per sorted partition.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_key").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_before") + place + 1).drop("_key", "_part", "_before"))


def resample(docs: DataFrame, target: DataFrame, target_text: str = "text", percent: int = 10,
             least_words: int = 20, longest: int = 1, buckets: int = 10_000,
             seed: int = 2024) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every document; ``rank`` is null
    for the documents that are not among the drawn ``percent`` of those with ``least_words``."""
    docs = docs.select("doc_id", "text")
    gains = bucket_gains(bucket_counts(docs, "text", longest, buckets),
                         bucket_counts(target, target_text, longest, buckets), buckets)
    scored = stored(with_score(weigh(docs, gains, longest), seed)
                    .withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = long_enough.count() * percent // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    placed = ranked(long_enough, order).withColumn(
        "rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.unionByName(others).drop("_row")
