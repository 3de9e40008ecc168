"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Texts are cut into pre-tokens. A block of some MB of text becomes one row: its distinct
   pre-tokens, and for every position the number of the pre-token that stands there. The
   blocks are shuffled once; both of the following read that shuffle.
2. The distinct pre-tokens of all blocks are shuffled by the hash of the word, so that each is
   encoded once; ids go back to the blocks that have the word.
3. Joined by block, the ids of every text are put together by position.
4. Decoding joins ids with the table of token bytes, whose size the vocabulary fixes.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from duoglot.llm.common import chunks

BLOCK_BYTES = 4 << 20  # of text in a block: memory of a task, not a limit on texts
REMEMBERED = 500_000   # distinct words whose ids a task holds at once


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, leftmost on ties.

    A heap of pairs over a linked list of parts: n log n in the length of the piece.
    """
    if piece in ranks:
        return [ranks[piece]]
    size = len(piece)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    end = list(range(1, size + 1))  # 0: merged into the part on the left
    heap = []

    def offer(left: int) -> None:
        right = after[left]
        if right < size:
            rank = ranks.get(piece[left:end[right]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end[right]))

    for left in range(size - 1):
        offer(left)
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = after[left]
        if not end[left] or right >= size or end[right] != stop:
            continue  # one of the two has changed since
        end[left], end[right] = stop, 0
        after[left] = after[right]
        if after[right] < size:
            before[after[right]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at:end[at]]])
        at = after[at]
    return ids


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(words), *map(len, words)], "<u4").tobytes()
    return zstandard.ZstdCompressor(3).compress(sizes + b"".join(words))


def unpack_words(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", count, 4), dtype=np.int64) + 4 * (count + 1)
    starts = np.append(4 * (count + 1), ends[:-1])
    return [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]


def pack_numbers(values: np.ndarray) -> bytes:
    """Low bytes of all numbers, then the next ones: high bytes are nearly all zero."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(3).compress(planes)


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def text_blocks(documents: DataFrame, pattern: str, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """``(block, ids, lengths, codes, word_buckets, packs)``: texts as numbers of their block's
    words, the most frequent first, and the words by the bucket of their hash.

    A block's name is a hash of its content: should a lost task be run again over rows in another
    order, its blocks have other names and cannot be mixed up.
    """
    id_type = documents.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()),
        T.StructField("word_buckets", T.BinaryType()), T.StructField("packs", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(pattern)
        for part in chunks(batches, "text", BLOCK_BYTES):
            numbers: dict[str, int] = {}
            lengths, codes = [], []
            for text in part.column("text").to_pylist():
                found = pieces.findall(text)
                for piece in set(found).difference(numbers):
                    numbers[piece] = len(numbers)
                lengths.append(len(found))
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
            flat = np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            names = [name.encode() for name in numbers]
            names = [names[i] for i in order]
            where = np.array([zlib.crc32(name) % buckets for name in names], np.uint32)
            lists: list[list[bytes]] = [[] for _ in range(buckets)]
            for name, bucket in zip(names, where.tolist()):
                lists[bucket].append(name)
            ids, sequence = part.column("id").to_pylist(), pack_numbers(place[flat])
            packs = [pack_words(x) for x in lists]
            name = xxhash.xxh3_64_intdigest(sequence + repr((ids, lengths)).encode() + b"".join(packs))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name - (1 << 63)]), pa.array([ids], pa.list_(part.column("id").type)),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([sequence], pa.binary()),
                 pa.array([pack_numbers(where)], pa.binary()), pa.array([packs], pa.list_(pa.binary()))],
                names=schema.names)

    return (documents.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
            .mapInArrow(run, schema))


def block_words(blocks: DataFrame) -> DataFrame:
    """``(block, bucket, pack)``. Takes whole blocks, so that the shuffle of the blocks is the
    same one that the assembly reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packs in zip(batch.column("block").to_pylist(), batch.column("packs").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(packs), pa.int64()), pa.array(range(len(packs)), pa.int32()),
                     pa.array(packs, pa.binary())], names=["block", "bucket", "pack"])

    return blocks.mapInArrow(run, "block long, bucket int, pack binary")


def encode_words(packs: DataFrame, path: str) -> DataFrame:
    """``(block, bucket, sizes, ids)``: ids of the words of each pack. ``packs`` has a bucket's
    packs in one partition, so that each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = read_ranks(path), {}
        for batch in batches:
            sizes, ids = [], []
            for pack in batch.column("pack").to_pylist():
                if len(known) > REMEMBERED:
                    known = {}
                found = []
                for word in unpack_words(pack):
                    own = known.get(word)
                    if own is None:
                        own = known[word] = tuple(merge(word, ranks))
                    found.append(own)
                sizes.append(pack_numbers(np.array([len(x) for x in found], np.uint32)))
                ids.append(pack_numbers(np.array([i for x in found for i in x], np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(sizes, pa.binary()),
                 pa.array(ids, pa.binary())], names=["block", "bucket", "sizes", "ids"])

    return packs.mapInArrow(run, "block long, bucket int, sizes binary, ids binary")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``start … start + size - 1`` of every pair, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encode(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, token_ids)``, one row per row of ``documents``.

    ``token_ids`` holds little-endian 32-bit ids. A null or empty text has no ids. Repeated
    and null ids stay as rows of their own; other columns are not read.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = text_blocks(documents, pattern, 2 * parts, id_col, text_col).repartition(parts, "block")
    tables = encode_words(block_words(blocks).repartition(parts, "bucket"), path)
    schema = T.StructType([T.StructField(id_col, documents.schema[id_col].dataType),
                           T.StructField("n_tokens", T.LongType()),
                           T.StructField("token_ids", T.BinaryType())])

    def assemble(block: pa.Table, table: pa.Table) -> pa.Table:
        if block.num_rows != 1:
            raise ValueError("a block and its words differ: an input row changed between tasks")
        bucket = unpack_numbers(block.column("word_buckets")[0].as_py())
        sizes, starts = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
        flat_ids, filled = [], 0
        for at, sizes_, ids_ in zip(*(table.column(c).to_pylist() for c in ("bucket", "sizes", "ids"))):
            codes, own = np.flatnonzero(bucket == at), unpack_numbers(sizes_).astype(np.int64)
            sizes[codes], starts[codes] = own, filled + np.cumsum(own) - own
            filled += int(own.sum())
            flat_ids.append(unpack_numbers(ids_))
        if not sizes.all():
            raise ValueError("a block and its words differ: an input row changed between tasks")
        flat_ids = np.concatenate(flat_ids) if flat_ids else np.empty(0, "<u4")
        flat, out, at = unpack_numbers(block.column("codes")[0].as_py()), [], 0
        for length in block.column("lengths")[0].as_py():
            part = flat[at:at + length]
            at += length
            out.append(flat_ids[spread(starts[part], sizes[part])].tobytes())
        ids = block.column("ids")[0].values
        return pa.table({id_col: ids, "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()),
                         "token_ids": pa.array(out, pa.binary())})

    return blocks.groupBy("block").cogroup(tables.groupBy("block")).applyInArrow(assemble, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary): the bytes of its ids in order.

    The table of token bytes (one entry per rank) goes to every executor and is joined there.
    Null ids give null. An id that the table lacks is an error.
    """
    spark = encoded.sparkSession
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = spark.sparkContext.broadcast(table)
    schema = T.StructType([*(f for f in encoded.schema if f.name != "decoded"),
                           T.StructField("decoded", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            out = [None if ids is None else b"".join(map(token, np.frombuffer(ids, "<u4").tolist()))
                   for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in names[:-1]] + [pa.array(out, pa.binary())],
                names=names)

    return encoded.select(*names[:-1]).mapInArrow(run, schema)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(id_col, "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
