"""Vector retrieval: the nearest documents of every query by cosine.

Comparing |queries| × |documents| vectors is the work itself, so it is laid out to move
little data and to emit only the best few rows per query, never the pairs:

* few queries (a checked bound): their matrix is broadcast and every task scans its share
  of the documents once, without a shuffle, keeping a running top list per query;
* many queries: both sides are cut into tiles of bounded size by hash, and each pair of
  tiles is one cogroup;
* approximate: the same tiles, restricted to documents and queries that share a
  random-hyperplane code (Charikar 2002) in at least one of several tables.

Inside a task the products are Arrow batches multiplied with numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from duoglot.functions.vectors import SCORE_DIGITS
from duoglot.operators.topk import top_by_own_limit, top_per_group

BROADCAST_QUERIES = 4_096      # × 768 floats = 12 MB
TILE_QUERIES = 16_384
TILE_DOCS = 16_384
HELD_CELLS = 4_000_000         # numbers that a side of a cogroup may hold whatever its tile, 32 MB
SCAN_QUERIES = 2_048           # queries of a cogroup whose lists run at once
_BLOCK_CELLS = 4_000_000       # scores held at once in a task
_SCALE = 10.0 ** SCORE_DIGITS


def _matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """n × width matrix of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = np.asarray(column.flatten(), dtype=np.float64)
    if n == 0:
        return np.zeros((0, width or 0))
    lengths = np.diff(column.offsets.to_numpy())
    if lengths.min() != lengths.max() or (width is not None and lengths[0] != width):
        raise ValueError("vectors of different width cannot be compared")
    return values.reshape(n, -1)


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(scores) * _SCALE + 0.5) / _SCALE, scores) + 0.0


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.array(values, dtype=str if values and isinstance(values[0], str) else None)


class _TopLists:
    """Running best (id, score) of each query, as many as its limit: highest score, then lowest id."""

    def __init__(self, limits: np.ndarray):
        n_queries = len(limits)
        self.limits = limits
        self.limit = int(limits.max(initial=1))
        self.floor = np.full(n_queries, -np.inf)
        self.query = np.zeros(0, dtype=np.int64)
        self.ids: np.ndarray | None = None
        self.scores = np.zeros(0)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates: position of the query, id and score of each."""
        if not len(q):
            return
        query = np.concatenate([self.query, q])
        all_ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        values = np.concatenate([self.scores, scores])
        order = np.lexsort((all_ids, -values, query))
        query, all_ids, values = query[order], all_ids[order], values[order]
        starts = np.searchsorted(query, np.arange(len(self.floor)))
        position = np.arange(len(query)) - starts[query]
        keep = position < self.limits[query]
        self.query, self.ids, self.scores = query[keep], all_ids[keep], values[keep]
        full = position[keep] == self.limits[self.query] - 1
        self.floor[self.query[full]] = self.scores[full]


def _longest(vectors: np.ndarray) -> float:
    return float(np.sqrt(np.nanmax(np.einsum("ij,ij->i", vectors, vectors), initial=0.0)))


class _Scan:
    """Compares queries with one share of the documents after another.

    All products are formed in single precision, whose error is bounded; only those that can reach a list within that
    bound are formed and rounded in double precision. So lists are the same as with all of them in double.
    """

    def __init__(self, query_ids: np.ndarray, matrix: np.ndarray, limits: np.ndarray, skip_same: bool):
        self.query_ids, self.matrix, self.skip_same = query_ids, matrix, skip_same
        self.coarse = matrix.astype(np.float32)
        self.longest = _longest(matrix)
        self.lists = _TopLists(limits)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, _BLOCK_CELLS // max(1, len(self.query_ids)))
        for start in range(0, len(ids), step):
            self._add(ids[start:start + step], vectors[start:start + step])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        lists, width = self.lists, vectors.shape[1]
        longest = self.longest * _longest(vectors)
        # The products' error, then that of comparing with rounded scores.
        error = (width + 8) * 2.0 ** -23 * longest + 1 / _SCALE
        scores = self.coarse @ vectors.astype(np.float32).T
        if self.skip_same:
            scores[self.query_ids[:, None] == ids[None, :]] = -np.inf
        cut = lists.floor - error
        n = len(ids)
        if n > lists.limit and np.isinf(lists.floor).any():
            cut = np.fmax(cut, np.partition(scores, n - lists.limit, axis=1)[:, n - lists.limit] - 2 * error)
        # Rounded down, so that the comparison in single precision leaves nothing out.
        cut = np.nextafter(cut.astype(np.float32), np.float32(-np.inf))
        q, d = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
        some = max(1, _BLOCK_CELLS // max(1, width))
        for at in range(0, len(q), some):
            near, far = q[at:at + some], d[at:at + some]
            exact = _rounded(np.einsum("ij,ij->i", self.matrix[near], vectors[far]))
            kept = (exact >= lists.floor[near]) & np.isfinite(exact)
            lists.add(near[kept], ids[far[kept]], exact[kept])


def _schema(queries: DataFrame, docs: DataFrame) -> str:
    query_type = queries.schema["query_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return f"query_id {query_type}, doc_id {doc_type}, vector_score double"


def _arrow_type(name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]


def _output(queries: DataFrame, docs: DataFrame) -> pa.Schema:
    return pa.schema([
        ("query_id", _arrow_type(queries.schema["query_id"].dataType.simpleString())),
        ("doc_id", _arrow_type(docs.schema["doc_id"].dataType.simpleString())),
        ("vector_score", pa.float64())])


def _columns(lists: _TopLists, query_ids: np.ndarray, schema: pa.Schema) -> list[pa.Array]:
    ids = [] if lists.ids is None else lists.ids.tolist()
    return [pa.array(query_ids[lists.query].tolist(), schema.field(0).type),
            pa.array(ids, schema.field(1).type),
            pa.array(lists.scores, pa.float64())]


def _limits(rows: pa.Table) -> np.ndarray:
    return rows["_limit"].to_numpy().astype(np.int64)


def _broadcast_scan(queries: DataFrame, docs: DataFrame, skip_same: bool) -> DataFrame:
    rows = queries.toArrow()
    query_ids, matrix = _ids(rows["query_id"]), _matrix(rows["embedding"])
    shared = docs.sparkSession.sparkContext.broadcast((query_ids, matrix, _limits(rows)))
    schema = _output(queries, docs)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, limits = shared.value
        scan = _Scan(query_ids, matrix, limits, skip_same)
        for batch in batches:
            if batch.num_rows and len(query_ids):
                scan.add(_ids(batch.column("doc_id")), _matrix(batch.column("embedding"), matrix.shape[1]))
        yield pa.RecordBatch.from_arrays(_columns(scan.lists, query_ids, schema), schema=schema)

    return docs.mapInArrow(best, _schema(queries, docs))


def _tiled(queries: DataFrame, docs: DataFrame, keys: list[str],
           skip_same: bool, tile_queries: int, tile_docs: int) -> DataFrame:
    """Best rows per tile for queries and documents that share ``keys``.

    A key is cut into as many query parts and document parts as its counts ask for, so no
    cogroup exceeds one tile of each side, however the rows are spread over the keys. Every row is
    copied once per part of the other side, so a tile smaller than ``HELD_CELLS`` numbers is filled up
    to that: with small tiles the copies, not the rows, would make up what is shuffled.
    """
    def parts(df: DataFrame, tile: int, name: str) -> DataFrame:
        rows = F.greatest(F.lit(tile), F.floor(F.lit(HELD_CELLS) / F.greatest(F.max(F.size("embedding")), F.lit(1))))
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    sizes = parts(queries, tile_queries, "_query_parts").join(
        parts(docs, tile_docs, "_doc_parts"), keys)
    sizes = F.broadcast(sizes)   # one row per key; callers bound the number of keys

    def part(id_col: str, n: str) -> Column:
        return F.pmod(F.xxhash64(id_col), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = (queries.join(sizes, keys)
         .withColumn("_q", part("query_id", "_query_parts"))
         .withColumn("_d", every("_doc_parts"))
         .select(*[F.col(c).alias(c) for c in (*keys, "_q", "_d", "query_id", "embedding", "_limit")]))
    d = (docs.join(sizes, keys)
         .withColumn("_d", part("doc_id", "_doc_parts"))
         .withColumn("_q", every("_query_parts"))
         .select(*[F.col(c).alias(c) for c in (*keys, "_q", "_d", "doc_id", "embedding")]))
    schema = _output(queries, docs)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        query_ids, matrix = _ids(left["query_id"]), _matrix(left["embedding"])
        limits, ids, vectors = _limits(left), _ids(right["doc_id"]), _matrix(right["embedding"], matrix.shape[1])
        found = []
        for at in range(0, len(query_ids), SCAN_QUERIES):
            some = slice(at, at + SCAN_QUERIES)
            scan = _Scan(query_ids[some], matrix[some], limits[some], skip_same)
            scan.add(ids, vectors)
            found.append(pa.Table.from_arrays(_columns(scan.lists, query_ids[some], schema), schema=schema))
        return pa.concat_tables(found)

    tile = [*keys, "_q", "_d"]
    return q.groupBy(*tile).cogroup(d.groupBy(*tile)).applyInArrow(
        compare, _schema(queries, docs))


def _planes(width: int, count: int) -> np.ndarray:
    """count × width matrix of +1 / -1: component ``i`` of plane ``p`` by the first hex
    digit of ``md5('p:i')``, so every task and every engine draws the same planes."""
    digits = (hashlib.md5(f"{p}:{i}".encode()).hexdigest()[0]
              for p in range(count) for i in range(width))
    return np.array([1.0 if d < "8" else -1.0 for d in digits]).reshape(count, width)


def hyperplane_codes(vector: Column | str, tables: int, bits: int) -> Column:
    """``array<int>``: for each table, which side of its ``bits`` planes the vector is on."""
    planes: dict[int, np.ndarray] = {}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def codes(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        width = matrix.shape[1]
        if width not in planes:
            planes[width] = _planes(width, tables * bits)
        sides = (matrix @ planes[width].T >= 0).reshape(len(matrix), tables, bits)
        return pd.Series(list((sides @ (1 << np.arange(bits)[::-1])).astype(np.int32)))

    # Marked so that a later explode does not compute the codes a second time.
    return codes.asNondeterministic()(F.col(vector) if isinstance(vector, str) else vector)


def knn_topk(queries: DataFrame, docs: DataFrame, limit: int, skip_same: bool = False,
             broadcast_queries: int = BROADCAST_QUERIES, tile_queries: int = TILE_QUERIES,
             tile_docs: int = TILE_DOCS, lsh: tuple[int, int] | None = None,
             limits: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, vector_score, vector_rank)``: the nearest ``limit`` documents
    of each query by cosine of unit vectors, ties by ``doc_id``.

    ``queries`` has ``(query_id, embedding)`` and ``docs`` ``(doc_id, embedding)``, with
    unique ids; rows without a vector are left out. ``skip_same`` leaves out a document
    whose id equals the query's. ``limits`` (``(query_id, limit)``, none above ``limit``) gives every
    query a limit of its own; queries without one are left out. ``lsh=(tables, bits)`` compares only vectors that share a
    code; ``tables * 2**bits`` bounds the number of buckets.
    """
    queries = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    if limits is None:
        queries = queries.withColumn("_limit", F.lit(limit).cast("long"))
    else:
        queries = queries.join(limits.select("query_id", F.col("limit").cast("long").alias("_limit")), "query_id")
    docs = docs.select("doc_id", "embedding").where(F.col("embedding").isNotNull())
    if lsh:
        tables, bits = lsh
        if bits > 16:
            raise ValueError("at most 16 bits per table")

        def coded(df: DataFrame) -> DataFrame:
            codes = df.withColumn("_codes", hyperplane_codes("embedding", tables, bits))
            return codes.select(*df.columns, F.posexplode("_codes").alias("table", "code"))

        found = _tiled(coded(queries), coded(docs), ["table", "code"], skip_same,
                       tile_queries, tile_docs).distinct()
    elif queries.limit(broadcast_queries + 1).count() <= broadcast_queries:
        found = _broadcast_scan(queries, docs, skip_same)
    else:
        one = F.lit(0).alias("_all")
        found = _tiled(queries.select("*", one), docs.select("*", one), ["_all"],
                       skip_same, tile_queries, tile_docs)
    if limits is not None:
        return top_by_own_limit(found, limits, "vector_score", "vector_rank")
    return top_per_group(found, ["query_id"], [F.desc("vector_score"), F.col("doc_id")],
                         limit, "vector_rank")
