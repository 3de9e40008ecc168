"""Approximate nearest neighbours from stored codes.

Every vector has one code per table: which side of each of the table's random hyperplanes
it is on (Charikar 2002). An inverted table ``(bucket, doc_id)``, a bucket being a table and a code, is
written once, in the order of buckets. A search reads the buckets nearest to each query (multi-probe,
Lv et al. 2007), counts in how many tables a document was met, and fetches the vectors of those
documents only. No bucket is cut: what is met is compared.

Distances to the planes are whole ten-thousandths, so that sides, costs and ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duoglot.functions.vectors import cosine
from duoglot.operators.knn import (BROADCAST_QUERIES, _arrow_type, _ids, _matrix, _output, _planes,
                                   _rounded, _schema)
from duoglot.operators.topk import top_by_own_limit, top_per_group

MAX_BITS = 12                  # 4,096 codes a table are ranked for each query
BROADCAST_PROBES = 1_000_000   # × 20 bytes
_UNIT = 10_000
_BLOCK_CELLS = 4_000_000


@dataclass(frozen=True)
class Codes:
    """``tables`` codes of ``bits`` bits each."""

    tables: int
    bits: int

    def __post_init__(self):
        if self.tables < 1 or not 1 <= self.bits <= MAX_BITS:
            raise ValueError(f"codes need a table and 1 to {MAX_BITS} bits")


def _margins(vectors: np.ndarray, spec: Codes, planes: dict[int, np.ndarray]) -> np.ndarray:
    """n × tables × bits whole numbers: signed distances to the planes."""
    width = vectors.shape[1]
    if width not in planes:
        planes[width] = _planes(width, spec.tables * spec.bits)
    return np.floor(vectors @ planes[width].T * _UNIT + 0.5).astype(np.int64).reshape(
        len(vectors), spec.tables, spec.bits)


def _code(margins: np.ndarray, spec: Codes) -> np.ndarray:
    return (margins >= 0) @ (1 << np.arange(spec.bits)[::-1])


def code_rows(vectors: DataFrame, spec: Codes) -> DataFrame:
    """``(doc_id, vector_name, bucket)``: ``spec.tables`` rows per vector of
    ``(doc_id, vector_name, embedding)``; none for a null one."""
    schema = pa.schema([("doc_id", _arrow_type(vectors.schema["doc_id"].dataType.simpleString())),
                        ("vector_name", pa.string()), ("bucket", pa.int32())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _code(_margins(_matrix(batch.column("embedding")), spec, planes), spec)
            buckets = codes + (np.arange(spec.tables) << spec.bits)
            row = pa.array(np.repeat(np.arange(batch.num_rows), spec.tables))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("vector_name").take(row),
                 pa.array(buckets.ravel().astype(np.int32))], schema=schema)

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return (vectors.select("doc_id", "vector_name", "embedding").where(F.col("embedding").isNotNull())
            .mapInArrow(code, f"doc_id {kind}, vector_name string, bucket int"))


def probe_rows(queries: DataFrame, spec: Codes, probes: int) -> DataFrame:
    """``(query_id, bucket)``: in every table the ``probes`` codes (all, if there are fewer) that are nearest
    to the query: least sum of squared distances to the planes that lie between, ties by code."""
    schema = pa.schema([("query_id", _arrow_type(queries.schema["query_id"].dataType.simpleString())),
                        ("bucket", pa.int32())])
    masks = np.arange(1 << spec.bits)
    flips = ((masks[:, None] >> np.arange(spec.bits)[::-1]) & 1).T
    probes = min(probes, len(masks))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        step = max(1, _BLOCK_CELLS // (spec.tables * len(masks)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                margins = _margins(_matrix(batch.column("embedding")), spec, planes)
                codes = _code(margins, spec)[:, :, None] ^ masks
                order = np.lexsort((codes, margins ** 2 @ flips), axis=2)[:, :, :probes]
                buckets = np.take_along_axis(codes, order, 2) + (
                    np.arange(spec.tables) << spec.bits)[None, :, None]
                row = pa.array(np.repeat(np.arange(batch.num_rows), spec.tables * probes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(row), pa.array(buckets.ravel().astype(np.int32))],
                    schema=schema)

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "embedding").mapInArrow(probe, f"query_id {kind}, bucket int")


def _score_by_document(queries: DataFrame, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """A document's vector travels once, with the queries that met it; those are few and broadcast."""
    rows = queries.toArrow()
    ids = _ids(rows["query_id"])
    shared = queries.sparkSession.sparkContext.broadcast((ids, _matrix(rows["embedding"])))
    schema = _output(queries, vectors)
    # At most one entry per query: as long as the broadcast.
    met = pairs.groupBy("doc_id").agg(F.collect_list("query_id").alias("asked"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        position = pd.Index(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = batch.column("asked")
            query = position.get_indexer(_ids(asked.flatten()))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            docs = _matrix(batch.column("embedding"), matrix.shape[1])
            step = max(1, _BLOCK_CELLS // matrix.shape[1])
            scores = [np.einsum("ij,ij->i", matrix[query[at:at + step]], docs[doc[at:at + step]])
                      for at in range(0, len(query), step)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[query].tolist(), schema.field(0).type),
                 batch.column("doc_id").take(pa.array(doc)).cast(schema.field(1).type),
                 pa.array(_rounded(np.concatenate(scores)), pa.float64())], schema=schema)

    return (vectors.join(met, "doc_id").select("doc_id", "embedding", "asked")
            .mapInArrow(score, _schema(queries, vectors)))


def _score_pairs(queries: DataFrame, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    asked = queries.select("query_id", F.col("embedding").alias("asked"))
    return pairs.join(vectors, "doc_id").join(asked, "query_id").select(
        "query_id", "doc_id", cosine("embedding", "asked").alias("vector_score"))


def met_documents(codes: DataFrame, probed: DataFrame, shared: int = 1) -> DataFrame:
    """``(query_id, doc_id)`` of documents that a query meets in at least ``shared`` tables.

    Rows move by ``doc_id`` once, which also serves a join with vectors bucketed by it.
    """
    return (codes.join(probed, "bucket").select("query_id", "doc_id").repartition("doc_id")
            .groupBy("doc_id", "query_id").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= shared).select("query_id", "doc_id"))


def nearest_of(queries: DataFrame, pairs: DataFrame, vectors: DataFrame, limit: int,
               limits: DataFrame | None = None, broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """``(query_id, doc_id, vector_score, vector_rank)``: the nearest ``limit`` of the documents paired
    with each query, by cosine of unit vectors, ties by ``doc_id``. ``limits`` as in ``knn_topk``."""
    queries = queries.select("query_id", "embedding")
    few = queries.limit(broadcast_queries + 1).count() <= broadcast_queries
    found = (_score_by_document if few else _score_pairs)(
        queries, pairs, vectors.where(F.col("embedding").isNotNull()))
    if limits is not None:
        return top_by_own_limit(found, limits, "vector_score", "vector_rank")
    return top_per_group(found, ["query_id"], [F.desc("vector_score"), F.col("doc_id")],
                         limit, "vector_rank")
