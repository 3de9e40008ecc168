"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves, each quantised by centroids of its own; a cell
is a pair of centroids. A query walks through cells in the order of the summed distances
to both centroids, taken from a heap, until the cells hold enough entries; these are reranked by
exact cosine. Equal vectors are one entry that keeps the few smallest ids that can
appear in a result, so a vector that many rows share costs no more than any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from duoglot.llm.common import stored

SAMPLE_NUMBERS = 2_000_000  # in the vectors that centroids are fitted on
CELL_ROWS = 2_000           # entries of a first centroid in one task
BLOCK_SCORES = 4_000_000    # scores held at once in a task
ROUGH_MARGIN = 1e-9         # rough scores, as cosines, differ from exact ones by far less
TRAVERSED_QUERIES = 64      # in one task


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)``: double vectors without null or non-finite components that are not zero."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0)  # -0.0 becomes 0.0
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & good
                   & F.exists("v", lambda x: x != 0)))


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """``(v, ids)``: distinct vectors with their ``keep`` smallest ids. Each task cuts first,
    so a group holds at most ``keep`` ids per task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list] = {}
            for at, (i, v) in enumerate(zip(batch.column("id").to_pylist(), batch.column("v"))):
                groups.setdefault(v.values.to_numpy(zero_copy_only=False).tobytes(), []).append((i, at))
            first = [min(g)[1] for g in groups.values()]
            ids = [sorted({i for i, _ in g})[:keep] for g in groups.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("v").take(pa.array(first, pa.int64())), pa.array(ids, pa.list_(pa.int64()))],
                names=["v", "ids"])

    return (rows.mapInArrow(cut, "v array<double>, ids array<bigint>").groupBy("v")
            .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")))


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    random = np.random.default_rng(seed)
    centroids = points[random.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centroids))
        some = counts > 0
        centroids = np.where(some[:, None], sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points ** 2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids ** 2).sum(axis=1)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(points, centroids).argmin(axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def fit(distinct: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves from the vectors of smallest hash, a bounded sample. About 4
    entries per cell, with at most 256 centroids a half."""
    width = distinct.select(F.size("v")).first()[0]
    rows = max(256, SAMPLE_NUMBERS // width)
    sample = distinct.select("v").orderBy(F.xxhash64("v")).limit(rows).toPandas()["v"]
    points = unit(np.array(sample.tolist(), np.float64))
    k = int(min(256, max(2, (count / 4) ** 0.5)))
    half = max(1, width // 2)
    return kmeans(points[:, :half], k), kmeans(points[:, half:], k) if half < width else np.zeros((1, 0))


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Numbers of non-empty cells by rising sum of distances until they hold ``wanted``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, total = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            total += int(sizes[cell])
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (first[a[n[0]]] + second[b[n[1]]], *n))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, candidates: int = 4_000,
           share: float = 0.5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` nearest rows of ``vectors`` by cosine for
    each row of ``queries``, never the row of the query's own id; ties to the smaller id.

    Per query ``candidates`` entries or the given share of all, whichever is more, are reranked
    (whole cells, so more; all if there are fewer). The share is what vectors without any
    cluster structure need for a recall over 0.9; with structure it can be far lower.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    vectors of another length than the most common one. Of repeated rows with one id and one vector, one counts.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distinct = stored(entries(usable(vectors, id_col, vector_col), k + 1), "index-entries")
    width = distinct.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return empty
    distinct = distinct.where(F.size("v") == width["width"])
    centroids = fit(distinct, width["count"])
    half = centroids[0].shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("v")))
                cell = nearest(x[:, :half], centroids[0]) * len(centroids[1]) + nearest(x[:, half:], centroids[1])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns],
                                                 names=["cell", "v", "ids"])

    placed = stored(distinct.mapInArrow(place, "cell int, v array<double>, ids array<bigint>"), "index-cells")
    sizes = np.zeros(len(centroids[0]) * len(centroids[1]), np.int64)  # at most 65,536 cells
    for cell, n in placed.groupBy("cell").count().collect():
        sizes[cell] = n
    asked = stored(usable(queries, id_col, vector_col).where(F.size("v") == width["width"])
                   .withColumn("q", F.xxhash64("v")).distinct(), "index-queries")

    wanted = max(candidates, int(share * width["count"]))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("v")))
                one, two = distances(x[:, :half], centroids[0]), distances(x[:, half:], centroids[1])
                rows, firsts, seconds = [], [], []
                for row, (a, b) in enumerate(zip(one, two)):
                    by_first: dict[int, list[int]] = {}
                    for cell in walk(a, b, sizes, wanted):
                        by_first.setdefault(cell // len(two[0]), []).append(cell % len(two[0]))
                    rows.extend([row] * len(by_first))
                    firsts.extend(by_first)
                    seconds.extend(by_first.values())
                row = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(firsts, pa.int32()), pa.array(seconds, pa.list_(pa.int32())),
                     batch.column("q").take(row), batch.column("v").take(row)],
                    names=["first", "seconds", "q", "v"])

    # A query goes once to each first centroid on its way, with the second ones it visits there.
    tasks = max(1, asked.count() // TRAVERSED_QUERIES)
    visits = (asked.groupBy("q").agg(F.first("v").alias("v")).repartition(tasks, "q").mapInArrow(
        traverse, "first int, seconds array<int>, q bigint, v array<double>"))
    by_first = sizes.reshape(len(centroids[0]), -1).sum(axis=1)
    split = F.element_at(F.array(*[F.lit(max(1, int(-(-n // CELL_ROWS)))) for n in by_first]), F.col("first") + 1)
    left = (placed.withColumn("first", F.expr(f"CAST(cell DIV {len(centroids[1])} AS int)"))
            .withColumn("part", F.pmod(F.xxhash64("v"), split).cast("int")))
    right = visits.withColumn("part", F.explode(F.sequence(F.lit(0), split - 1))).select(
        F.col("first").alias("of"), F.col("part").alias("of_part"), "seconds", "q", F.col("v").alias("query"))

    def rerank(group: pa.Table, asked_: pa.Table) -> pa.Table:
        best: dict[int, list] = {}
        if group.num_rows and asked_.num_rows:
            second = group.column("cell").to_numpy() % len(centroids[1])
            x, y = matrix(group.column("v").combine_chunks()), matrix(asked_.column("query").combine_chunks())
            x_size, y_size = np.sqrt((x ** 2).sum(axis=1)), np.sqrt((y ** 2).sum(axis=1))
            ids = group.column("ids").to_pylist()
            wants = np.zeros((len(y), len(centroids[1])), bool)
            for row, cells in enumerate(asked_.column("seconds").to_pylist()):
                wants[row, cells] = True
            cells = [(cell, np.flatnonzero(second == cell)) for cell in np.unique(second)]
            names = asked_.column("q").to_pylist()
            size = min(k + 1, len(x))
            step = max(1, BLOCK_SCORES // len(x))
            for at in range(0, len(y), step):
                some = y[at:at + step]
                rough = np.full((len(some), len(x)), -np.inf)
                for cell, entries_ in cells:
                    rows = np.flatnonzero(wants[at:at + step, cell])
                    rough[np.ix_(rows, entries_)] = (some[rows] @ x[entries_].T) / x_size[entries_]
                # Every entry that may still tie with the last one of the list is scored exactly.
                last = np.partition(rough, len(x) - size, axis=1)[:, len(x) - size]
                for row, low in enumerate(last - ROUGH_MARGIN * y_size[at:at + step]):
                    places = np.flatnonzero((rough[row] >= low) & (rough[row] > -np.inf))
                    score = (x[places] * some[row]).sum(axis=1) / (x_size[places] * y_size[at + row])
                    best[names[at + row]] = sorted((-s, i) for s, p in zip(score, places) for i in ids[p])[:k + 1]
        flat = [(q, i, -s) for q, found_ in best.items() for s, i in found_]
        return pa.table({name: pa.array([row[at] for row in flat], kind) for at, (name, kind) in enumerate(
            (("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    found = left.groupBy("first", "part").cogroup(right.groupBy("of", "of_part")).applyInArrow(
        rerank, "q bigint, vec_id bigint, score double")
    # k + 1 per query vector, as one of them may be the query itself.
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = (found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
             .groupBy("q").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found")))
    # A result per query id: the id's own row leaves the list, places close up.
    near = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return (asked.select("id", "q").join(lists, "q").select("id", F.posexplode(near).alias("place", "x"))
            .select(F.col("id").alias("query_id"), (F.col("place") + 1).cast("int").alias("rank"),
                    "x.vec_id", "x.score"))
