"""Near duplicates by HyperMinHash registers, banding and verification on full sets.

1. A text is a set of hashed word shingles. Texts with equal sets are one class, whose
   smallest id stands for it from here on.
2. HyperMinHash: each of ``REGISTERS`` buckets keeps the smallest hash that falls into it, as its
   count of leading zeros and ``MANTISSA`` bits after the first one. Empty buckets
   borrow from another bucket of the same text, in an order that is fixed per bucket.
3. Registers are cut into bands; texts that agree in a band meet in a bucket. Each bucket is a star:
   all its members are compared with its smallest id, never all with all. Pairs whose
   estimated similarity (corrected for chance collisions of registers) is far too low drop out;
   the others are confirmed on their full sets.
4. The buckets of one centre then form one star. Where it still holds several components, members outside
   the centre's component meet all others of the star in tiles of bounded size, unless the triangle inequality
   of the Jaccard distance rules a link out. They are decided on their full sets inside the tile, which
   returns only the links that join components. So no pair that meets in a bucket is left
   undecided, and members of one component are not compared again.
5. Connected components of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duoglot.llm.common import chunks, no_finer, stored
from duoglot.llm.components import connected_components
from duoglot.llm.substring_dedup import mixed

REGISTERS, MANTISSA, VALUE_BITS = 256, 10, 56
ROWS = 6                        # registers in a band; 42 bands: at similarity 0.8 a pair
BANDS = REGISTERS // ROWS       # meets nowhere with probability (1 - 0.8**6)**42 = 3e-6
BROADCAST_IDS = 1_000_000
CHUNK_ROWS = 500                # members of one star, and of one side of a tile, in a task
CHUNK_SHINGLES = 1_000_000      # of one side of a tile, about; 8 bytes each


def shingle_sets(texts: list[str | None], size: int = 4) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of ``size`` consecutive words, A-Z in lower case; a
    shorter text has its whole sequence as its one shingle, a text without words none."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    flat = [w for t in split for w in t]
    own = (pd.util.hash_array(np.array(flat, dtype=object), hash_key="duoglot-shingles", categorize=True)
           if flat else np.empty(0, np.uint64))
    out, at = [], 0
    factor = np.uint64(0x9E3779B97F4A7C15)
    for text in split:
        h = own[at:at + len(text)]
        at += len(text)
        n = min(size, len(h))
        total = np.zeros(max(len(h) - n + 1, 0) if n else 0, np.uint64)
        for i in range(n):
            total = total * factor + h[i:len(h) - n + 1 + i]
        out.append(np.unique(mixed(total + np.uint64(n))))
    return out


def borrow_order() -> np.ndarray:
    """For each bucket the order in which it asks the others: fixed for all texts."""
    bucket = np.arange(REGISTERS, dtype=np.uint64)
    return np.argsort(mixed(bucket[:, None] * np.uint64(1000003) + bucket[None, :] + np.uint64(1)), axis=1)


def registers(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(texts, REGISTERS)`` 16-bit registers, and how many buckets each text fills itself."""
    sizes = np.array([len(s) for s in sets])
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    if sizes.sum():
        h = np.concatenate(sets)
        cell = (np.repeat(np.arange(len(sets)), sizes) * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype(np.int64))
        order = np.lexsort((h, cell))
        cell, h = cell[order], h[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        least[cell[first]] = h[first] >> np.uint64(8)
    least = least.reshape(len(sets), REGISTERS)
    full = least != np.iinfo(np.uint64).max
    # Leading zeros of the 56-bit value, and the bits that follow its first one.
    length = np.frexp(np.maximum(least, 1).astype(np.float64))[1].astype(np.int64)
    over = (least >> np.minimum(np.maximum(length - 1, 0), 63).astype(np.uint64)) == 0
    length = np.where(full, np.minimum(length - over, VALUE_BITS), 1)
    shift = length - 1 - MANTISSA
    bits = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64),
                    least << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out = ((VALUE_BITS - length).astype(np.uint16) << MANTISSA) | bits.astype(np.uint16)
    own, asked = full.sum(axis=1), borrow_order()
    row, column = np.nonzero(~full & (own > 0)[:, None])
    for attempt in range(REGISTERS):
        if not len(row):
            break
        lender = asked[column, attempt]
        lends = full[row, lender]
        out[row[lends], column[lends]] = out[row[lends], lender[lends]]
        row, column = row[~lends], column[~lends]
    return out, own


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two disjoint sets of ``n`` and ``m`` that agree by chance: the published
    approximation for HyperMinHash."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    return 0.169919487159739093975 * REGISTERS / 2 ** MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    chance = expected_collisions(n, m)
    return ((left == right).sum(axis=-1) - chance) / (REGISTERS - chance)


def lowest_estimate(threshold: float, own: np.ndarray) -> np.ndarray:
    """Below this estimate a pair of true similarity ``threshold`` is over five standard
    deviations off; few filled buckets are no evidence at all."""
    return np.where(own < 64, -1.0, threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(own, 1)))


def signatures(documents: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc, n, h1, h2, own, regs)`` per row; ``n, h1, h2`` name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), size)
            regs, own = registers(sets)
            h1 = [int(s.sum(dtype=np.uint64)) - (1 << 63) for s in sets]
            h2 = [int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - (1 << 63) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()),
                 pa.array(h2, pa.int64()), pa.array(own, pa.int32()),
                 pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc", "n", "h1", "h2", "own", "regs"])

    return (documents.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc", f"coalesce(`{text_col}`, '') AS text")
            .mapInArrow(run, "doc long, n long, h1 long, h2 long, own int, regs binary"))


def band_keys(classes: DataFrame) -> DataFrame:
    """``(key, doc)``, one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                regs = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint16)
                regs = regs.reshape(-1, REGISTERS)[:, :ROWS * BANDS].reshape(-1, BANDS, ROWS).astype(np.uint64)
                keys = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), regs.shape[:2])
                for i in range(ROWS):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, i])
                docs = np.repeat(part.column("doc").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(docs)],
                                                 names=["key", "doc"])

    return classes.select("doc", "regs").mapInArrow(run, "key long, doc long")


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``pairs (a, b)`` whose sizes and registers allow a similarity of ``threshold``."""
    sides = [classes.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("own").alias(f"own_{c}"),
                            F.col("regs").alias(f"regs_{c}")) for c in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                left, right = (np.frombuffer(b"".join(part.column(f"regs_{c}").to_pylist()), np.uint16)
                               .reshape(-1, REGISTERS) for c in ("a", "b"))
                n, m = part.column("n_a").to_numpy(), part.column("n_b").to_numpy()
                own = np.minimum(part.column("own_a").to_numpy(), part.column("own_b").to_numpy())
                good = pa.array(estimate(left, right, n, m) >= lowest_estimate(threshold, own))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)],
                                                 names=["a", "b"])

    joined = pairs.join(sides[0], "a").join(sides[1], "b").where(
        F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return joined.mapInArrow(run, "a long, b long")


def similarities(pairs: DataFrame, documents: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(a, b, common, either)`` of stored ``pairs``: sizes of intersection and union of the full sets.

    Pairs are grouped by ``a``, whose text comes once per ``CHUNK_ROWS`` of its partners.
    """
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # 8 bytes each, counted
    texts = documents.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc", f"coalesce(`{text_col}`, '') AS text")
    texts = stored(texts.join(ids, "doc", "left_semi"), "near-texts")
    split = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("parts"))
    dealt = pairs.join(split, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    left = (dealt.select("a", "part").distinct().join(texts.withColumnRenamed("doc", "a"), "a"))
    right = (dealt.select(F.col("a").alias("of"), F.col("part").alias("of_part"), F.col("b").alias("other"))
             .join(texts.select(F.col("doc").alias("other"), F.col("text").alias("own_text")), "other"))

    def compare(one: pa.Table, many: pa.Table) -> pa.Table:
        # An id that occurs in several rows has several texts; its best one counts.
        best: dict[int, tuple[int, int]] = {}
        a = one.column("a")[0].as_py() if one.num_rows else None
        for whole in shingle_sets(one.column("text").to_pylist(), size):
            for at in range(0, many.num_rows, 100):
                some = many.slice(at, 100)
                for b, other in zip(some.column("other").to_pylist(),
                                    shingle_sets(some.column("own_text").to_pylist(), size)):
                    common = len(np.intersect1d(whole, other, assume_unique=True))
                    either = len(whole) + len(other) - common
                    old = best.get(b)
                    if old is None or common * old[1] > old[0] * either:
                        best[b] = common, either
        return pa.table({"a": pa.array([a] * len(best), pa.int64()), "b": pa.array(list(best), pa.int64()),
                         "common": pa.array([x for x, _ in best.values()], pa.int64()),
                         "either": pa.array([x for _, x in best.values()], pa.int64())})

    return (left.groupBy("a", "part").cogroup(right.groupBy("of", "of_part"))
            .applyInArrow(compare, "a long, b long, common long, either long"))


def member_sets(ids: DataFrame, documents: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc, n, own, regs, shingles)`` of the documents in ``ids (doc)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), size)
            regs, own = registers(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.int32()),
                 pa.array([r.tobytes() for r in regs], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc", "n", "own", "regs", "shingles"])

    texts = documents.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc", f"coalesce(`{text_col}`, '') AS text")
    return texts.join(ids, "doc", "left_semi").mapInArrow(
        run, "doc long, n long, own int, regs binary, shingles binary").where("n > 0")


def tiles_of(spokes: DataFrame, classes: DataFrame, labels: DataFrame, measured: DataFrame,
             documents: DataFrame, threshold: float) -> DataFrame:
    """``(center, outside, i, j, minor, block, doc, component, far)``: which members meet where.

    A member of a star is minor if its component is not the centre's. Minor members are cut
    into blocks; block ``i`` meets block ``j`` of the centre's component or, if ``outside``,
    of the minor members. Members of one component never meet, so without minor members
    there are no tiles, however large the star.
    """
    members = spokes.select(F.col("a").alias("center"), F.col("b").alias("doc")).unionByName(
        spokes.select(F.col("a").alias("center"), F.col("a").alias("doc")).distinct())
    sizes = classes.groupBy("doc").agg(F.sum("n").alias("n"))
    distance = measured.select(F.col("a").alias("center"), F.col("b").alias("doc"),
                               (1 - F.col("common") / F.col("either")).alias("far"))
    of_center = labels.select(F.col("id").alias("center_id"), F.col("component").alias("core"))
    labelled = stored(no_finer(
        members.join(labels, F.col("doc") == F.col("id"), "left")
        .join(of_center, F.col("center") == F.col("center_id"), "left")
        .select("center", "doc", F.coalesce("component", "doc").alias("component"),
                F.coalesce("core", "center").alias("core"))
        .join(distance, ["center", "doc"], "left").join(sizes, "doc")
        .select("center", "doc", "component", "n", "far", (F.col("component") != F.col("core")).alias("minor")),
        documents), "near-members")

    def blocks(side: str):
        rows, shingles = F.count_if(F.expr(side)), F.sum(F.when(F.expr(side), F.col("n")).otherwise(0))
        return F.greatest(F.lit(1), F.ceil(rows / CHUNK_ROWS), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")

    # By the triangle inequality a link needs distances to the centre that differ by 1 - threshold
    # at most. A star of two has been measured.
    stars = (labelled.groupBy("center").agg(
        F.max("minor").alias("several"), F.count("*").alias("rows"),
        F.min(F.when(F.col("minor"), F.coalesce("far", F.lit(0.0)))).alias("least_far"),
        blocks("minor").alias("minor_blocks"), blocks("NOT minor").alias("core_blocks"))
        .where("several AND rows > 2").drop("several", "rows"))
    near = F.col("far").isNull() | (F.col("far") >= F.col("least_far") - (1 - threshold) - 1e-9)
    rows = (labelled.join(stars, "center").where(F.col("minor") | near)
            .withColumn("block", F.pmod(F.xxhash64("doc"), F.when(F.col("minor"), F.col("minor_blocks"))
                                        .otherwise(F.col("core_blocks"))).cast("int")))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = F.col("block")
    tile = lambda outside, i, j: F.struct(F.lit(outside).alias("outside"), i.alias("i"), j.alias("j"))
    meets = F.when(F.col("minor"), F.concat(
        F.transform(count("core_blocks"), lambda j: tile(False, block, j)),
        F.transform(count("minor_blocks"), lambda j: tile(True, F.least(block, j), F.greatest(block, j))))
    ).otherwise(F.transform(count("minor_blocks"), lambda i: tile(False, i, block)))
    return (rows.withColumn("tile", F.explode(meets))
            .select("center", "tile.*", "minor", "block", "doc", "component", "far"))


def other_links(tiles: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: confirmed links between components, of each tile as many as join its components.

    Every pair of a tile that distances, sizes and registers do not rule out is decided on its full sets, in
    the task; no pairs are written.
    """

    def compare(tile: pa.Table) -> pa.Table:
        outside, i, j = (tile.column(c)[0].as_py() for c in ("outside", "i", "j"))
        minor, block, doc, component, n, own = (
            tile.column(c).to_numpy() for c in ("minor", "block", "doc", "component", "n", "own"))
        far = tile.column("far").to_numpy().astype(float)  # null: NaN, which rules nothing out
        regs = np.frombuffer(b"".join(tile.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(s, np.uint64) for s in tile.column("shingles").to_pylist()]
        left = np.flatnonzero(minor & (block == i))
        right = np.flatnonzero(minor & (block == j)) if outside else np.flatnonzero(~minor)
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        if len(left) and len(right):
            # All shingles of the right side in order, each with its member.
            flat = np.concatenate([sets[r] for r in right])
            owner = np.repeat(np.arange(len(right)), [len(sets[r]) for r in right])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for a in left:
                ok = component[right] != component[a]
                ok &= np.minimum(n[right], n[a]) >= threshold * np.maximum(n[right], n[a])
                ok &= ~(np.abs(far[right] - far[a]) > 1 - threshold + 1e-9)
                ok[ok] = estimate(regs[right[ok]], regs[a], n[right[ok]], n[a]) >= lowest_estimate(
                    threshold, np.minimum(own[right[ok]], own[a]))
                if not ok.any():
                    continue
                first, stop = np.searchsorted(flat, sets[a], "left"), np.searchsorted(flat, sets[a], "right")
                hits = stop - first
                at = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits - first, hits)
                common = np.bincount(owner[at], minlength=len(right))
                for b in right[ok & (common >= threshold * (n[right] + n[a] - common) - 1e-9)]:
                    one, other = find(int(component[a])), find(int(component[b]))
                    if one != other:
                        root[one] = other
                        found.append((min(doc[a], doc[b]), max(doc[a], doc[b])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()),
                         "b": pa.array([b for _, b in found], pa.int64())})

    return (tiles.join(sets, "doc").groupBy("center", "outside", "i", "j")
            .applyInArrow(compare, "a long, b long").distinct())


def near_duplicates(documents: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per row of ``documents``.

    Documents are linked if the Jaccard similarity of their shingle sets is ``threshold`` or more.
    ``component_id`` is the smallest id that links reach, ``kept`` tells whether it is the row's own.
    A text that is null or has no words is linked with nothing. Rows with one id are one
    document with the links of all its rows. A row with a null id is linked with nothing, has a
    null component and is kept. Other columns are not read.
    """
    rows = stored(signatures(documents, size, id_col, text_col), "near-signatures")
    named = ["n", "h1", "h2"]
    classes = stored(rows.where("n > 0 AND doc IS NOT NULL").groupBy(*named)
                     .agg(F.min("doc").alias("doc"), F.first("own").alias("own"), F.first("regs").alias("regs")),
                     "near-classes", rows.count(), file_rows=20_000)
    keys = band_keys(classes)
    stars = keys.groupBy("key").agg(F.min("doc").alias("center"), F.max("doc").alias("last")).where("center < last")
    spokes = stored(no_finer(keys.join(stars.select("key", "center"), "key").where("doc != center")
                             .select(F.col("center").alias("a"), F.col("doc").alias("b")).distinct(), documents),
                    "near-spokes")
    # These and the members read all classes, however few spokes there are.
    pairs = stored(no_finer(likely(spokes, classes, threshold), documents), "near-pairs")
    measured = stored(similarities(pairs, documents, size, id_col, text_col), "near-measured", pairs.count(),
                      file_rows=2_000)
    member = rows.select("doc", *named).join(
        classes.select(*named, F.col("doc").alias("class_doc")), named, "left")
    # Rows of one id with different texts are one document: their classes belong together.
    several = (member.where("doc IS NOT NULL").groupBy("doc")
               .agg(F.min("class_doc").alias("a"), F.max("class_doc").alias("last")).where("a < last"))
    one_id = member.join(several, "doc").select("a", F.col("class_doc").alias("b")).where("b IS NOT NULL")
    linked = f"common >= {threshold} * either - 1e-9"
    links = measured.where(linked).select("a", "b").unionByName(one_id)
    n_links = measured.count() + rows.count()
    labels = connected_components(links, rows=n_links)
    tiles = stored(no_finer(tiles_of(spokes, classes, labels, measured, documents, threshold), documents), "near-tiles")
    n_tiles = tiles.count()
    if n_tiles:
        sets = stored(member_sets(tiles.select("doc").distinct(), documents, size, id_col, text_col), "near-sets")
        more = stored(other_links(tiles, sets, threshold), "near-more", n_tiles, file_rows=CHUNK_ROWS)
        labels = connected_components(links.unionByName(more), rows=n_links + more.count())
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "class_doc", "doc"))
    return (member.join(labels, F.col("class_doc") == F.col("id"), "left")
            .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                    F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept")))
