"""Keyword retrieval: postings, statistics, BM25 (Robertson & Zaragoza 2009)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from duoglot.functions.text import tokens
from duoglot.functions.vectors import round_score
from duoglot.operators.skew import ROWS_PER_SPLIT, hot_keys, salted_join
from duoglot.operators.topk import top_by_own_limit, top_per_group
from duoglot.operators.words import word_runs

K1 = 1.2
B = 0.75
DEFAULT_FIELDS = {"multilingual_concat": 1.0}
# From this many postings to score on, documents that cannot reach the top are left out.
PRUNE_FROM = 200_000_000
# Postings read per wanted hit to find a first threshold.
PROBE_POSTINGS = 20
# Scores are rounded to 6 digits; a document this close to the threshold may still tie.
MARGIN = 2e-6
# Query terms are broadcast up to this many rows (about 100 bytes each).
BROADCAST_TERM_ROWS = 1_000_000
# A query table of up to this many terms pushes them to the postings scan; with more,
# hardly a part of a file is without any of them.
PUSHED_TERMS = 200
# Pairs of query and document range that are broadcast at once (about 50 bytes each).
RANGE_PAIRS = 1_000_000
# Slices of neighbouring ranges that a batch of queries is scored in, about.
RANGE_SLICES = 200
# Documents that the best ranges should hold, per wanted hit, to find a first threshold.
PROBE_DOCS = 2
# Up to this many ranges are pushed to the postings scan, which also tests every row that it reads.
PUSHED_RANGES = 100
# Parts of the queries, per batch needed, that batches are put together from.
BATCH_PARTS = 8
# Postings that a task reduces to bounds at a time (about 100 bytes each), and rows it hands on at once.
IMPACT_ROWS = 1_000_000
OUT_ROWS = 65_536


def _field_words(docs: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``(keep…, field, words)``: a row per document and field."""
    per_field = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), tokens(f).alias("words")) for f in fields]))
    return docs.select(*keep, per_field.alias("t")).select(*keep, "t.field", "t.words")


def _lengths(part: pa.RecordBatch) -> np.ndarray:
    return np.diff(part.column("words").offsets.to_numpy())


def postings(docs: DataFrame, fields: Sequence[str] = ("multilingual_concat",),
             keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, field, term, tf, dl)``: occurrences of a term in a field and the field's
    token count, and the columns ``keep`` of the document. ``doc_id`` must be unique.

    A row's words are counted where the row is, in Arrow batches that take them as lists: nothing is
    grouped or shuffled, and postings stay in the order of ``docs``.
    """
    words = _field_words(docs, fields, ["doc_id", *keep])
    kinds = [f"`{c}` {words.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, terms, times in word_runs(batch):
                place = pa.array(row)
                found = pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(place), part.column("field").take(place), terms, pa.array(times),
                     pa.array(_lengths(part)[row]), *[part.column(c).take(place) for c in keep]],
                    names=["doc_id", "field", "term", "tf", "dl", *keep])
                yield from (found.slice(at, OUT_ROWS) for at in range(0, len(found), OUT_ROWS))

    return words.mapInArrow(count, ", ".join(
        [kinds[0], "field string", "term string", "tf bigint", "dl int", *kinds[1:]]))


def impact_ranges(posted: DataFrame) -> DataFrame:
    """``(field, term, doc_range, max_tf, min_dl, n)`` of postings with a ``doc_range``.

    BM25 rises with the occurrences of a term and falls with the length of the text, so the two
    extremes bound what the term can add to any document of the range, whatever weights and mean
    length a later search has. Rows that are replaced later only leave a bound higher than needed.
    """
    return posted.groupBy("field", "term", "doc_range").agg(
        F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count(F.lit(1)).alias("n"))


_IMPACTS = pa.schema([("field", pa.string()), ("term", pa.string()), ("doc_range", pa.int64()),
                      ("max_tf", pa.int64()), ("min_dl", pa.int32()), ("n", pa.int64())])


def _reduced(rows: pa.Table) -> pa.Table:
    """One row per term, field and range, in that order."""
    def ranked(column: str) -> tuple[pa.Array, np.ndarray]:
        coded = rows[column].combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        return coded.dictionary.take(order), place[coded.indices.to_numpy()]

    (terms, term), (fields, field) = ranked("term"), ranked("field")
    ranges, within = np.unique(rows["doc_range"].to_numpy(), return_inverse=True)
    key = (term * len(fields) + field) * len(ranges) + within
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, within = np.divmod(key[first], len(ranges))
    return pa.Table.from_arrays([
        fields.take(pa.array(key % len(fields))), terms.take(pa.array(key // len(fields))), pa.array(ranges[within]),
        *[pa.array(reduce.reduceat(rows[c].to_numpy()[order], first)) for c, reduce in (
            ("max_tf", np.maximum), ("min_dl", np.minimum), ("n", np.add))]], schema=_IMPACTS)


def impacts_of_docs(docs: DataFrame, fields: Sequence[str], run_rows: int = IMPACT_ROWS) -> DataFrame:
    """The :func:`impact_ranges` of the postings of ``docs``, whose ranges are neighbours within a task.

    A task reduces about ``run_rows`` postings at a time and carries the last range over, so nothing is shuffled or
    spilled. The words come as lists of a row: a row per posting is several times dearer to hand over than to
    split the texts again. Within such a run rows are in the order of terms, so a scan for few terms skips pages.
    """
    # Spark reads a table by buckets only with their column, and ranges are numbered by buckets.
    words = _field_words(docs, fields, ["doc_id", "doc_range"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, n_open = [], 0, 0
        for batch in batches:
            for part, row, terms, times in word_runs(batch):
                if not len(row):
                    continue
                place = pa.array(row)
                held.append(pa.Table.from_arrays(
                    [part.column("field").take(place), terms, part.column("doc_range").take(place), pa.array(times),
                     pa.array(_lengths(part)[row]), pa.array(np.ones(len(row), dtype=np.int64))], schema=_IMPACTS))
                n_held += len(row)
                if n_held >= n_open + run_rows:
                    last = held[-1]["doc_range"][-1]
                    whole = _reduced(pa.concat_tables(held))
                    # The last range may go on: its rows are merged with what follows.
                    going_on = pc.equal(whole["doc_range"], last)
                    yield from whole.filter(pc.invert(going_on)).to_batches(OUT_ROWS)
                    held = [whole.filter(going_on)]
                    n_held = n_open = held[0].num_rows
        if held:
            yield from _reduced(pa.concat_tables(held)).to_batches(OUT_ROWS)

    return words.mapInArrow(reduce, "field string, term string, doc_range bigint, max_tf bigint, min_dl int, n bigint")


def term_statistics(posted: DataFrame) -> DataFrame:
    """``(field, term, df)``: in how many documents a term occurs."""
    return posted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_statistics(posted: DataFrame) -> DataFrame:
    """``(field, n_docs, sum_dl)``: documents with at least one token and their tokens.

    Token counts are the sum of the term frequencies, so no distinct is needed for them.
    """
    per_doc = posted.groupBy("doc_id", "field").agg(F.sum("tf").alias("dl"))
    return per_doc.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("sum_dl"))


def query_terms(queries: DataFrame, text_col: str = "keyword_query") -> DataFrame:
    """``(query_id, term)``, each term once per query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(text_col))).alias("term"))


def weigh_terms(terms: DataFrame, term_stats: DataFrame,
                totals: Mapping[str, tuple[int, int]],
                fields: Mapping[str, float]) -> DataFrame:
    """``(query_id, field, term, df, weight, avgdl)`` for the terms that occur in the index.

    ``totals`` is ``field → (n_docs, sum_dl)``, ``fields`` is ``field → weight``.
    """
    known = [f for f in fields if totals.get(f, (0, 0))[0] > 0]

    def per_field(value):
        column = F.lit(None).cast("double")
        for name in known:
            column = F.when(F.col("field") == name, F.lit(float(value(name)))).otherwise(column)
        return column

    n_docs = per_field(lambda f: totals[f][0])
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (terms.join(term_stats.where(F.col("field").isin(known)), "term")
            .select("query_id", "field", "term", "df",
                    (per_field(lambda f: fields[f]) * idf).alias("weight"),
                    per_field(lambda f: totals[f][1] / totals[f][0]).alias("avgdl")))


def _impact(tf: str = "tf", dl: str = "dl") -> Column:
    tf, dl = F.col(tf), F.col(dl)
    return (F.col("weight") * tf * (K1 + 1)
            / (tf + K1 * (1 - B + B * dl / F.col("avgdl"))))


def _best(scores: DataFrame, limit: int, limits: DataFrame | None) -> DataFrame:
    if limits is not None:
        return top_by_own_limit(scores, limits, "bm25_score", "bm25_rank")
    return top_per_group(scores, ["query_id"], [F.desc("bm25_score"), F.col("doc_id")], limit, "bm25_rank")


def bm25_topk(posted: DataFrame, weighted: DataFrame, limit: int, n_term_rows: int,
              broadcast_rows: int = BROADCAST_TERM_ROWS,
              rows_per_split: int = ROWS_PER_SPLIT, limits: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, bm25_score, bm25_rank)``: the best ``limit`` documents per query, or
    as many as the query's row in ``limits`` says (``(query_id, limit)``, none above ``limit``).

    Query terms within the row bound are broadcast. The postings then keep their
    bucketing by ``doc_id``, the sums need no shuffle, and each task hands on at most
    ``limit`` rows per query. A larger set of query terms is joined by shuffle, with the
    postings of frequent terms spread over several tasks.
    """
    if n_term_rows <= broadcast_rows:
        matched = posted.join(F.broadcast(weighted), ["field", "term"])
    else:
        counts = weighted.select("field", "term", "df").distinct()
        total = counts.agg(F.sum("df")).first()[0] or 0
        hot = hot_keys(counts, ["field", "term"], "df", total, rows_per_split)
        matched = salted_join(posted, weighted, ["field", "term"], "doc_id", hot)
    scores = matched.groupBy("query_id", "doc_id").agg(
        round_score(F.sum(_impact())).alias("bm25_score"))
    return _best(scores, limit, limits)


def split_terms(posted: DataFrame, weighted: DataFrame, limit: int) -> DataFrame:
    """Add ``essential``, ``threshold`` and ``rest`` to the query terms (Turtle & Flood
    1995).

    The ``limit``-th best score over the rarest terms alone is a threshold: the true one is
    no lower. A term adds at most ``weight * (k1 + 1)``. The most frequent terms whose
    bounds sum (``rest``) to less than the threshold are not essential: a document with no
    other term cannot be among the best.
    """
    rarest_first = Window.partitionBy("query_id").orderBy(
        F.desc("weight"), "field", "term").rowsBetween(Window.unboundedPreceding, -1)
    bounded = weighted.withColumns({
        "bound": F.col("weight") * (K1 + 1),
        "df_before": F.coalesce(F.sum("df").over(rarest_first), F.lit(0))})
    probe = bounded.where(F.col("df_before") < PROBE_POSTINGS * limit)
    first = posted.join(F.broadcast(probe), ["field", "term"]).groupBy(
        "query_id", "doc_id").agg(F.sum(_impact()).alias("part"))
    thresholds = (top_per_group(first, ["query_id"], [F.desc("part"), F.col("doc_id")], limit)
                  .groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"))
                  .select("query_id", F.when(F.col("n") >= limit, F.col("low")).otherwise(0.0)
                          .alias("threshold")))
    frequent_first = Window.partitionBy("query_id").orderBy(
        "weight", "field", "term").rowsBetween(Window.unboundedPreceding, 0)
    marked = bounded.join(thresholds, "query_id").withColumn(
        "essential", F.sum("bound").over(frequent_first) + MARGIN >= F.col("threshold"))
    return marked.withColumn("rest", F.sum(F.when(F.col("essential"), 0.0).otherwise(
        F.col("bound"))).over(Window.partitionBy("query_id"))).drop("bound", "df_before")


def bm25_topk_pruned(posted: DataFrame, weighted: DataFrame, limit: int,
                     limits: DataFrame | None = None) -> DataFrame:
    """The result of :func:`bm25_topk` without ranking every document that has any term.

    Documents are found by their essential terms; those that stay below the threshold even
    with the bounds of the other terms are dropped. Exact: what is left out cannot be among the best.

    Both sums are formed in one scan, which follows the bucketing of the postings by ``doc_id`` in any session: nothing
    but the best rows is shuffled, while a join of the two would move every posting of a frequent term. With ``limits`` the
    threshold is that of the largest one, which is low enough for all.
    """
    marked = split_terms(posted, weighted, limit).checkpoint()
    own, other = (F.sum(F.when(F.col("essential") == kind, _impact())) for kind in (True, False))
    found = (posted.join(F.broadcast(marked), ["field", "term"]).groupBy("query_id", "doc_id")
             .agg(own.alias("part"), other.alias("others"), F.max("threshold").alias("threshold"),
                  F.max("rest").alias("rest"))
             .where(F.col("part") + F.col("rest") + MARGIN >= F.col("threshold")))
    scores = found.select("query_id", "doc_id", round_score(
        F.col("part") + F.coalesce("others", F.lit(0.0))).alias("bm25_score"))
    return _best(scores, limit, limits)


def range_bounds(impacts: DataFrame, weighted: DataFrame) -> DataFrame:
    """``(query_id, doc_range, bound, n)``: no document of the range scores more than ``bound``; at
    least ``n`` of its documents, as they were indexed, have a term of the query."""
    return (impacts.join(weighted, ["field", "term"]).groupBy("query_id", "doc_range")
            .agg(F.sum(_impact("max_tf", "min_dl")).alias("bound"), F.max("n").alias("n")))


def _scores_within(posted: DataFrame, weighted: DataFrame, pairs: DataFrame, n_pairs: int, pair_rows: int,
                   one_of: Callable[[str, Sequence], Column] | None) -> DataFrame:
    """Scores of the documents in some ranges per query; the scan skips other ranges if those are few."""
    if one_of is not None:
        ranges = pairs.select("doc_range").distinct().limit(PUSHED_RANGES + 1).collect()
        if len(ranges) <= PUSHED_RANGES:
            numbers = sorted(r["doc_range"] for r in ranges)
            # One look-up for most rows; the lists are for the scan.
            posted = posted.where(F.col("doc_range").isin(numbers) & one_of("doc_range", numbers))
    pairs = pairs.select("query_id", "doc_range")
    if n_pairs <= pair_rows:
        pairs = F.broadcast(pairs)
    return (posted.join(weighted, ["field", "term"]).join(pairs, ["query_id", "doc_range"], "left_semi")
            .groupBy("query_id", "doc_id").agg(round_score(F.sum(_impact())).alias("bm25_score")))


def _best_by_ranges(posted: DataFrame, impacts: DataFrame, weighted: DataFrame, limit: int,
                    limits: DataFrame | None, pair_rows: int,
                    one_of: Callable[[str, Sequence], Column] | None) -> DataFrame:
    bounds = range_bounds(impacts, weighted).checkpoint()
    # A range in this table has a document with a term, so ``limit`` ranges are enough to begin with.
    first = top_per_group(bounds, ["query_id"], [F.desc("bound"), F.col("doc_range")], limit, "place", "doc_range")
    before = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    probe = (first.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .where(F.col("before") < PROBE_DOCS * limit).checkpoint())
    wanted = F.lit(limit)
    found = _best(_scores_within(posted, weighted, probe, probe.count(), pair_rows, one_of), limit, limits)
    lists = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"), F.min("bm25_score").alias("low"))
    if limits is not None:
        lists, wanted = lists.join(limits, "query_id"), F.col("limit")
    thresholds = lists.where(F.col("n_found") >= wanted).select("query_id", "low")
    # Queries with shorter lists keep all their ranges.
    kept = (bounds.join(thresholds, "query_id", "left")
            .where(F.col("low").isNull() | (F.col("bound") + MARGIN >= F.col("low")))
            .select("query_id", "doc_range").checkpoint())
    n_kept = kept.count()
    if n_kept <= pair_rows:
        return _best(_scores_within(posted, weighted, kept, n_kept, pair_rows, one_of), limit, limits)
    slices = -(-2 * n_kept // pair_rows)
    cuts = sorted(set(kept.agg(F.percentile_approx("doc_range", [i / slices for i in range(1, slices)])).first()[0]))
    best = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        within = F.lit(True) if low is None else F.col("doc_range") > low
        within = within if high is None else within & (F.col("doc_range") <= high)
        some = kept.where(within)
        scores = _scores_within(posted.where(within), weighted, some, some.count(), pair_rows, one_of)
        part = _best(scores, limit, limits).checkpoint()
        best = part if best is None else best.unionByName(part)
    return _best(best.drop("bm25_rank"), limit, limits)


def bm25_impact_ranges(posted: DataFrame, impacts: DataFrame, weighted: DataFrame, limit: int, n_ranges: int,
                       limits: DataFrame | None = None, term_rows: int = BROADCAST_TERM_ROWS,
                       pair_rows: int = RANGE_PAIRS,
                       one_of: Callable[[str, Sequence], Column] | None = None) -> DataFrame:
    """The result of :func:`bm25_topk`, with only those ranges of documents scored that can hold one
    of the best (block-max pruning, Ding & Suel 2011), for any number of query terms.

    ``impacts`` bounds the score of every range per query. The ranges of the highest bounds are
    scored first; the score of the last wanted document there is a threshold, and ranges whose bound stays below it
    are left out. Exact: no document of those can be among the best.

    Query terms and pairs of query and range (``n_ranges`` is the number of ranges) are broadcast, at most about
    ``term_rows`` and ``pair_rows`` at a time, so the postings keep their bucketing. Queries are taken in
    batches for their terms and first ranges. More pairs are scored in slices of neighbouring ranges: a bucket's ranges
    are neighbours, so a slice reads its own buckets only, and however many ranges there are, a batch reads the postings
    about twice. What is beyond that, for a single query or range, is joined by shuffle. ``one_of``
    turns a column and few values into a condition that the scan can use.
    """
    cost = weighted.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("query_id").alias("queries"),
                        F.sum(F.least("df", F.lit(n_ranges))).alias("pairs"),
                        F.collect_set("field").alias("fields")).first()
    # Files hold one field each, or mostly one: the others are skipped.
    posted, impacts = (df.where(F.col("field").isin(cost["fields"])) for df in (posted, impacts))
    per_query = min(limit, n_ranges)
    pairs = min(cost["pairs"] or 0, cost["queries"] * n_ranges)
    if (2 * cost["terms"] <= term_rows and 2 * cost["queries"] * per_query <= pair_rows
            and 2 * pairs <= RANGE_SLICES * pair_rows):
        return _best_by_ranges(posted, impacts, F.broadcast(weighted), limit, limits, pair_rows, one_of)
    # Every batch reads the tables anew, so each takes as many parts of the queries as the bounds allow.
    parts = BATCH_PARTS * max(1, -(-cost["terms"] // term_rows), -(-cost["queries"] * per_query // pair_rows),
                              -(-pairs // (RANGE_SLICES * pair_rows)))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    sizes = {r["part"]: (r["terms"], r["queries"] * per_query, -(-min(r["pairs"], r["queries"] * n_ranges) // RANGE_SLICES))
             for r in weighted.groupBy(part.alias("part")).agg(
                 F.count(F.lit(1)).alias("terms"), F.count_distinct("query_id").alias("queries"),
                 F.sum(F.least("df", F.lit(n_ranges))).alias("pairs")).collect()}
    best = None
    for numbers in _batches(sizes, (term_rows, pair_rows, pair_rows)):
        some = weighted.where(part.isin(numbers))
        some = F.broadcast(some) if sum(sizes[n][0] for n in numbers) <= term_rows else some
        found = _best_by_ranges(posted, impacts, some, limit, limits, pair_rows, one_of).checkpoint()
        best = found if best is None else best.unionByName(found)
    return best


def _batches(sizes: Mapping[int, tuple[int, ...]], bounds: Sequence[int]) -> list[list[int]]:
    """Parts put together as long as none of their summed sizes exceeds its bound; largest parts first, each
    into the first batch with room. A part beyond a bound is a batch of its own."""
    batches: list[tuple[list[int], list[int]]] = []
    for number, size in sorted(sizes.items(), key=lambda part: (-part[1][0], part[0])):
        for numbers, sums in batches:
            if all(a + b <= bound for a, b, bound in zip(sums, size, bounds)):
                numbers.append(number)
                sums[:] = [a + b for a, b in zip(sums, size)]
                break
        else:
            batches.append(([number], list(size)))
    return [numbers for numbers, _ in batches]
