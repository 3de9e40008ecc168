"""The index on storage: append-only tables with a generation column.

* ``docs`` – one row per paragraph (payload and UUID key)
* ``vectors`` – ``(doc_id, vector_name, embedding)``
* ``postings`` – ``(doc_id, field, term, tf, dl, doc_range)``
* ``term_stats`` / ``field_stats`` – counts, as differences per generation
* ``impacts`` – ``(field, term, doc_range, max_tf, min_dl, n)``, bounds of a term's scores per document range
* ``codes`` – ``(bucket, doc_id)``, the inverted table of an approximate search, if there are codes
* ``replaced`` – ``(doc_id, gen)`` rows that a later generation has replaced
* ``manifest`` – one row per finished generation

``docs``, ``vectors`` and ``postings`` are Parquet tables bucketed by ``doc_id``: building postings and vectors
from ``docs``, summing scores per document and finding replaced rows need no shuffle of
them. A generation counts once its manifest row is written; whatever a failed attempt left
behind belongs to a generation nobody reads.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from duoglot.operators.codes import Codes, code_rows

DOCS_SCHEMA = T.StructType([
    T.StructField(name, T.StringType()) for name in (
        "uuid", "doc_id", "book_id", "para_id", "pali_paragraph", "pali_paragraph_ascii",
        "translation_paragraph", "translation_paragraph_ascii", "chinese_paragraph",
        "chinese_paragraph_ascii", "russian_paragraph", "russian_paragraph_ascii",
        "multilingual_concat")])
VECTORS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("vector_name", T.StringType())])
POSTINGS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType()),
    T.StructField("doc_range", T.LongType()), T.StructField("field", T.StringType())])
MANIFEST_SCHEMA = "seq int, gen string, batch string, n_rows bigint, n_replaced bigint, settings string"

# Schema, partition columns, columns that a bucket is sorted by.
BUCKETED = {"docs": (DOCS_SCHEMA, ["gen"], ["doc_id"]),
            "vectors": (VECTORS_SCHEMA, ["gen", "vector_name"], ["doc_id"]),
            "postings": (POSTINGS_SCHEMA, ["gen", "field"], [])}
SMALL = {"replaced": "doc_id string, dead_gen string",
         "term_stats": "field string, term string, df bigint",
         "field_stats": "field string, n_docs bigint, sum_dl bigint",
         "impacts": "field string, term string, doc_range bigint, max_tf bigint, min_dl int, n bigint"}
CODES = "doc_id string, bucket int, gen string, vector_name string"
# Texts take little more than half of what they take with the default, at a few CPU seconds a GB.
COMPRESSION = "zstd"
# A task writes one bucket, and a file per field of it at the same time: with up to so many open files Spark
# leaves out its sort by partition and bucket, and rows stay in their order.
OPEN_FILES = 8
CONCURRENT_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Replaced rows are broadcast up to this many (about 60 bytes each).
BROADCAST_REPLACED = 1_000_000
# Up to this many documents are fetched by a list of ids (about 100 bytes each in the plan).
FETCH_IDS = 1_000
# Parquet gets lists of up to ten values as single values, which skip pages, longer ones as one range.
IDS_PER_LIST = 10
# Neighbouring documents of a bucket that share a bound per term.
RANGE_DOCS = 1024
# Numbers of ranges that a generation can use.
RANGES_PER_GENERATION = 1 << 44


@dataclass(frozen=True)
class IndexSettings:
    """Fixed when the index is created. With ``codes`` an inverted table of the vectors is kept, with
    ``range_docs`` (0 for none) the bounds of every term per that many documents."""

    fields: tuple[str, ...] = ("multilingual_concat",)
    buckets: int = 8
    vector_columns: dict[str, str] = field(default_factory=dict)
    codes: Codes | None = None
    range_docs: int = RANGE_DOCS


def one_of(column: str, values: Sequence[str]) -> Column:
    """``column IN values`` as a balanced disjunction of short lists: buckets, row groups and pages
    without any of the values are skipped, however many values there are."""
    lists = [F.col(column).isin(list(values[at:at + IDS_PER_LIST]))
             for at in range(0, len(values), IDS_PER_LIST)]
    while len(lists) > 1:
        lists = [a | b for a, b in zip(lists[::2], lists[1::2])] + lists[len(lists) // 2 * 2:]
    return lists[0] if lists else F.lit(False)


@dataclass
class Index:
    """A readable state of an index: its path, settings and finished generations."""

    spark: SparkSession
    path: str
    settings: IndexSettings
    generations: list[tuple[int, str, str, int, int]]

    @property
    def n_replaced(self) -> int:
        return sum(g[4] for g in self.generations)

    @property
    def _finished(self) -> list[str]:
        return [g[1] for g in self.generations if g[3]]

    def _table(self, kind: str) -> DataFrame:
        table = self.spark.table(table_name(self.path, kind))
        return table.where(F.col("gen").isin(self._finished))

    def _small(self, kind: str) -> DataFrame:
        df = self.spark.read.schema(SMALL[kind] + ", gen string").parquet(f"{self.path}/{kind}")
        return df.where(F.col("gen").isin(self._finished))

    def replaced(self) -> DataFrame:
        """Replaced rows as ``(doc_id, gen)``: ``gen`` is the generation they are dead in."""
        return self._small("replaced").select("doc_id", F.col("dead_gen").alias("gen"))

    def _live(self, df: DataFrame) -> DataFrame:
        if not self.n_replaced:
            return df
        dead = self.replaced()
        if self.n_replaced <= BROADCAST_REPLACED:
            dead = F.broadcast(dead)
        return df.join(dead, ["doc_id", "gen"], "left_anti")

    def docs(self) -> DataFrame:
        return self._live(self._table("docs")).drop("gen")

    def docs_of(self, ids: Sequence[str]) -> DataFrame:
        """The current rows of some documents, at most ``FETCH_IDS``."""
        if len(ids) > FETCH_IDS:
            raise ValueError(f"more than {FETCH_IDS} ids")
        return self._live(self._table("docs").where(one_of("doc_id", sorted(ids)))).drop("gen")

    def replaced_docs(self, dead: DataFrame, n_dead: int) -> DataFrame:
        """The old rows of ``(doc_id, gen)``: fetched by id if they are few, otherwise bucket by bucket."""
        rows = self._table("docs")
        if n_dead <= FETCH_IDS:
            rows = rows.where(one_of("doc_id", sorted(r["doc_id"] for r in dead.select("doc_id").collect())))
        if n_dead <= BROADCAST_REPLACED:
            dead = F.broadcast(dead)
        return rows.join(dead, ["doc_id", "gen"], "left_semi").drop("gen")

    def doc_generations(self) -> DataFrame:
        """``(doc_id, gen)`` of the current rows."""
        return self._live(self._table("docs").select("doc_id", "gen"))

    def vectors(self, name: str = "multilingual") -> DataFrame:
        rows = self._table("vectors").where(F.col("vector_name") == name)
        return self._live(rows).select("doc_id", "embedding")

    def vectors_of(self, ids: Sequence[str], name: str = "multilingual") -> DataFrame:
        """The current vectors of some documents, at most ``FETCH_IDS``."""
        if len(ids) > FETCH_IDS:
            raise ValueError(f"more than {FETCH_IDS} ids")
        rows = self._table("vectors").where((F.col("vector_name") == name) & one_of("doc_id", sorted(ids)))
        return self._live(rows).select("doc_id", "embedding")

    def codes(self, name: str = "multilingual", buckets: Sequence[int] | None = None) -> DataFrame:
        """``(bucket, doc_id)`` of the current rows, of some buckets only if given."""
        if self.settings.codes is None:
            raise ValueError("the index has no codes")
        rows = self.spark.read.schema(CODES).parquet(f"{self.path}/codes").where(
            F.col("gen").isin(self._finished) & (F.col("vector_name") == name))
        if buckets is not None:
            rows = rows.where(one_of("bucket", sorted(buckets)))
        return self._live(rows).select("bucket", "doc_id")

    def postings(self) -> DataFrame:
        return self._live(self._table("postings")).drop("gen")

    def ranged(self, docs: DataFrame, seq: int) -> DataFrame:
        """``docs`` of one generation with ``doc_range``. A task reads a bucket in the order of ids, so
        a range holds neighbours; it never crosses a bucket or a generation."""
        if not self.settings.range_docs:
            return docs.withColumn("doc_range", F.lit(None).cast("bigint"))
        number = F.expr(f"monotonically_increasing_id() DIV {self.settings.range_docs}")
        return docs.withColumn("doc_range", F.lit(seq * RANGES_PER_GENERATION) + number)

    @property
    def n_ranges(self) -> int:
        """No more ranges than this, as every bucket of a generation may end with a short one."""
        rows = sum(g[3] for g in self.generations)
        return rows // max(1, self.settings.range_docs) + self.settings.buckets * len(self._finished)

    def impacts(self) -> DataFrame:
        """Bounds per field, term and range; those of replaced rows stay in until compaction."""
        if not self.settings.range_docs:
            raise ValueError("the index has no document ranges")
        return self._small("impacts").drop("gen")

    def term_stats(self, terms: DataFrame | None = None) -> DataFrame:
        """``(field, term, df)``, for ``terms`` only if given."""
        stats = self._small("term_stats")
        if terms is not None:
            stats = stats.join(terms, "term", "left_semi")
        if len(self._finished) > 1:
            stats = (stats.groupBy("field", "term").agg(F.sum("df").alias("df"))
                     .where(F.col("df") > 0))
        return stats.select("field", "term", "df")

    def field_totals(self) -> dict[str, tuple[int, int]]:
        """``field → (documents with a token, tokens)``; one row per field."""
        rows = self._small("field_stats").groupBy("field").agg(
            F.sum("n_docs").alias("n"), F.sum("sum_dl").alias("s")).collect()
        return {r["field"]: (r["n"], r["s"]) for r in rows}

    def next_generation(self) -> tuple[int, str]:
        seq = max([g[0] for g in self.generations], default=0) + 1
        return seq, f"{seq:06d}-{uuid.uuid4().hex[:8]}"

    def of_generation(self, kind: str, gen: str) -> DataFrame:
        """Rows one generation wrote, before or after it is finished."""
        if kind in BUCKETED:
            return self.spark.table(table_name(self.path, kind)).where(F.col("gen") == gen)
        return (self.spark.read.schema(SMALL[kind] + ", gen string")
                .parquet(f"{self.path}/{kind}").where(F.col("gen") == gen))

    def write_bucketed(self, kind: str, rows: DataFrame, gen: str) -> None:
        schema, partitions, order = BUCKETED[kind]
        name = table_name(self.path, kind)
        columns = [f.name for f in schema if f.name not in partitions]
        writer = (rows.withColumn("gen", F.lit(gen)).select(*columns, *partitions)
                  .write.format("parquet").mode("append").partitionBy(*partitions)
                  .bucketBy(self.settings.buckets, "doc_id"))
        if order:
            # Few rows are fetched by id: only the pages with them are read.
            writer = writer.sortBy(*order).option("parquet.bloom.filter.enabled#doc_id", "true")
        writer.option("path", f"{self.path}/{kind}").saveAsTable(name)

    def write_codes(self, gen: str) -> None:
        """The inverted table of the generation's vectors. Rows are in the order of buckets over all files, so
        a search reads the pages of its buckets; a bucket of any size is spread over files by ``doc_id``."""
        if self.settings.codes is None:
            return
        order = ["vector_name", "bucket", "doc_id"]
        rows = code_rows(self.of_generation("vectors", gen), self.settings.codes)
        (rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gen", F.lit(gen))
         .write.mode("append").partitionBy("gen", "vector_name").option("compression", COMPRESSION)
         .parquet(f"{self.path}/codes"))

    def write_small(self, kind: str, rows: DataFrame, gen: str) -> None:
        (rows.withColumn("gen", F.lit(gen)).write.mode("append").partitionBy("gen").option("compression", COMPRESSION)
         .parquet(f"{self.path}/{kind}"))

    def finish(self, seq: int, gen: str, batch: str | None, n_rows: int,
               n_replaced: int) -> "Index":
        row = (seq, gen, batch, n_rows, n_replaced, json.dumps({
            "fields": list(self.settings.fields), "buckets": self.settings.buckets,
            "vector_columns": self.settings.vector_columns,
            "codes": self.settings.codes and [self.settings.codes.tables, self.settings.codes.bits],
            "range_docs": self.settings.range_docs}))
        (self.spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1)
         .write.mode("append").json(f"{self.path}/manifest"))
        return open_index(self.spark, self.path)


def table_name(path: str, kind: str) -> str:
    digest = hashlib.md5(path.encode()).hexdigest()[:16]
    return f"duoglot_{kind}_{digest}"


def _quoted(path: str) -> str:
    """A path inside a SQL string."""
    return path.replace("\\", "\\\\").replace("'", "\\'")


def _declare_tables(spark: SparkSession, path: str, settings: IndexSettings) -> None:
    """Make the bucketed tables at ``path`` known to this session's catalog."""
    for kind, (schema, partitions, order) in BUCKETED.items():
        name = table_name(path, kind)
        if not spark.catalog.tableExists(name):
            columns = [f"`{f.name}` {f.dataType.simpleString()}"
                       for f in schema if f.name not in partitions]
            columns += [f"`{p}` string" for p in partitions]
            spark.sql(f"CREATE TABLE {name} ({', '.join(columns)}) USING parquet "
                      f"PARTITIONED BY ({', '.join(partitions)}) "
                      f"CLUSTERED BY (doc_id) {f'SORTED BY ({order[0]}) ' if order else ''}"
                      f"INTO {settings.buckets} BUCKETS OPTIONS (compression '{COMPRESSION}') LOCATION '{_quoted(path)}/{kind}'")


def _find_partitions(spark: SparkSession, path: str) -> None:
    """Let the catalog see generations that other sessions wrote."""
    for kind in BUCKETED:
        spark.catalog.recoverPartitions(table_name(path, kind))


def open_index(spark: SparkSession, path: str) -> Index:
    """The current state of the index at ``path``."""
    path = path.rstrip("/")
    rows = sorted(spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest").collect(),
                  key=lambda r: r["seq"])
    raw = json.loads(rows[-1]["settings"])
    codes = Codes(*raw["codes"]) if raw.get("codes") else None
    settings = IndexSettings(tuple(raw["fields"]), raw["buckets"], raw["vector_columns"], codes,
                             raw.get("range_docs", 0))
    _declare_tables(spark, path, settings)
    _find_partitions(spark, path)
    return Index(spark, path, settings, [
        (r["seq"], r["gen"], r["batch"], r["n_rows"], r["n_replaced"]) for r in rows])


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def open_or_declare(spark: SparkSession, path: str, settings: IndexSettings | None = None) -> Index:
    """The index at ``path``, or one without any generation yet if there is none."""
    path = path.rstrip("/")
    if path_exists(spark, f"{path}/manifest"):
        return open_index(spark, path)
    settings = settings or IndexSettings()
    _declare_tables(spark, path, settings)
    return Index(spark, path, settings, [])


def ensure_index(spark: SparkSession, path: str, settings: IndexSettings | None = None) -> Index:
    """Open the index at ``path``, or create an empty one if there is none."""
    index = open_or_declare(spark, path, settings)
    if index.generations:
        return index
    seq, gen = index.next_generation()
    for kind, (schema, *_) in BUCKETED.items():
        index.write_bucketed(kind, spark.createDataFrame([], schema), gen)
    for kind, ddl in SMALL.items():
        index.write_small(kind, spark.createDataFrame([], ddl), gen)
    index.write_codes(gen)
    return index.finish(seq, gen, None, 0, 0)
