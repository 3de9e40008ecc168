"""Helpers that several operators share: words, batches of bounded size, stored tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duoglot.session import work_folder

CHUNK_BYTES = 1 << 20
IDLE_SECONDS = 15
PART_BYTES = 4 << 20
LEAST_PARTS = 16

# Words are maximal runs of anything but these six characters, as in [^\x20\x09-\x0D]+.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def chunks(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0)
        start = total = 0
        for at, n in enumerate(sizes.to_pylist()):
            if at > start and total + n > limit:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += n
        yield batch.slice(start)


class Idle:
    """Calls ``release`` once nothing has been ``in_use`` for ``IDLE_SECONDS``. Spark keeps Python workers
    after their stage, beside the memory of the JVM; what they hold for their next task must not stay."""

    def __init__(self, release: Callable[[], None]):
        self.release, self.timer = release, None

    @contextmanager
    def in_use(self) -> Iterator[None]:
        if self.timer:
            self.timer.cancel()
        try:
            yield
        finally:
            self.timer = threading.Timer(IDLE_SECONDS, self.release)
            self.timer.daemon = True
            self.timer.start()


def gathered(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows in no more partitions than one per ``PART_BYTES`` of text: many small files of an input
    do not become as many files of every table made from it."""
    size = df.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    return df.coalesce(max(LEAST_PARTS, -(-size // PART_BYTES)))


def no_finer(df: DataFrame, documents: DataFrame) -> DataFrame:
    """The same rows in no more partitions than the ``documents`` that they come from have."""
    return df.coalesce(max(LEAST_PARTS, documents.rdd.getNumPartitions()))


def stored(df: DataFrame, name: str, rows: int | None = None, file_rows: int = 50_000) -> DataFrame:
    """Write a table to the shared work folder and read it back: lost executors then cost
    a read and no recomputation, and the rows are the same for every reader.

    With ``rows``, a bound on the number of rows, there is no more than a file per ``file_rows`` of them.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // file_rows)))
    path = f"{work_folder(spark)}/duoglot-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart where ids repeat or are null: rows with equal id and text get
    the same results anyway."""
    return F.xxhash64(F.col(id_col), F.col(text_col))
