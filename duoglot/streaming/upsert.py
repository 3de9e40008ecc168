"""Keeping an index up to date from a stream of raw paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from duoglot.config import CorpusConfig
from duoglot.operators.corpus import build_corpus
from duoglot.operators.encode import Encoder
from duoglot.plans.index import upsert_index
from duoglot.sources.index_tables import open_index


def stream_csv(spark: SparkSession, folder: str, schema: StructType,
               files_per_batch: int = 100) -> DataFrame:
    """New CSV files of a folder as a stream of raw paragraphs."""
    return (spark.readStream.schema(schema).option("header", True).option("quote", '"')
            .option("escape", '"').option("multiLine", True)
            .option("maxFilesPerTrigger", files_per_batch).csv(folder))


def stream_upsert(raw: DataFrame, index_path: str, checkpoint: str,
                  config: CorpusConfig | None = None, encoder: Encoder | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Upsert every micro-batch of raw paragraphs into the index.

    A micro-batch is named after the stream's checkpoint and its number; if it is run again
    after a failure, the index finds the name in its manifest and leaves it out.
    """
    def write(batch: DataFrame, number: int) -> None:
        index = open_index(batch.sparkSession, index_path)
        upsert_index(index, build_corpus(batch, config), encoder=encoder,
                     batch=f"{checkpoint}#{number}")

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
