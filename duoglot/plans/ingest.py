"""CSV files → corpus on storage, with a one-row summary of the run."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from duoglot.config import CorpusConfig
from duoglot.operators.corpus import build_corpus, used_text_columns
from duoglot.sources.corpus import read_corpus_csv, write_corpus

SUMMARY_SCHEMA = ("rows bigint, parquet string, used_text_columns array<string>, "
                  "id_fields array<string>")


def ingest_table(spark: SparkSession, raw: DataFrame, out: str,
                 config: CorpusConfig | None = None,
                 order_by: Sequence[str] | None = None) -> DataFrame:
    """Write the corpus of ``raw`` to ``out``; rows are counted while they are written."""
    config = config or CorpusConfig()
    seen = Observation()
    corpus = build_corpus(raw, config, order_by)
    write_corpus(corpus.observe(seen, F.count(F.lit(1)).alias("rows")), out)
    return spark.createDataFrame(
        [(seen.get["rows"], out, used_text_columns(raw, config), list(config.id_fields))],
        SUMMARY_SCHEMA)


def ingest_csv(spark: SparkSession, csv: str | Sequence[str], out: str,
               config: CorpusConfig | None = None, multi_line: bool = True,
               na_values: Iterable[str] = ("",),
               order_by: Sequence[str] | None = None) -> DataFrame:
    raw = read_corpus_csv(spark, csv, multi_line=multi_line, na_values=na_values)
    return ingest_table(spark, raw, out, config, order_by)
