"""Reading raw corpora and writing / reading the normalised corpus."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Cell texts that common data tools treat as "missing" by default.
COMMON_NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_corpus_csv(spark: SparkSession, path: str | Sequence[str],
                    multi_line: bool = True,
                    na_values: Iterable[str] = ("",)) -> DataFrame:
    """CSV with a header row, every column a string, doubled quotes inside quoted cells.

    A quoted cell may contain line breaks. Spark must then read each file in one task; for
    large files known to have no such cells, ``multi_line=False`` reads them in splits.
    Several paths are read as one table.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", multi_line).option("encoding", "UTF-8").csv(paths))
    if multi_line:
        # One task per file ends here: cleaning and keys run on all cores.
        raw = raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return missing_to_null(raw, na_values)


def missing_to_null(df: DataFrame, na_values: Iterable[str]) -> DataFrame:
    """Replace cells that spell a missing value by null."""
    marks = list(na_values)
    if not marks:
        return df
    return df.select([
        F.when(~F.col(f"`{c}`").isin(marks), F.col(f"`{c}`")).alias(c)
        if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes])


def union_corpora(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack tables whose columns need not agree; absent columns become null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
