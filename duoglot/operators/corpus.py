"""Raw table → corpus: resolve columns, normalise, key, deduplicate, concatenate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from duoglot.config import CorpusConfig
from duoglot.functions import text
from duoglot.operators.topk import best_row_per_key
from duoglot.session import work_folder

FOLDED_SUFFIX = "_ascii"
# Digests of repeated keys are broadcast up to this many (8 bytes each).
BROADCAST_DIGESTS = 1_000_000


def drop_folded_columns(df: DataFrame) -> DataFrame:
    """Remove incoming ``*_ascii`` columns; they are derived data."""
    return df.drop(*[c for c in df.columns if c.endswith(FOLDED_SUFFIX)])


def deduplicate(df: DataFrame, keys: Sequence[str],
                order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per key over the whole table, nulls comparing equal.

    The rows of one group differ only in the remaining columns; ordering by those makes
    the choice independent of how the input is split. Pass a line number in ``order_by``
    to keep the first row of a file.

    Keys hold whole texts. So digests are counted first, 8 bytes a row through the exchange; only
    rows whose digest occurs more than once are brought together and compared in full (two keys
    of one digest just meet there for nothing). The other rows never leave their task.
    The table is read again for that, so it must not change in between.
    """
    order = list(order_by or [c for c in df.columns if c not in keys]) or list(keys)
    work_folder(df.sparkSession)
    digest = F.xxhash64(*keys)
    repeated = (df.select(digest.alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1).select("_digest").checkpoint())
    n_repeated = repeated.limit(BROADCAST_DIGESTS + 1).count()
    if not n_repeated:
        return df
    if n_repeated <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    rows = df.withColumn("_digest", digest)
    several = rows.join(repeated, "_digest", "left_semi").drop("_digest")
    single = rows.join(repeated, "_digest", "left_anti").drop("_digest")
    return single.unionByName(best_row_per_key(several, keys, [F.col(c).asc_nulls_last() for c in order]))


def build_corpus(raw: DataFrame, config: CorpusConfig | None = None,
                 order_by: Sequence[str] | None = None) -> DataFrame:
    """The normalised corpus: ids and pass-through columns of ``raw``, cleaned texts,
    ``doc_id``, ``multilingual_concat`` and, where known, ``pali_paragraph`` and
    ``translation_paragraph``.

    With no known text column every string column except the ids is concatenated; the
    freshly built ``doc_id`` counts as one of them.
    """
    config = config or CorpusConfig()
    config.check_ids(raw.columns)
    resolved = config.resolve(raw.columns)
    texts = list(dict.fromkeys(resolved.values()))

    df = drop_folded_columns(
        raw.withColumns({c: text.normalize_nfc(c) for c in texts}) if texts else raw)
    df = df.withColumn("doc_id", text.doc_key(config.id_fields, config.on_null_id))
    df = deduplicate(df, ["doc_id", *texts], order_by)

    parts = [resolved[lang] for lang in config.concat_order if lang in resolved]
    if not parts:
        parts = [c for c, kind in df.dtypes
                 if kind == "string" and c not in config.id_fields]
    columns = {"multilingual_concat": text.concat_all(parts)}
    for lang, name in (("pali", "pali_paragraph"), ("en", "translation_paragraph")):
        if lang in resolved and resolved[lang] != name:
            columns[name] = F.col(resolved[lang])
    df = df.withColumns(columns)
    if config.ascii_columns:
        df = add_folded_columns(df, [*dict.fromkeys(
            [*texts, *[c for c in columns if c != "multilingual_concat"]])])
    return df


def add_folded_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A diacritic-free companion ``<column>_ascii`` for each column."""
    return df.withColumns({f"{c}{FOLDED_SUFFIX}": text.strip_diacritics(c) for c in columns})


def used_text_columns(raw: DataFrame, config: CorpusConfig) -> list[str]:
    return sorted(set(config.resolve(raw.columns).values()))
