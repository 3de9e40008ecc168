"""Text columns: normalising, folding, keys, concatenation, tokens.

Every function takes and returns a ``Column``. Unicode normalisation is the only step
Spark has no expression for; it runs in Arrow batches, and only texts that it can change are
sent there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# All characters that Unicode counts as white space (29 of them).
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Language tests, tried in this order; English when none matches.
CHINESE = "[一-鿿]"
RUSSIAN = "[Ѐ-ӿ]"
PALI_LETTERS = "āīūḍḷṇṭñĀĪŪḌḶṆṬÑ"
DEFAULT_LANGUAGE = "en"

# Separators and texts for missing parts.
TEXT_SEPARATOR = " \n "
KEY_SEPARATOR = ":"
MISSING_ID = "nan"
UNKNOWN_PART = "?"

TOKEN = r"[\p{L}\p{N}\p{M}]+"

# RFC 4122 name space for DNS names.
_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


class _Folds(dict):
    """Character → its compatibility decomposition without combining marks. Filled as
    characters turn up; folding is the same character by character as for whole texts."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code))
        self[code] = "".join(c for c in parts if not unicodedata.combining(c))
        return self[code]


_FOLDS = _Folds()


# Ranges of characters that NFC never changes, whatever stands next to them: they are their own
# normal form, have no combining class and are never the second part of a composition. Latin,
# Cyrillic, more Latin, dashes and quotes, kana, Chinese, Korean syllables. Few, as a class is tested
# range by range for every character.
NFC_STABLE = ("\\x{0}-\\x{2ff}", "\\x{400}-\\x{482}", "\\x{1e00}-\\x{1eff}", "\\x{2010}-\\x{2027}",
              "\\x{3041}-\\x{3096}", "\\x{30a1}-\\x{30fa}", "\\x{4e00}-\\x{9fff}", "\\x{ac00}-\\x{d7a3}")
NFC_UNSURE = "[^" + "".join(NFC_STABLE) + "]"
# All that can be unsure. A class of one range is tested several times faster, and most texts go no further.
NFC_BEYOND = f"[^{NFC_STABLE[0]}]"


@F.pandas_udf(T.StringType())
def _nfc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t.translate(_FOLDS), na_action="ignore")


def _where(needed: Column, c: Column, batch) -> Column:
    """Apply ``batch`` to the texts that need it; the others go past it as nulls. The test is made
    once: what comes back null did not need it."""
    return F.coalesce(batch(F.when(needed, c)), c)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of Unicode white space at both ends."""
    return F.btrim(as_column(c), F.lit(WHITESPACE))


def normalize_nfc(c: Column | str) -> Column:
    """NFC form, trimmed; null stays null. Texts whose characters NFC never changes, which is nearly all
    text that is stored in NFC, stay in the JVM."""
    c = as_column(c)
    unsure = (F.octet_length(c) > F.length(c)) & c.rlike(NFC_BEYOND) & c.rlike(NFC_UNSURE)
    return strip(_where(unsure, c, _nfc_batch))


def strip_diacritics(c: Column | str) -> Column:
    """Compatibility decomposition without its combining marks (``ā`` → ``a``)."""
    c = as_column(c)
    return _where(F.octet_length(c) > F.length(c), c, _fold_batch)


def contains_any(c: Column, letters: str) -> Column:
    """Whether any of the letters occurs. Byte searches; a regular expression that lists
    single letters tests them one by one for every character."""
    return reduce(or_, [c.contains(letter) for letter in letters])


def detect_lang(c: Column | str) -> Column:
    """Language guess from the alphabet: zh, ru, pali, else en."""
    c = as_column(c)
    return (F.when(c.rlike(CHINESE), "zh").when(c.rlike(RUSSIAN), "ru")
            .when(contains_any(c, PALI_LETTERS), "pali").otherwise(DEFAULT_LANGUAGE))


def keyword_query(query: Column | str, lang: Column | str) -> Column:
    """The text for the keyword leg: folded for Pali, as typed otherwise."""
    query, lang = as_column(query), as_column(lang)
    return F.when(lang == "pali", strip_diacritics(query)).otherwise(query)


def doc_key(id_columns: Sequence[str], on_null_id: str = "nan") -> Column:
    """Stable key: the id columns joined with ``:``."""
    parts = []
    for name in id_columns:
        missing = (F.lit(MISSING_ID) if on_null_id == "nan"
                   else F.raise_error(F.lit(f"missing id in column {name}")))
        parts.append(F.coalesce(F.col(name).cast("string"), missing))
    return F.concat_ws(KEY_SEPARATOR, *parts)


def concat_all(columns: Sequence[Column | str]) -> Column:
    """Join in the given order; a missing text counts as an empty one and is kept."""
    return F.concat_ws(TEXT_SEPARATOR,
                       *[F.coalesce(as_column(c), F.lit("")) for c in columns])


def concat_nonempty(columns: Sequence[Column | str]) -> Column:
    """Join in the given order, leaving out missing and empty texts."""
    return F.concat_ws(TEXT_SEPARATOR,
                       *[F.nullif(as_column(c), F.lit("")) for c in columns])


def snippet(pali: Column | str, translation: Column | str) -> Column:
    """Text shown for a hit: Pali, then translation, whichever exist."""
    return concat_nonempty([pali, translation])


def uuid5_dns(name: Column | str) -> Column:
    """Name-based UUID (version 5) in the DNS name space, computed in the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_DNS_NAMESPACE)), F.encode(as_column(name), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12))


def citation_tag(book_id: Column | str = "book_id", para_id: Column | str = "para_id") -> Column:
    """``[book:para]`` with ``?`` for a missing part."""
    book, para = (F.coalesce(as_column(c).cast("string"), F.lit(UNKNOWN_PART))
                  for c in (book_id, para_id))
    return F.concat(F.lit("["), book, F.lit(KEY_SEPARATOR), para, F.lit("]"))


def has_token(c: Column | str) -> Column:
    """Whether a text has any token; stops at the first one."""
    return F.coalesce(as_column(c).rlike(TOKEN), F.lit(False))


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and marks; null gives an empty array."""
    words = F.regexp_extract_all(F.lower(as_column(c)), F.lit(TOKEN), F.lit(0))
    return F.coalesce(words, F.array().cast("array<string>"))
