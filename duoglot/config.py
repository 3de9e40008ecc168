"""How a raw table maps onto the corpus: id columns, language aliases, options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# Accepted column names per language, the first one present is used.
DEFAULT_ALIASES: dict[str, tuple[str, ...]] = {
    "pali": ("pali_paragraph", "pali_text"),
    "en": ("translation_paragraph", "english_paragraph", "en_paragraph"),
    "zh": ("chinese_paragraph", "zh_paragraph"),
    "ru": ("russian_paragraph", "ru_paragraph"),
}
DEFAULT_ID_FIELDS = ("book_id", "para_id")
DEFAULT_CONCAT_ORDER = ("pali", "en", "zh", "ru")


@dataclass(frozen=True)
class CorpusConfig:
    """Column mapping and options of one ingest run.

    ``ascii_columns`` adds a diacritic-free ``<column>_ascii`` next to every text
    column, so that folded keyword queries can meet folded text.
    ``on_null_id`` is ``"nan"`` (a missing id becomes that text in the key) or ``"error"``.
    """

    id_fields: Sequence[str] = DEFAULT_ID_FIELDS
    text_aliases: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: dict(DEFAULT_ALIASES))
    concat_order: Sequence[str] = DEFAULT_CONCAT_ORDER
    ascii_columns: bool = False
    on_null_id: str = "nan"

    def __post_init__(self) -> None:
        ids = self.id_fields
        if isinstance(ids, str) or not ids or not all(isinstance(c, str) for c in ids):
            raise ValueError("id_fields must be a list of column names")
        if self.on_null_id not in ("nan", "error"):
            raise ValueError("on_null_id must be 'nan' or 'error'")

    def check_ids(self, columns: Sequence[str]) -> None:
        """Fail before any job runs when an id column is absent."""
        for name in self.id_fields:
            if name not in columns:
                raise ValueError(f"required id column is missing: {name}")

    def resolve(self, columns: Sequence[str]) -> dict[str, str]:
        """Language → the first of its accepted columns that the table has."""
        present = set(columns)
        found = {}
        for language, names in self.text_aliases.items():
            match = [name for name in names if name in present]
            if match:
                found[language] = match[0]
        return found
