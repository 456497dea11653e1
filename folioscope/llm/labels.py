"""Language labels in their usual spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual spellings of the languages that occur.
LANGUAGES = {
    "en": ["en", "eng", "english", "inglés", "ingles", "anglais", "englisch", "inglese", "inglês"],
    "es": ["es", "spa", "esp", "spanish", "castilian", "español", "espanol", "castellano", "espagnol", "spanisch", "spagnolo", "espanhol"],
    "de": ["de", "deu", "ger", "german", "deutsch", "alemán", "aleman", "allemand", "tedesco", "alemão"],
    "it": ["it", "ita", "italian", "italiano", "italien", "italienisch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "francés", "frances", "französisch", "francese", "francês"],
    "pt": ["pt", "por", "portuguese", "português", "portugues", "portugués", "portugais", "portugiesisch", "portoghese"],
}


def language_code(label: Column) -> Column:
    """``en``, ``es``, ``de``, ``it``, ``fr`` or ``pt`` where the label names
    it by code, name or code with a region (``es-MX``, ``en_GB``), else null."""
    head = F.regexp_extract(F.lower(F.coalesce(label, F.lit(""))), r"^[\s\p{Punct}]*([\p{L}]+)", 1)
    pairs = [F.lit(x) for code, names in LANGUAGES.items() for name in names for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), head)
