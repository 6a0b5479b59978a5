"""Language detection by stop words, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequent words of each language.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "are", "this", "with"),
    "de": ("der", "die", "und", "das", "von", "zu", "den", "ist", "sich", "des", "auf", "für", "nicht", "dem"),
    "fr": ("le", "la", "les", "et", "des", "un", "une", "du", "est", "que", "dans", "pas", "pour", "qui"),
    "es": ("el", "los", "las", "que", "del", "una", "por", "con", "para", "su", "es", "como", "se", "y"),
    "vi": ("của", "và", "các", "được", "trong", "cho", "là", "này", "không", "theo", "với", "điều", "về", "có"),
}


def language(text: Column) -> Column:
    """The language most of whose stop words a text uses, the earlier listed of equals; null without any."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    scores = F.array(*[F.struct(_uses(words, ws).alias("n"), (-F.lit(i)).alias("order"), F.lit(code).alias("code")) for i, (code, ws) in enumerate(STOP_WORDS.items())])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["code"])


def is_english(text: Column) -> Column:
    return F.coalesce(language(text) == "en", F.lit(False))


def _uses(words: Column, known: tuple) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*known)))
