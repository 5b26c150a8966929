"""Keyword normalisation and word tokenisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword separator, word pattern and stop words.
KEYWORD_SEPARATOR = ","
# A word starts with a letter, digit or underscore; apostrophes may follow the first character.
WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at",
    "be", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from",
    "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "just", "me", "more", "most", "my", "no", "not", "of", "on", "only",
    "or", "other", "our", "out", "over", "she", "so", "some", "such", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "those", "to",
    "too", "under", "up", "very", "was", "we", "were", "what", "when", "where",
    "which", "while", "who", "why", "will", "with", "would", "you", "your",
)


def normalized_keywords(keywords: Column) -> Column:
    """Distinct lower-cased, trimmed keywords of one article ('' kept)."""
    parts = F.split(keywords, KEYWORD_SEPARATOR)
    return F.array_distinct(F.transform(parts, lambda k: F.trim(F.lower(k))))


def word_tokens(text: Column) -> Column:
    """Array of the lower-cased words of a whole text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def is_stop_word(word: Column) -> Column:
    """Membership in the stop-word list (planned as a hash-set lookup)."""
    return word.isin(*STOP_WORDS)
