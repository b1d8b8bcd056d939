"""Text column helpers: cleaning, lengths, tokens, matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null or blank text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))


def clean_text(text: Column) -> Column:
    """Lower case without links, e-mail addresses and tags, single spaces; null becomes ''."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (r"(https?://|www\.)[^ \t\r\n]+", r"[^ \t\r\n]+@[^ \t\r\n]+", r"<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def candidate_terms(text: Column) -> Column:
    """Distinct lower-case tokens of three letters or more, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)))


def hits(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in the text as substrings."""
    out = F.lit(0)
    for w in words:
        out = out + F.when(text.contains(w), 1).otherwise(0)
    return out


def star_sentiment(rating: Column, negative_to: float = 2.0, neutral_to: float = 3.5) -> Column:
    """Negative up to ``negative_to``, Neutral up to ``neutral_to``, else Positive; null stays null."""
    return F.when(rating.isNull(), None).when(rating <= negative_to, "Negative").when(rating <= neutral_to, "Neutral").otherwise("Positive")


def encode_sentiment(sentiment: Column) -> Column:
    return F.when(sentiment == "Negative", 0).when(sentiment == "Positive", 2).otherwise(1)


def decode_sentiment(label: Column) -> Column:
    return F.when(label == 0, "Negative").when(label == 2, "Positive").otherwise("Neutral")


def canonical(label: Column, mapping: dict[str, str], default: str) -> Column:
    """The mapped name of a label (case and outer space don't count), or the default."""
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k.lower(), v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(label))), F.lit(default))
