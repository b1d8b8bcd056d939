"""Conflict resolution and review-aspect units, the grain of all reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintleaf.schemas import ASPECTS, NO_OPINION, SENTIMENTS


#: What a unit takes from its first row.
META = ["Restaurant", "star_rating", "Review_Date", "YearMonth", "Reviewer"]


def resolve(has: dict[str, Column]) -> Column:
    """Positive and Negative together are Mixed; else Positive, Negative, Neutral in that order; else no opinion."""
    pos, neg, neu = (F.coalesce(has[s], F.lit(False)) for s in SENTIMENTS)
    return F.when(pos & neg, "Mixed").when(pos, "Positive").when(neg, "Negative").when(neu, "Neutral").otherwise(NO_OPINION)


def _seen(sentiment: Column) -> dict[str, Column]:
    return {s: F.bool_or(sentiment == s) for s in SENTIMENTS}


def resolve_sentiment(sentiment: Column) -> Column:
    """Aggregate: the resolved sentiment of a group."""
    return resolve(_seen(sentiment))


def opinions(assertions: DataFrame) -> DataFrame:
    """Assertions with a valid aspect and an opinion: the status isn't 'no opinion' and the sentiment is valid."""
    return assertions.filter(F.col("aspect").isin(*ASPECTS) & ~F.col("annotation_status").eqNullSafe(NO_OPINION) & F.col("sentiment").isin(*SENTIMENTS))


def review_aspect_units(assertions: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (review_id, aspect) with an opinion; metadata from its first row by ``order``."""
    first = F.min_by(F.struct(*META, "clause_text"), F.struct(*order))
    grouped = opinions(assertions).groupBy("review_id", "aspect").agg(resolve_sentiment(F.col("sentiment")).alias("sentiment"), first.alias("first"), F.count(F.lit(1)).alias("clause_count"))
    return grouped.select(
        "review_id", "aspect", F.col("first.Restaurant").alias("Restaurant"), "sentiment", *[F.col(f"first.{c}").alias(c) for c in META[1:]], "clause_count", F.col("first.clause_text").alias("sample_clause")
    )


def review_sentiment(units: DataFrame) -> DataFrame:
    """Overall sentiment of each review with units: any Negative, else any Mixed, else any Positive, else Neutral."""
    s = F.col("sentiment")
    has = {x: F.bool_or(s == x) for x in ("Positive", "Negative", "Neutral", "Mixed")}
    grouped = units.groupBy("review_id").agg(
        F.min("Restaurant").alias("Restaurant"), *[c.alias(f"has_{x}") for x, c in has.items()], F.countDistinct("aspect").alias("Aspects_Mentioned_Count")
    )
    overall = F.when(F.col("has_Negative"), "Negative").when(F.col("has_Mixed"), "Mixed").when(F.col("has_Positive"), "Positive").otherwise("Neutral")
    return grouped.select("review_id", "Restaurant", overall.alias("Overall_Sentiment"), "Aspects_Mentioned_Count")
