"""Domains and schemas of the review layers."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

ASPECTS = ("Food", "Service", "Price / Value", "Ambience", "General Experience")
SENTIMENTS = ("Positive", "Negative", "Neutral")
UNIT_SENTIMENTS = (*SENTIMENTS, "Mixed")
NO_OPINION = "No Aspect Opinion"
STATUSES = ("Annotated", "Needs Review", NO_OPINION)


def _schema(**columns) -> StructType:
    return StructType([StructField(n, t) for n, t in columns.items()])


_S, _I, _L, _D, _T = StringType(), IntegerType(), LongType(), DoubleType(), TimestampType()

#: Raw reviews as they arrive; Rating is text because "Like" occurs.
RAW_REVIEW = _schema(Restaurant=_S, Reviewer=_S, Review=_S, Rating=_S, Metadata=_S, Time=_S, Pictures=_I)
CLEAN_REVIEW = _schema(review_id=_S, Restaurant=_S, Reviewer=_S, Review=_S, Rating=_D, Time=_S, Sentiment=_S, Label=_I, Review_Length=_I, Word_Count=_I)
CLAUSE = _schema(review_id=_S, clause_id=_S, clause_idx=_I, clause_text=_S, clause_start_char=_I, clause_end_char=_I)
ASSERTION = _schema(
    assertion_id=_S, review_id=_S, clause_id=_S, clause_text=_S, aspect=_S, target_text=_S, target_start_char=_I, target_end_char=_I, opinion_text=_S, opinion_start_char=_I, opinion_end_char=_I,
    sentiment=_S, theme=_S, annotation_status=_S, clause_relation=_S, elaboration_of=_S, rationale=_S, annotator_version=_S,
)
UNIT = _schema(review_id=_S, aspect=_S, Restaurant=_S, sentiment=_S, star_rating=_D, Review_Date=_T, YearMonth=_S, Reviewer=_S, clause_count=_L, sample_clause=_S)
LABEL_SETS = _schema(review_id=_S, clause_id=_S, clause_text=_S, reference=ArrayType(_S), predicted=ArrayType(_S))
