"""Aspects and sentiments of clauses: lexicon, latency rule, guards, semantic fallback.

A lexicon is a small table (aspect, term) that reaches the driver once and becomes a tree of words, in which the terms of a
clause are found in one pass over its words (``terms``): no join, no shuffle, and a cost that doesn't grow with the lexicon.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mintleaf.functions.arrays import let
from mintleaf.functions.text import hits
from mintleaf.operators.terms import MOST_TERMS, term_labels

#: Components of all centroids together that are taken to the driver (64 MB), and scores of a batch that a task holds.
MOST_NUMBERS, _SCORES = 1 << 23, 1 << 22
#: A lexicon to start with; give your own (aspect, term) pairs for real use. Phrases stand behind a bar.
LEXICON = {
    "Food": "appetizer breakfast bread cheese dinner dish dishes flavour food lunch meal meat mutton noodles sandwich seafood seasoning taste vegetables|main course",
    "Service": "bartender cashier host hostess reception service slow staff waiter waiters|front desk",
    "Price / Value": "bargain cost discount fee pay price prices refund tip|value for money",
    "Ambience": "acoustics ambience decor furniture garden lighting music noise patio terrace ac|live-music",
    "General Experience": "experience recommend recommended|come back|all in all",
}
#: Substrings that decide the lexical sentiment.
NEGATIVE = ["bad", "worst", "horrible", "poor", "slow", "cold", "dirty", "rude", "overpriced", "stale"]
POSITIVE = ["good", "great", "excellent", "amazing", "delicious", "fresh", "tasty", "friendly", "love", "best"]
#: Fixed values of the latency rule: phrases; words of waiting; durations and their context; other things that are slow.
LATE_PHRASES = ["took long", "took too long", "took forever", "served late", "poor service", "rude waiter", "ignored", "slow service", "waiting time", "wait time", "long wait"]
_WAITING = r"\b(?:wait|waited|waiting|delay|delayed|delays)\b"
_EAGER = r"\b(?:can'?t|cannot)\s+wait\s+to\b"
_DURATION = r"\b\d+\s*(?:min|mins|minute|minutes|hour|hours|hr|hrs)\b"
_SERVED = r"\b(?:wait|waited|waiting|took|delay|delayed|order|served|table|food|bill|deliver|delivery)\b"
_SLOW = r"\bslow\b"
_SLOW_THING = r"\bslow[\s-]cook(?:ed|ing)?\b|\b(?:music|song|songs|tempo|beat|tracks?|wifi|internet)\b"
_SERVICE_WORD = r"\b(?:waiter|waitress|staff|service|server|took|late|delay|order|bill)\b"
#: What every clause holds that one of these rules can find.
_MAY_BE_LATE = r"wait|delay|took|served late|poor service|rude waiter|ignored|slow|\d\s*(?:min|hour|hr)"
#: The latency rule: (what occurs, what else has to, what must not).
LATENCY_RULES = [
    ("|".join(map(re.escape, LATE_PHRASES)), None, None),
    (_WAITING, None, _EAGER),
    (_DURATION, _SERVED, None),
    (_SLOW, None, _SLOW_THING),
    (_SLOW, _SERVICE_WORD, None),
]
#: Fixed value: the staff recommends a dish, which doesn't speak for the place.
_STAFF_ADVICE = r"\b(?:waiter|waitress|server|staff|captain)\s+(?:recommend|recommended|suggested)\b"
#: Words of clauses that only rate something: what they rate isn't said.
FILLERS = "a all and but everything is it just not only overall pretty quite rather really so that they things this too very was were".split()
RATINGS = "acceptable amazing average awesome awful bad best decent excellent fine good great horrible lovely mediocre nice ok okay perfect poor superb terrible unremarkable wonderful worst".split()
#: First words of clauses that tell what happened.
NARRATIVE = "arrived booked called came dined drove ended got had met ordered parked reached stayed stopped tried visited walked went".split()


def lexicon_table(spark: SparkSession, lexicon: dict[str, str] | None = None) -> DataFrame:
    """(aspect, term) from a text for each aspect: words, and phrases behind bars."""
    rows = []
    for aspect, text in (lexicon or LEXICON).items():
        singles, *phrases = text.split("|")
        rows += [(aspect, term) for term in [*singles.split(), *phrases]]
    return spark.createDataFrame(rows, "aspect string, term string")


def has_latency(clause: Column) -> Column:
    """Whether a clause speaks of waiting: not of slow cooking or music, nor of 'can't wait to'."""
    low = F.lower(clause)
    found = F.lit(False)
    for occurs, needs, without in LATENCY_RULES:
        rule = low.rlike(occurs)
        rule = rule & low.rlike(needs) if needs else rule
        found = found | (rule & ~low.rlike(without) if without else rule)
    return F.when(low.rlike(_MAY_BE_LATE), F.coalesce(found, F.lit(False))).otherwise(F.lit(False))


def recommended_by_staff(clause: Column) -> Column:
    return F.coalesce(F.lower(clause).rlike(_STAFF_ADVICE), F.lit(False))


def _words(clause: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(clause, F.lit(""))), F.lit(r"[a-z0-9']+"), F.lit(0))


def only_generic(clause: Column) -> Column:
    """Whether a clause holds a rating and otherwise only words that say nothing of what is rated."""
    words, ratings = _words(clause), F.array(*map(F.lit, RATINGS))
    rest = F.array_except(words, F.array(*map(F.lit, [*FILLERS, *RATINGS])))
    return F.arrays_overlap(words, ratings) & (F.size(rest) == 0)


def factual_context(clause: Column) -> Column:
    """Whether a clause starts like a narrative: what was done, with how many, or where else to look."""
    start = F.regexp_replace(F.lower(F.trim(F.coalesce(clause, F.lit("")))), r"^(?:(?:i|we|they)\s+)?", "")
    return start.rlike(rf"^(?:(?:{'|'.join(NARRATIVE)})\b|\d+\s+(?:of\s+us|people|friends|guests)\b|(?:please\s+)?(?:do\s+)?follow\b)")


def aspect_array(clause: Column, lexicon: DataFrame, latency: bool = True, ascii: bool = False) -> Column:
    """The aspects whose terms occur in a clause, in the order of their names.

    A term is found as whole words without case; a space in it stands for any white space, a hyphen for a hyphen or a
    space. With ``latency`` the word 'slow' counts only by the latency rule, which also gives Service by itself, and words
    of recommending don't count where the staff recommends. With ``ascii`` any sign beyond ASCII ends a word of a term. The lexicon is read by this call (an action), and an error
    is raised if it has more than ``MOST_TERMS`` terms.
    """
    terms = lexicon.select("aspect", "term").limit(MOST_TERMS + 1).collect()
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a lexicon has at most {MOST_TERMS} terms")
    aspects = sorted({t["aspect"] for t in terms} | ({"Service"} if latency else set()))
    number = {a: k for k, a in enumerate(aspects)}
    advised = lambda t: latency and t["term"].startswith("recommend")
    slow = {"Service"} | {t["aspect"] for t in terms if t["term"] == "slow"} if latency else set()
    known = [(t["term"], number[t["aspect"]] + len(aspects) * advised(t)) for t in terms if not (latency and t["term"] == "slow")]
    if not aspects:
        return F.array().cast("array<string>")
    advice = {t["aspect"] for t in terms if advised(t)}

    def named(found: Column) -> Column:
        hits = {a: F.array_contains(found, k) for a, k in number.items()}
        for a in advice:
            hits[a] = hits[a] | (F.array_contains(found, number[a] + len(aspects)) & ~recommended_by_staff(clause))
        for a in slow:
            hits[a] = hits[a] | has_latency(clause)
        return F.array_compact(F.array(*[F.when(hits[a], F.lit(a)) for a in aspects]))

    return let(F.coalesce(term_labels(clause, known, ascii), F.array().cast("array<int>")), named)


def lexicon_matches(clauses: DataFrame, lexicon: DataFrame, latency: bool = True) -> DataFrame:
    """(clause_id, aspect) of the clauses (of distinct ids) with a term of an aspect; see ``aspect_array``."""
    return clauses.select("clause_id", F.explode(aspect_array(F.col("clause_text"), lexicon, latency)).alias("aspect"))


def lexical_sentiment(clause: Column, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """struct(sentiment, confidence, probs, polarity_score, hits) by substrings: more positive, more negative, or neither."""
    low = F.lower(F.coalesce(clause, F.lit("")))
    pos, neg = hits(low, positive or POSITIVE), hits(low, negative or NEGATIVE)

    def made(name: str, confidence: float, polarity: float) -> Column:
        rest = round((1 - confidence) / 2, 3)
        probs = [F.lit(x) for s in ("Negative", "Neutral", "Positive") for x in (s, confidence if s == name else rest)]
        return F.struct(
            F.lit(name).alias("sentiment"), F.lit(confidence).alias("confidence"), F.create_map(*probs).alias("probs"), F.lit(polarity).alias("polarity_score"), pos.alias("pos_hits"), neg.alias("neg_hits")
        )

    return F.when(pos > neg, made("Positive", 0.8, 0.6)).when(neg > pos, made("Negative", 0.8, -0.6)).otherwise(made("Neutral", 0.6, 0.0))


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): the mean of each component."""
    parts = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v")).select(label, F.col("v.m").alias("centroid"))


def nearest(vector: Column, points: list[list[float]]) -> Column:
    """struct(at, score): the point of the largest cosine, of equal ones the first; null for vectors that can't be compared.

    A batch of vectors is multiplied with all points at once. Null vectors, those of another length and those with a null or
    an infinite component can't be compared; the cosine with a vector of zeros is 0.
    """
    table = np.array(points, np.float64)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    unit = np.divide(table, norms, out=np.zeros_like(table), where=norms > 0).T
    width = len(unit)

    @F.arrow_udf("struct<at: int, score: double>")
    def find(vectors: pa.Array) -> pa.Array:
        n, at, score = len(vectors), [], []
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False)
        step = max(1, _SCORES // unit.shape[1])
        for lo in range(0, n, step):
            own = np.flatnonzero(fits[lo : lo + step])
            rows = vectors.slice(lo, step).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), width)
            good = np.isfinite(rows).all(axis=1)
            rows = np.where(good[:, None], rows, 0.0)
            length = np.linalg.norm(rows, axis=1)
            scores = rows @ unit / np.where(length > 0, length, 1.0)[:, None]
            best = scores.argmax(axis=1)
            places, values = np.full(min(step, n - lo), -1), np.zeros(min(step, n - lo))
            places[own[good]], values[own[good]] = best[good], scores[np.arange(len(own)), best][good]
            at.append(places)
            score.append(values)
        at, score = np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*score, np.zeros(0)])
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(score)], names=["at", "score"], mask=pa.array(at < 0))

    return find(vector)


def _read_centroids(centroids: DataFrame, columns: list[str]) -> list:
    """The table's rows, in the order of the first column; an error if they hold too many numbers."""
    size = centroids.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if size > MOST_NUMBERS:
        raise ValueError(f"centroids have at most {MOST_NUMBERS} components together")
    return sorted(centroids.select(*columns, "centroid").collect(), key=lambda r: r[0])


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, label: str = "label", vector: str = "embedding", key: str = "vec_id", threshold: float | None = None) -> DataFrame:
    """(key, predicted, score): the centroid of the largest cosine, ties to the smaller label; none below the threshold.

    The centroids, one for each label, are read by this call (an action) and go to the tasks as one matrix of a checked size.
    Vectors that can't be compared (``nearest``) have no row.
    """
    rows = _read_centroids(centroids, [label])
    kind = centroids.schema[label].dataType
    if not rows:
        return vectors.select(key, F.lit(None).cast(kind).alias("predicted"), F.lit(None).cast("double").alias("score")).limit(0)
    found = vectors.select(key, nearest(F.col(vector), [r["centroid"] for r in rows]).alias("best")).filter("best is not null")
    names = F.array(*[F.lit(r[label]).cast(kind) for r in rows])
    out = found.select(key, F.get(names, F.col("best.at")).alias("predicted"), F.col("best.score").alias("score"))
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def _nearest_aspects(clauses: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """``clauses`` with ``near``, an array of the nearest aspect, or empty: below the threshold, or a general one of a clause that the guards hold back."""
    rows, none = _read_centroids(centroids, ["ord", "aspect"]), F.array().cast("array<string>")
    if not rows:
        return clauses.withColumn("near", none)
    scored = clauses.withColumn("_best", nearest(F.col("embedding"), [r["centroid"] for r in rows]))
    aspect = F.get(F.array(*[F.lit(r["aspect"]) for r in rows]), F.col("_best.at"))
    held_back = (aspect == "General Experience") & (only_generic(F.col("clause_text")) | factual_context(F.col("clause_text")))
    return scored.withColumn("near", F.when((F.col("_best.score") >= threshold) & ~held_back, F.array(aspect)).otherwise(none)).drop("_best")


def semantic_fallback(clauses: DataFrame, matched: DataFrame, centroids: DataFrame, threshold: float = 0.22) -> DataFrame:
    """(clause_id, aspect) for the clauses (with an ``embedding``) that the lexicon left without any."""
    left = clauses.join(matched.select("clause_id").distinct(), "clause_id", "left_anti")
    return _nearest_aspects(left, centroids, threshold).select("clause_id", F.explode("near").alias("aspect"))


def extract_aspects(clauses: DataFrame, lexicon: DataFrame, centroids: DataFrame | None = None, threshold: float = 0.22, latency: bool = True, sentiment: Column | None = None) -> DataFrame:
    """(review_id, clause_id, clause_text, aspect, sentiment, confidence, probs, polarity_score): a row for each clause and aspect.

    Where the lexicon finds nothing and ``centroids`` (ord, aspect, centroid) are given, the nearest aspect of the clause's
    ``embedding`` is taken. Clauses without an aspect go. ``sentiment`` is the struct of a scorer, lexical by default.
    """
    rows = clauses.withColumn("_aspects", aspect_array(F.col("clause_text"), lexicon, latency))
    if centroids is not None:
        rows = _nearest_aspects(rows, centroids, threshold).withColumn("_aspects", F.when(F.size("_aspects") > 0, F.col("_aspects")).otherwise(F.col("near"))).drop("near")
    rows = rows.filter(F.size("_aspects") > 0).withColumn("_s", lexical_sentiment(F.col("clause_text")) if sentiment is None else sentiment)
    return rows.select("review_id", "clause_id", "clause_text", F.explode("_aspects").alias("aspect"), "_s.sentiment", "_s.confidence", "_s.probs", "_s.polarity_score")
