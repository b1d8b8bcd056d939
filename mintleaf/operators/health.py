"""Health scores of entities: smoothed polarity, recency weights, scorecards and their validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.functions.numbers import clamp, count_if, half_even

PRIOR, STRENGTH = 0.35, 5.0
#: The aspects of a scorecard with their weights, and the bands of a score with their colours.
WEIGHTS = {"Food": 0.40, "Service": 0.30, "Price": 0.15, "Ambience": 0.15}
BANDS = ((75.0, "Excellent", "#16A34A"), (55.0, "Satisfactory", "#D97706"), (None, "Critical Alert", "#DC2626"))
CARD_NAMES = {"Price / Value": "Price"}


def health_score(pos: Column, neg: Column, neu: Column, prior: float = PRIOR, k: float = STRENGTH) -> Column:
    """50 * (smoothed polarity + 1) within 0 and 100, one decimal; without weight it is the prior's score."""
    n = (pos + neg + neu).cast("double")
    raw = F.when(n <= 1e-9, F.lit(prior)).otherwise((pos - neg).cast("double") / n)
    return clamp(half_even(50.0 * ((n * raw + k * prior) / (n + k) + 1.0), 1), 0.0, 100.0)


def band(score: Column, what: str = "status") -> Column:
    at = 1 if what == "status" else 2
    out = F.lit(BANDS[-1][at])
    for b in reversed(BANDS[:-1]):
        out = F.when(score >= b[0], b[at]).otherwise(out)
    return out


def recency_weights(reviews: DataFrame, half_life_days: float, order: list[str]) -> DataFrame:
    """``reviews`` with a weight that halves every ``half_life_days`` of age.

    Age counts from the entity's latest date. A missing date takes the entity's median age; an entity without any date
    takes the rank of the row in ``order`` as age.
    """
    seconds = F.col("Review_Date").cast("timestamp").cast("double")
    # the median age is the age of the median date. It comes from the counts of an entity's different dates, so that no task
    # holds the dates of all rows of a large entity; a row for each entity
    dated = reviews.filter(F.col("Review_Date").isNotNull()).groupBy("Restaurant", seconds.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    entities = dated.groupBy("Restaurant").agg(F.max("s").alias("_latest"), F.percentile("s", F.lit(0.5), F.col("n")).alias("_median"))
    aged = reviews.join(entities, "Restaurant", "left")
    age = (F.col("_latest") - F.coalesce(seconds, F.col("_median"))) / 86400.0
    weight = lambda days: F.exp(-math.log(2.0) / half_life_days * days)
    known = aged.filter(F.col("_latest").isNotNull()).withColumn("weight", weight(age))
    # only rows of entities without any date are ranked
    rank = F.row_number().over(Window.partitionBy("Restaurant").orderBy(*order)) - 1
    other = aged.filter(F.col("_latest").isNull()).withColumn("weight", weight(rank.cast("double")))
    return known.unionByName(other).drop("_latest", "_median")


def aspect_health(findings: DataFrame, entities: DataFrame, weighted: bool = False) -> DataFrame:
    """One row for each (entity, scorecard aspect), also without mentions: score, status, colour, mentions, weight.

    With ``weighted`` the column ``weight`` of the findings counts in place of the rows.
    """
    card = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CARD_NAMES.items() for x in kv]), F.col("aspect")), F.col("aspect"))
    w = F.col("weight") if weighted else F.lit(1.0)
    by = lambda s: F.col("sentiment") == s
    found = findings.withColumn("aspect", card).filter(F.col("aspect").isin(*WEIGHTS)).groupBy("Restaurant", "aspect").agg(
        *[count_if(by(s)).alias(n) for s, n in (("Positive", "pos"), ("Neutral", "neu"), ("Negative", "neg"))], F.count(F.lit(1)).alias("total"),
        *[F.sum(F.when(by(s), w).otherwise(0.0)).alias(f"{n}_w") for s, n in (("Positive", "pos"), ("Neutral", "neu"), ("Negative", "neg"))], F.sum(w).alias("total_w"),
    )
    aspects = findings.sparkSession.createDataFrame(list(WEIGHTS.items()), "aspect string, aspect_weight double")
    rows = entities.select("Restaurant").distinct().crossJoin(F.broadcast(aspects)).join(found, ["Restaurant", "aspect"], "left").fillna(0, ["pos", "neu", "neg", "total", "pos_w", "neu_w", "neg_w", "total_w"])
    rows = rows.withColumn("score", health_score(F.col("pos_w"), F.col("neg_w"), F.col("neu_w")))
    return rows.select(
        "Restaurant", "aspect", "score", band(F.col("score")).alias("status"), band(F.col("score"), "color").alias("color"), F.col("pos").alias("pos_mentions"), F.col("neu").alias("neu_mentions"),
        F.col("neg").alias("neg_mentions"), F.col("total").alias("total_mentions"), half_even(F.col("total_w"), 2).alias("effective_weight"), "aspect_weight",
    )


def scorecards(health: DataFrame, reviews: DataFrame) -> DataFrame:
    """One wide row for each entity: overall index, stars, reviews, and score, status and mentions of each aspect."""
    wide = health.groupBy("Restaurant").agg(
        # in a fixed order, so that the sum of doubles is the same in every run
        half_even(sum((F.sum(F.when(F.col("aspect") == a, F.col("score")).otherwise(0.0)) * w for a, w in WEIGHTS.items()), F.lit(0.0)), 1).alias("Overall_Health"),
        *[F.max(F.when(F.col("aspect") == a, F.col(c))).alias(f"{a}_{n}") for a in WEIGHTS for c, n in (("score", "Score"), ("status", "Status"), ("total_mentions", "Mentions"))],
    )
    stars = reviews.groupBy("Restaurant").agg(half_even(F.avg("star_rating"), 2).alias("Average_Stars"), F.count(F.lit(1)).alias("Total_Reviews"))
    columns = ["Restaurant", "Overall_Health", "Average_Stars", "Total_Reviews", *[f"{a}_{n}" for a in WEIGHTS for n in ("Score", "Status", "Mentions")]]
    return wide.join(stars, "Restaurant").select(*columns).orderBy(F.desc("Overall_Health"), "Restaurant")


def _value_ranks(cards: DataFrame, column: str) -> DataFrame:
    """(column, first, ties): how many rows have a larger value, and how many this one. A row for each value; the values are rounded, so they are few."""
    values = cards.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("ties"))
    before = F.sum("ties").over(Window.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1))
    return values.withColumn("first", F.coalesce(before, F.lit(0)))


def leaderboard(cards: DataFrame) -> DataFrame:
    """Rank by the overall index; equal indexes share a rank. The values are ranked, and the entities look theirs up."""
    ranks = _value_ranks(cards, "Overall_Health")
    return cards.join(ranks, "Overall_Health").select((F.col("first") + 1).cast("int").alias("rank"), "Restaurant", "Overall_Health")


def spearman(cards: DataFrame, x: str = "Overall_Health", y: str = "Average_Stars", level: float = 0.05) -> DataFrame:
    """(n, rho, p_value, significant): correlation of average ranks over the entities, with its two-sided p.

    Where all entities share one value of a column rho isn't defined: rho and p are NaN, and nothing is significant. The
    cards are read once; what is ranked are the counts of the different pairs of (rounded) values.
    """
    pairs = cards.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))

    def centred(column: str) -> Column:
        """The average rank less the mean of all ranks."""
        upto = F.sum("n").over(Window.orderBy(F.desc(column)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return upto - (F.sum("n").over(Window.partitionBy(column)) - 1) / 2 - (F.sum("n").over(Window.partitionBy()) + 1) / 2

    rows = pairs.select("n", centred(x).alias("rx"), centred(y).alias("ry"))
    total = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    row = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), total("rx", "ry").alias("xy"), total("rx", "rx").alias("xx"), total("ry", "ry").alias("yy")).first()
    rho = p = None
    if row["n"]:
        spread = math.sqrt(row["xx"]) * math.sqrt(row["yy"])
        rho = max(-1.0, min(1.0, row["xy"] / spread)) if spread else math.nan
        p = spearman_p(rho, row["n"])
    return cards.sparkSession.createDataFrame([(row["n"], rho, p, None if p is None else p < level)], "n long, rho double, p_value double, significant boolean")


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation, by the t distribution."""
    if math.isnan(rho):
        return math.nan
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else float("nan")
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return _beta_tail((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), 1e-300)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out
