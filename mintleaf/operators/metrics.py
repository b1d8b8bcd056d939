"""Aspect metrics, trends, peers, distributions and insights over review-aspect units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mintleaf.functions.numbers import count_if, half_even, percent, ratio
from mintleaf.schemas import ASPECTS, SENTIMENTS, UNIT_SENTIMENTS

SMALL_SAMPLE = 10


def aspect_table(spark: SparkSession, aspects=ASPECTS) -> DataFrame:
    """The aspects with their order; a few rows."""
    return spark.createDataFrame([(a, k) for k, a in enumerate(aspects)], "aspect string, aspect_order int")


def _shares(whole: str, names=UNIT_SENTIMENTS):
    return [c for s in names for c in (F.coalesce(F.col(f"n_{s}"), F.lit(0)).alias(f"{s}_Count"), percent(F.coalesce(F.col(f"n_{s}"), F.lit(0)), F.col(whole)).alias(f"{s}_Pct"))]


def _counts():
    return [count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in UNIT_SENTIMENTS]


def aspect_metrics(units: DataFrame, reviews: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Mentions, rate and sentiment shares of every aspect, also those without mentions, for each scope in one pass.

    ``by`` names the scope columns (none: one scope). Eligible reviews are the distinct reviews of the scope in
    ``reviews``, or else in the units.
    """
    by = by or []
    spark = units.sparkSession
    eligible = (reviews if reviews is not None else units).groupBy(*by).agg(F.countDistinct("review_id").alias("Eligible_Reviews"))
    found = units.groupBy(*by, "aspect").agg(F.countDistinct("review_id").alias("mentions"), *_counts())
    grid = eligible.crossJoin(F.broadcast(aspect_table(spark)))
    rows = grid.join(found, [*by, "aspect"], "left").withColumn("Mention_Count", F.coalesce("mentions", F.lit(0)))
    return rows.select(
        *by, F.col("aspect").alias("Aspect"), "Eligible_Reviews", "Mention_Count", percent(F.col("Mention_Count"), F.col("Eligible_Reviews")).alias("Mention_Rate_Pct"), *_shares("Mention_Count")
    )


def aspect_metrics_rollup(units: DataFrame, by: str = "Restaurant", total: str = "All", rsd: float | None = None) -> DataFrame:
    """Mentions and sentiment counts for each (entity, aspect) and each aspect over all entities, by grouping sets.

    Rows over all entities have ``Is_Total`` and the name ``total``; a null entity is an entity. With ``rsd`` the
    reviews are counted approximately, to that relative standard deviation.
    """
    mentions = F.countDistinct("review_id") if rsd is None else F.approx_count_distinct("review_id", rsd)
    counts = [count_if(F.col("sentiment") == s).alias(f"{s}_Count") for s in UNIT_SENTIMENTS]
    sets = units.groupingSets([[F.col(by), F.col("aspect")], [F.col("aspect")]], F.col(by), F.col("aspect"))
    rows = sets.agg(F.grouping(by).alias("_all"), mentions.alias("Mention_Count"), *counts)
    named = F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(by)).alias(by)
    return rows.select(named, F.col("aspect").alias("Aspect"), (F.col("_all") == 1).alias("Is_Total"), "Mention_Count", *[f"{s}_Count" for s in UNIT_SENTIMENTS])


def monthly_trends(units: DataFrame) -> DataFrame:
    """Reviews and sentiment shares of each month; months that are null or malformed go; small samples are flagged."""
    months = units.filter(F.col("YearMonth").rlike(r"^\d{4}-\d{2}$")).groupBy("YearMonth").agg(F.countDistinct("review_id").alias("Sample_Size"), *_counts())
    small = F.col("Sample_Size") < SMALL_SAMPLE
    return months.select(
        "YearMonth", "Sample_Size", F.col("Sample_Size").alias("Total_Mentions"), *_shares("Sample_Size"), small.alias("Small_Sample_Warning"), small.alias("Sample_Size_Warning")
    ).orderBy("YearMonth")


def peer_comparison(units: DataFrame, aspect: str, target: str, peers: list[str]) -> DataFrame:
    """Sentiment shares of one aspect for the target, then its peers in the given order; those without rows get zeros."""
    names = [(target, "Target", 0), *((p, "Peer", k) for k, p in enumerate((p for p in peers if p != target), 1))]
    chosen = units.sparkSession.createDataFrame(names, "Restaurant string, Role string, ord int")
    found = units.filter(F.col("aspect") == aspect).groupBy("Restaurant").agg(F.count(F.lit(1)).alias("n"), *_counts())
    rows = chosen.join(found, "Restaurant", "left")
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0)))
    shares = _shares("n")
    return rows.select("Restaurant", "Role", F.col("n").alias("Reviews_Mentioning_Aspect"), F.col("n").alias("Mention_Count"), *shares[1::2], *shares[0::2], "ord").orderBy("ord").drop("ord")


def melt_sentiments(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, Sentiment, Count, Pct, Denominator) from the wide metrics."""
    pairs = ", ".join(f"'{s}', {s}_Count, {s}_Pct" for s in UNIT_SENTIMENTS)
    return metrics.selectExpr(*keys, "Mention_Count AS Denominator", f"stack({len(UNIT_SENTIMENTS)}, {pairs}) AS (Sentiment, Count, Pct)").select(*keys, "Sentiment", "Count", "Pct", "Denominator")


def net_polarity(metrics: DataFrame, small: int = SMALL_SAMPLE) -> DataFrame:
    return metrics.withColumns({"Net_Polarity": half_even(F.col("Positive_Pct") - F.col("Negative_Pct"), 1), "Small_Sample": F.col("Mention_Count") < small})


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value, null included."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", percent(F.col("n"), F.col("total"), 2).alias("pct"))


def training_summary(assertions: DataFrame) -> DataFrame:
    """The full aspect x sentiment grid with rows, clauses and reviews, and a TOTAL row.

    The ids of clauses and of reviews are dealt out once, and each gets the set of its cells, as bits. No ids are grouped
    before they are dealt out: most differ, so that a table of them would grow with the split that a task reads.
    """
    cells = [*((a, s) for a in ASPECTS for s in SENTIMENTS), ("TOTAL", "TOTAL")]
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1
    used = assertions.filter(F.col("aspect").isin(*ASPECTS) & F.col("sentiment").isin(*SENTIMENTS)).withColumn("cell", (place(ASPECTS, "aspect") * len(SENTIMENTS) + place(SENTIMENTS, "sentiment")).cast("int"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id")) for kind, c in enumerate(("clause_id", "review_id"))])
    ids = used.select(F.expr("shiftleft(1, cell)").alias("bit"), F.explode(kinds).alias("k")).select("bit", "k.kind", "k.id").filter("id IS NOT NULL")
    sets = ids.repartition("kind", "id").groupBy("kind", "id").agg(F.bit_or("bit").alias("bits"))
    distinct = lambda kind, k: count_if((F.col("kind") == kind) & (F.col("bits").bitwiseAND(1 << k if k < len(cells) - 1 else -1) != 0))
    rows = [F.struct(F.lit(k).alias("cell"), F.lit(a).alias("aspect"), F.lit(s).alias("sentiment"), distinct(0, k).alias("clauses"), distinct(1, k).alias("reviews")) for k, (a, s) in enumerate(cells)]
    counts = used.rollup("cell").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("cell", F.lit(len(cells) - 1)).alias("cell"), "n")
    found = sets.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return found.join(F.broadcast(counts), "cell", "left").select("aspect", "sentiment", F.coalesce("n", F.lit(0)).alias("n"), "clauses", "reviews")


def dataset_kpis(reviews: DataFrame, assertions: DataFrame, units: DataFrame) -> DataFrame:
    """One row: reviews, entities, units, assertions, and mean clauses of a review."""
    a = reviews.agg(F.countDistinct("review_id").alias("n_reviews"))
    b = assertions.agg(F.count(F.lit(1)).alias("n_assertions"), F.countDistinct("Restaurant").alias("n_entities"), F.countDistinct("review_id").alias("reviews_with_assertions"))
    c = units.agg(F.count(F.lit(1)).alias("n_units"))
    return a.crossJoin(b).crossJoin(c).withColumn("mean_assertions", half_even(ratio(F.col("n_assertions"), F.col("reviews_with_assertions")), 3))


def status_counts(assertions: DataFrame) -> DataFrame:
    """For each review: rows of each status, and whether it has no aspect at all."""
    return assertions.groupBy("review_id").agg(
        count_if(F.col("annotation_status") == "Annotated").alias("annotated"), count_if(F.col("annotation_status") == "Needs Review").alias("needs_review"),
        count_if(F.col("annotation_status") == "No Aspect Opinion").alias("no_opinion"),
    ).withColumn("zero_aspects", F.col("annotated") == 0)


def multi_assertion_clauses(assertions: DataFrame) -> DataFrame:
    """Clauses with more than one assertion, with their aspects (at most the aspects there are)."""
    return assertions.groupBy("clause_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("aspect")).alias("aspects")).filter("n > 1").withColumn("aspects", F.concat_ws("|", "aspects"))


def scoped(units: DataFrame, restaurant: str = "All", start=None, end=None) -> DataFrame:
    """Rows of one entity ('All': any) whose date lies from the start to the end of the later day; bounds in any order."""
    out = units if restaurant == "All" else units.filter(F.col("Restaurant") == restaurant)
    if start is not None and end is not None:
        a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
        out = out.filter((F.col("Review_Date") >= F.least(a, b)) & (F.col("Review_Date") < F.date_add(F.greatest(a, b), 1)))
    return out


def descriptive_insights(units: DataFrame, reviews: DataFrame, target: str | None = None, peers: list[str] | None = None) -> DataFrame:
    """(Category, Observation, Metric, Sample_Size): volumes, shares, the last month against the one before, and peers.

    Ties go to the aspect that sorts first.
    """
    scope = units if target is None else units.filter(F.col("Restaurant") == target)
    base = reviews if target is None else reviews.filter(F.col("Restaurant") == target)
    m = aspect_metrics(scope, base)
    desc = lambda c: F.max_by("row", F.struct(F.col(c), F.col("inverse")))
    order = F.create_map(*[F.lit(x) for a, k in zip(sorted(ASPECTS), range(len(ASPECTS), 0, -1), strict=True) for x in (a, k)])
    m = m.withColumn("inverse", F.element_at(order, F.col("Aspect"))).withColumn("row", F.struct(*m.columns))
    top = m.filter("Mention_Count > 0").agg(desc("Mention_Count").alias("r"))
    low = m.filter("Mention_Count > 0").agg(F.min_by("row", F.struct("Mention_Count", F.lit(0) - F.col("inverse"))).alias("r"))
    line = lambda d, category, text, metric: d.filter("r IS NOT NULL").select(F.lit(category).alias("Category"), text.alias("Observation"), metric.alias("Metric"), F.col("r.Mention_Count").alias("Sample_Size"))
    rate = F.format_string("%.1f%%", F.col("r.Mention_Rate_Pct"))
    parts = [line(top, "Highest volume", F.concat(F.col("r.Aspect"), F.lit(" is mentioned most")), rate)]
    both = low.crossJoin(top.select(F.col("r.Aspect").alias("first"))).filter(F.col("r.Aspect") != F.col("first"))
    parts.append(line(both, "Lowest volume", F.concat(F.col("r.Aspect"), F.lit(" is mentioned least")), rate))
    for s in ("Negative", "Positive"):
        most = m.filter((F.col("Mention_Count") >= 3) & (F.col(f"{s}_Pct") > 0)).agg(desc(f"{s}_Pct").alias("r"))
        parts.append(line(most, f"Highest {s.lower()} share", F.concat(F.col("r.Aspect"), F.lit(f" has the highest {s.lower()} share")), F.format_string("%.1f%%", F.col(f"r.{s}_Pct"))))
    months = monthly_trends(scope)
    w = Window.orderBy(F.desc("YearMonth"))  # a row for each month
    last = months.select("YearMonth", "Negative_Pct", "Sample_Size").withColumns({"before": F.lead("Negative_Pct").over(w), "rn": F.row_number().over(w)}).filter("rn = 1 AND before IS NOT NULL")
    parts.append(last.select(F.lit("Trend").alias("Category"), F.concat(F.lit("Negative share in "), "YearMonth").alias("Observation"), F.format_string("%.1f -> %.1f", "before", "Negative_Pct").alias("Metric"), F.col("Sample_Size")))
    if target is not None and peers:
        rates = units.filter(F.col("Restaurant").isin(target, *peers)).groupBy("Restaurant").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("sentiment") == "Negative").alias("neg"))
        rates = rates.withColumn("rate", 100 * ratio(F.col("neg"), F.col("n")))
        compared = rates.agg(F.max(F.when(F.col("Restaurant") == target, F.col("rate"))).alias("own"), F.avg(F.when(F.col("Restaurant") != target, F.col("rate"))).alias("others"), F.max(F.when(F.col("Restaurant") == target, F.col("n"))).alias("n"))
        compared = compared.filter("own IS NOT NULL AND others IS NOT NULL")
        parts.append(compared.select(F.lit("Peers").alias("Category"), F.lit("Negative share against the mean of peers").alias("Observation"), F.format_string("%.1f vs %.1f", "own", "others").alias("Metric"), F.col("n").alias("Sample_Size")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
