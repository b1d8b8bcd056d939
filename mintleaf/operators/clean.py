"""Cleaning, binning and dating of raw reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.functions.text import encode_sentiment, star_sentiment, word_count
from mintleaf.sources.tables import written


def clean_reviews(raw: DataFrame, order: list[str]) -> DataFrame:
    """Numeric ratings only, trimmed texts of over 3 characters, named reviewers, one row for each (Restaurant, Review).

    Of equal (Restaurant, Review) rows the first by ``order`` stays. Null restaurants, reviews and ratings go.
    """
    text, reviewer = F.trim("Review"), F.trim("Reviewer")
    rows = raw.drop("7514").filter(~F.col("Rating").eqNullSafe("Like")).withColumns(
        {"Rating": F.expr("try_cast(Rating AS double)"), "Review": text, "Restaurant": F.trim("Restaurant"), "Reviewer": F.coalesce(F.when(reviewer != "", reviewer), F.lit("Anonymous"))}
    )
    rows = rows.filter((F.length("Review") > 3) & F.col("Rating").isNotNull() & F.col("Restaurant").isNotNull())
    # the first row of each text, found map-side before the shuffle
    rows = rows.groupBy("Restaurant", "Review").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first")).select("_first.*")
    sentiment = star_sentiment(F.col("Rating"))
    return rows.withColumns({"Sentiment": sentiment, "Label": encode_sentiment(sentiment), "Review_Length": F.length("Review"), "Word_Count": word_count(F.col("Review"))})


def rating_bin(rating: Column) -> Column:
    return F.when(rating <= 2.5, "low").when(rating <= 3.5, "mid").when(rating.isNotNull(), "high")


def length_bin(chars: Column) -> Column:
    return F.when(chars < 150, "short").when(chars <= 350, "medium").when(chars.isNotNull(), "long")


def year(ts: Column) -> Column:
    return F.year(ts)


def with_review_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """``original_row_id`` from 0 by a total order, and ``review_id`` REV_00001 and so on.

    Rows are numbered without gathering them: ranges of the order get their offsets from the sizes of those before. The
    rows are written once with their range, as two reads of a shuffle needn't be split alike.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ranged.join(F.broadcast(offsets), "_part").withColumn("original_row_id", inside + F.col("_before") - 1).drop("_part", "_before")
    return numbered.withColumn("review_id", F.format_string("REV_%05d", F.col("original_row_id") + 1))


def parse_dates(text: Column, formats=("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm", "M/d/yyyy")) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def backfill_dates(rows: DataFrame, raw: DataFrame, key: str = "review_id", missing_over: float = 0.5) -> DataFrame:
    """Dates (and months, reviewers) from ``raw`` by key where over a share of all dates is missing, else as they are."""
    share = rows.agg((F.avg(F.col("Review_Date").isNull().cast("double")) > missing_over).alias("_fill"))
    other = raw.select(key, F.col("Review_Date").alias("_date"), F.col("Reviewer").alias("_who"))
    joined = rows.join(other, key, "left").crossJoin(F.broadcast(share))
    date = F.when(F.col("_fill"), F.coalesce("Review_Date", "_date")).otherwise(F.col("Review_Date"))
    who = F.when(F.col("_fill"), F.coalesce("Reviewer", "_who")).otherwise(F.col("Reviewer"))
    return joined.withColumns({"Review_Date": date, "Reviewer": who}).withColumn("YearMonth", year_month(F.col("Review_Date"))).drop("_date", "_who", "_fill")


def eligibility(rows: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all conditions, and one row with how many fail each (``excluded_<reason>``)."""
    ok = [F.coalesce(c, F.lit(False)) for c in conditions.values()]
    counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(~c, 1)).alias(f"excluded_{n}") for n, c in zip(conditions, ok, strict=True)])
    kept = rows
    for c in ok:
        kept = kept.filter(c)
    return kept, counts


def aspect_conditioned(aspect: Column, clause: Column) -> Column:
    return F.concat(F.lit("Aspect: "), aspect, F.lit(" [SEP] "), clause)


def entity_list(rows: DataFrame, column: str = "Restaurant", without=("gold_benchmark",)) -> DataFrame:
    return rows.select(column).filter(F.col(column).isNotNull() & ~F.col(column).isin(*without)).distinct().orderBy(column)


def phrase_search(reviews: DataFrame, phrases: list[str], most: int = 5) -> DataFrame:
    """For each phrase: how many reviews hold it (without case), and the first ids."""
    low = F.lower(F.coalesce(F.col("Review"), F.lit("")))
    found = reviews.select("review_id", F.explode(F.array_compact(F.array(*[F.when(low.contains(p.lower()), F.lit(p)) for p in phrases]))).alias("phrase"))
    ids = found.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("phrase").orderBy("review_id")))
    firsts = ids.filter(F.col("_r") <= most).groupBy("phrase").agg(F.concat_ws("|", F.sort_array(F.collect_list("review_id"))).alias("review_ids"))
    return ids.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).join(firsts, "phrase")
