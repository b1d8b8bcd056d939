"""Empirical-Bayes priors and beta-binomial smoothing of sentiment rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintleaf.functions.numbers import count_if, half_even
from mintleaf.operators.metrics import aspect_table

#: Prior where fewer than MIN_ENTITIES entities have MIN_N units: mean, alpha, beta; and the strength of a saturated one.
SPARSE, SATURATED, MIN_N, MIN_ENTITIES = (0.20, 2.0, 8.0), 10.0, 5, 3


def beta_priors(units: DataFrame, sentiment: str = "Negative", entity: str = "Restaurant") -> DataFrame:
    """(aspect, prior_mean, alpha, beta, M) for every aspect, by the method of moments over the entities' rates."""
    rates = units.groupBy("aspect", entity).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("sentiment") == sentiment).alias("k")).filter(F.col("n") >= MIN_N)
    moments = rates.withColumn("rate", F.col("k") / F.col("n")).groupBy("aspect").agg(F.count(F.lit(1)).alias("entities"), F.avg("rate").alias("p"), F.var_samp("rate").alias("v"))
    enough = F.coalesce(F.col("entities"), F.lit(0)) >= MIN_ENTITIES
    saturated = (F.col("v") <= 0) | (F.col("v") >= F.col("p") * (1 - F.col("p")))
    m = F.when(saturated, F.lit(SATURATED)).otherwise(F.col("p") * (1 - F.col("p")) / F.col("v") - 1)
    rows = aspect_table(units.sparkSession).join(moments, "aspect", "left")
    mean, alpha, beta = SPARSE
    return rows.select(
        "aspect", F.when(enough, F.col("p")).otherwise(mean).alias("prior_mean"), F.when(enough, F.col("p") * m).otherwise(alpha).alias("alpha"), F.when(enough, (1 - F.col("p")) * m).otherwise(beta).alias("beta")
    ).withColumn("M", F.col("alpha") + F.col("beta"))


def smoothed(metrics: DataFrame, priors: DataFrame, sentiment: str = "Negative") -> DataFrame:
    """The metrics with the smoothed rate (k + alpha) / (n + alpha + beta) in percent; without mentions it is the prior."""
    rows = metrics.join(priors.withColumnRenamed("aspect", "Aspect"), "Aspect", "left")
    n, k = F.col("Mention_Count"), F.col(f"{sentiment}_Count")
    rate = F.when(n == 0, F.col("prior_mean")).otherwise((k + F.col("alpha")) / (n + F.col("alpha") + F.col("beta")))
    pct, prior = half_even(100 * rate, 1), half_even(100 * F.col("prior_mean"), 1)
    return rows.select(
        *[c for c in metrics.columns], pct.alias(f"{sentiment}_Smoothed_Pct"), pct.alias(f"{sentiment}_Pct_Smoothed"), prior.alias(f"{sentiment}_Prior_Mean_Pct"), (prior / 100).alias(f"{sentiment}_Prior_Mean"),
        half_even(F.col("M"), 1).alias("EB_Prior_Strength_N"), half_even(F.col("M"), 1).alias("Prior_Weight_M"),
    )
