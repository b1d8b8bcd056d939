"""Complaints of entities: opinion pairs, their ranking with evidence, and merging of like phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.functions.arrays import let

#: Words between a target and its opinion, negators, and targets that say nothing.
COPULAS = ["is", "was", "were", "are", "tasted", "looked", "felt"]
NEGATORS = ["not", "never", "no"]
STOP_TARGETS = ["place", "restaurant", "thing", "one", "it", "experience", "order", "day", "time"]


def opinion_pairs(text: Column, targets: list[str], opinions: list[str]) -> Column:
    """Distinct phrases from word patterns: 'target is [not] opinion' as 'target [not] opinion', and 'opinion target'.

    The words of a text are made once; each looks at the next three.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z']+"), F.lit(0))
    known = [t for t in targets if t not in STOP_TARGETS]

    def phrases(a: Column, b: Column, c: Column, d: Column) -> Column:
        plain = a.isin(*known) & b.isin(*COPULAS) & c.isin(*opinions)
        negated = a.isin(*known) & b.isin(*COPULAS) & c.isin(*NEGATORS) & d.isin(*opinions)
        before = a.isin(*opinions) & b.isin(*known)
        return F.when(plain, F.concat_ws(" ", a, c)).when(negated, F.concat_ws(" ", a, F.lit("not"), d)).when(before, F.concat_ws(" ", a, b))

    return let(words, lambda ws: F.array_distinct(F.array_compact(F.transform(ws, lambda a, i: phrases(a, F.get(ws, i + 1), F.get(ws, i + 2), F.get(ws, i + 3))))))


def complaint_ranking(phrases: DataFrame, k: int = 5, negative_to: float = 2.5) -> DataFrame:
    """(Restaurant, phrase, frequency, rank): the 2k most frequent phrases of low-rated reviews of each entity."""
    low = phrases.filter(F.col("Rating") <= negative_to)
    counts = low.groupBy("Restaurant", "phrase").agg(F.count(F.lit(1)).alias("frequency"))
    rank = F.row_number().over(Window.partitionBy("Restaurant").orderBy(F.desc("frequency"), "phrase"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= 2 * k)


def evidence(phrases: DataFrame, ranking: DataFrame, order: list[str], most: int = 3, chars: int = 140, negative_to: float = 2.5) -> DataFrame:
    """The ranking with ``evidence_quotes``: the first distinct snippets, of 140 characters and '...' if cut."""
    snippet = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("..."))).otherwise(F.col("text"))
    rows = phrases.filter(F.col("Rating") <= negative_to).join(ranking.select("Restaurant", "phrase"), ["Restaurant", "phrase"]).withColumn("quote", snippet)
    firsts = rows.groupBy("Restaurant", "phrase", "quote").agg(F.min(F.struct(*order)).alias("o"))
    r = F.row_number().over(Window.partitionBy("Restaurant", "phrase").orderBy("o"))
    quotes = firsts.withColumn("r", r).filter(F.col("r") <= most).groupBy("Restaurant", "phrase").agg(F.sort_array(F.collect_list(F.struct("r", "quote"))).alias("q"))
    return ranking.join(quotes, ["Restaurant", "phrase"], "left").withColumn("evidence_quotes", F.col("q.quote")).drop("q")


def merge_like(ranking: DataFrame, k: int = 5, most: int = 3) -> DataFrame:
    """(Restaurant, rank, root_cause, frequency, evidence_quotes): phrases of the same words, or with two in common, merge by rank.

    A merged phrase takes the quotes of its parts, up to ``most`` different ones, those of the first phrase first; without
    ``evidence_quotes`` in the ranking there are none. The phrases of an entity are at most 2k, so each is a small array
    that a fold goes through.
    """
    quotes = F.coalesce(F.col("evidence_quotes"), F.array().cast("array<string>")) if "evidence_quotes" in ranking.columns else F.array().cast("array<string>")
    rows = ranking.groupBy("Restaurant").agg(F.sort_array(F.collect_list(F.struct("rank", "phrase", "frequency", quotes.alias("quotes")))).alias("all"))
    words = lambda p: F.array_distinct(F.split(p, " "))
    empty = F.array().cast("array<struct<phrase:string,frequency:bigint,quotes:array<string>>>")

    def like(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(words(a), words(b)))
        return (common >= 2) | ((common == F.size(words(a))) & (common == F.size(words(b))))

    def add(acc: Column, x: Column) -> Column:
        hit = F.exists(acc, lambda y: like(y["phrase"], x["phrase"]))
        first = F.filter(acc, lambda y: like(y["phrase"], x["phrase"]))[0]["phrase"]

        def grown(y: Column) -> Column:
            own = y["phrase"] == first
            return F.struct(
                y["phrase"].alias("phrase"), (y["frequency"] + F.when(own, x["frequency"]).otherwise(0)).alias("frequency"),
                F.when(own, F.slice(F.array_union(y["quotes"], x["quotes"]), 1, most)).otherwise(y["quotes"]).alias("quotes"),
            )

        new = F.struct(x["phrase"].alias("phrase"), x["frequency"].alias("frequency"), F.slice(x["quotes"], 1, most).alias("quotes"))
        return F.when(hit, F.transform(acc, grown)).otherwise(F.concat(acc, F.array(new)))

    merged = rows.select("Restaurant", F.posexplode(F.slice(F.aggregate("all", empty, add), 1, k)).alias("i", "c"))
    return merged.select("Restaurant", (F.col("i") + 1).alias("rank"), F.initcap("c.phrase").alias("root_cause"), F.col("c.frequency").alias("frequency"), F.col("c.quotes").alias("evidence_quotes"))
