"""Assertions from clauses: ordered rules, spans, targets, links between clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mintleaf.functions.arrays import let, sums_before
from mintleaf.operators.terms import MOST_TERMS, first_pattern


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """(priority, pattern, aspect, sentiment, theme, status) in order of precedence."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "priority int, pattern string, aspect string, sentiment string, theme string, status string")


def first_rule(clauses: DataFrame, rules: DataFrame, text: str = "clause_text") -> DataFrame:
    """The clauses with the first rule whose pattern occurs (without case); clauses without any keep nulls.

    The rules are read by this call (an action; an error if there are more than ``MOST_TERMS``). One pass over a clause
    tells the few patterns that it can match (``terms.RuleIndex``); what the first one says is joined by broadcast. Rules of
    equal priority are taken in the order of their patterns.
    """
    names = ["priority", "aspect", "sentiment", "theme", "status"]
    rows = rules.select(*names, "pattern").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} rules")
    rows.sort(key=lambda r: (r["priority"], r["pattern"]))
    schema = T.StructType([T.StructField("_rule", T.IntegerType()), *[rules.schema[n] for n in names]])
    said = clauses.sparkSession.createDataFrame([(k, *[r[n] for n in names]) for k, r in enumerate(rows)], schema)
    found = clauses.drop(*names).withColumn("_rule", first_pattern(F.col(text), [r["pattern"] for r in rows]))
    return found.join(F.broadcast(said), "_rule", "left").drop("_rule")


def outer_spans(hits: DataFrame, key: str = "clause_id") -> DataFrame:
    """Hits (key, start, end) without those inside a longer hit, or inside an equal one that came before in the order."""
    ends = Window.partitionBy(key).orderBy("start", F.desc("end"))
    furthest = F.max("end").over(ends.rowsBetween(Window.unboundedPreceding, -1))
    return hits.distinct().withColumn("_far", furthest).filter(F.col("_far").isNull() | (F.col("end") > F.col("_far"))).drop("_far")


def find_spans(clauses: DataFrame, patterns: list[str], text: str = "clause_text", key: str = "clause_id") -> DataFrame:
    """(key, start, end, span) of every occurrence of the words, in code points, nested ones included.

    The pieces between the occurrences of a word give their places; no row leaves its task.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def places(p: str) -> Column:
        before = F.transform(F.split(low, rf"\Q{p}\E"), lambda x: (F.length(x) + len(p)).cast("long"))

        def spans(sizes: Column) -> Column:
            ends = F.zip_with(sums_before(sizes), sizes, lambda at, n: (at + n).cast("int"))
            return F.transform(F.slice(ends, 1, F.size(sizes) - 1), lambda e: F.struct((e - len(p)).alias("start"), e.alias("end"), F.lit(p).alias("span")))

        return F.when(low.contains(p), let(before, spans)).otherwise(F.array().cast("array<struct<start:int,end:int,span:string>>"))

    return clauses.select(key, F.explode(F.concat(*[places(p.lower()) for p in patterns])).alias("s")).select(key, "s.*")


def pair_targets(targets: Column, opinions: Column) -> Column:
    """Greedy pairs: opinions by position each take the nearest target that is free (ties: the earlier one).

    Both are arrays of struct(pos, word) of one clause; the result is an array of struct(target, opinion).
    """
    free = F.sort_array(targets)
    start = F.struct(free.alias("free"), F.array().cast("array<struct<target:string,opinion:string>>").alias("out"))

    def take(acc: Column, o: Column) -> Column:
        ranked = F.transform(acc["free"], lambda t: F.struct(F.abs(t["pos"] - o["pos"]).alias("d"), t["pos"].alias("pos"), t["word"].alias("word")))
        best = F.array_min(ranked)
        return F.when(F.size(acc["free"]) == 0, acc).otherwise(
            F.struct(F.filter(acc["free"], lambda t: t["pos"] != best["pos"]).alias("free"), F.concat(acc["out"], F.array(F.struct(best["word"].alias("target"), o["word"].alias("opinion")))).alias("out"))
        )

    return F.aggregate(F.sort_array(opinions), start, take)["out"]


def nearest_target(targets: Column, at: Column) -> Column:
    """The word nearest to a position; ties: the earlier one."""
    return F.array_min(F.transform(targets, lambda t: F.struct(F.abs(t["pos"] - at).alias("d"), t["pos"].alias("pos"), t["word"].alias("word"))))["word"]


def conflict_status(positive: Column, negative: Column, has_target: Column) -> Column:
    """struct(status, sentiment): both polarities, or an opinion without a target, need review."""
    made = lambda s, x: F.struct(F.lit(s).alias("status"), F.lit(x).cast("string").alias("sentiment"))
    return (
        F.when(positive & negative, made("Needs Review", "Unclear")).when((positive | negative) & ~has_target, made("Needs Review", None))
        .when(positive, made("Annotated", "Positive")).when(negative, made("Annotated", "Negative")).otherwise(made("No Aspect Opinion", None))
    )


def typed_scores(text: Column) -> Column:
    """Array of struct(aspect, score, sentiment) from forms like 'Food - 4/5': from 3.5 Positive, from 3 Neutral."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(food|service|ambience|atmosphere|price|value)\s*[-:]\s*(\d+(?:\.\d+)?)\s*/\s*5"), F.lit(0))

    def read(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, r"(?i)^([a-z]+)", 1))
        score = F.regexp_extract(x, r"(\d+(?:\.\d+)?)\s*/", 1).cast("double")
        aspect = F.when(name == "food", "Food").when(name == "service", "Service").when(name.isin("ambience", "atmosphere"), "Ambience").otherwise("Price / Value")
        return F.struct(aspect.alias("aspect"), score.alias("score"), F.when(score >= 3.5, "Positive").when(score >= 3.0, "Neutral").otherwise("Negative").alias("sentiment"))

    return F.transform(found, read)


def link_elaborations(rows: DataFrame, order: list[str], review: str = "review_id", status: str = "annotation_status", own_id: str = "assertion_id") -> DataFrame:
    """``elaboration_of``: for a clause without an opinion the last annotated assertion before it in its review."""
    before = Window.partitionBy(review).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(status) == "Annotated", F.col(own_id)), ignorenulls=True).over(before)
    return rows.withColumn("elaboration_of", F.when(F.col(status) != "Annotated", last))
