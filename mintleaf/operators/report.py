"""Reports of entities: playbook advice, payload, text, and a check of the text's numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: numbers that a text may hold without a source.
EXEMPT = ["1", "2", "3", "4", "5", "30", "100"]


def playbook_matches(issues: DataFrame, playbook: DataFrame) -> DataFrame:
    """(issue_id, entry_id, score): the entry of the issue's aspect with most keywords in the issue, ties to the first.

    An issue of an aspect without entries meets all of them. ``playbook`` is a small table (entry_id, aspect, keywords).
    """
    book = playbook.agg(F.sort_array(F.collect_list(F.struct("entry_id", "aspect", "keywords"))).alias("book"))
    rows = issues.crossJoin(F.broadcast(book))
    own = F.filter("book", lambda b: b["aspect"] == F.col("aspect"))
    pool = F.when(F.size(own) > 0, own).otherwise(F.col("book"))
    low = F.lower(F.coalesce(F.col("issue"), F.lit("")))
    scored = F.transform(pool, lambda b: F.struct(F.size(F.filter(b["keywords"], lambda k: low.contains(k))).alias("score"), (-b["entry_id"]).alias("neg")))
    return rows.withColumn("best", F.array_max(scored)).select("issue_id", (-F.col("best.neg")).alias("entry_id"), F.col("best.score").alias("score"))


def payloads(health: DataFrame, cards: DataFrame, causes: DataFrame | None = None, playbook: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(Restaurant, payload): JSON with the index, the aspects from the weakest up, the first root causes, and playbook entries.

    With a ``playbook`` (entry_id, aspect, keywords) there are two entries: that of the weakest aspect for the first root
    cause, and that of the second-weakest for the second.
    """
    rank = F.row_number().over(Window.partitionBy("Restaurant").orderBy("score", "aspect"))
    aspects = health.withColumn("r", rank).groupBy("Restaurant").agg(F.sort_array(F.collect_list(F.struct("r", "aspect", "score", "status", "total_mentions", "neg_mentions", "pos_mentions"))).alias("a"))
    out = cards.select("Restaurant", "Overall_Health", "Average_Stars", "Total_Reviews").join(aspects, "Restaurant", "left")
    fields = [F.col("Restaurant").alias("restaurant"), F.col("Overall_Health").alias("overall_health_index"), F.col("Average_Stars").alias("average_stars"), F.col("Total_Reviews").alias("total_reviews"), F.col("a").alias("aspects"), F.col("a.aspect")[0].alias("weakest"), F.col("a.aspect")[1].alias("second_weakest")]
    if causes is not None:
        quote = F.element_at("evidence_quotes", 1) if "evidence_quotes" in causes.columns else F.lit(None).cast("string")
        first = causes.filter(F.col("rank") <= top).groupBy("Restaurant").agg(F.sort_array(F.collect_list(F.struct("rank", "root_cause", "frequency", quote.alias("sample_quote")))).alias("c"))
        out = out.join(first, "Restaurant", "left")
        fields.append(F.col("c").alias("clusters"))
    if playbook is not None:
        issue = lambda k: F.get("c", F.lit(k))["root_cause"] if causes is not None else F.lit(None).cast("string")
        asked = [F.struct(F.lit(k).alias("k"), F.get("a", F.lit(k))["aspect"].alias("aspect"), issue(k).alias("issue")) for k in (0, 1)]
        issues = out.select("Restaurant", F.explode(F.array(*asked)).alias("q")).select(F.struct("Restaurant", "q.k").alias("issue_id"), "q.aspect", "q.issue")
        found = playbook_matches(issues, playbook).join(F.broadcast(playbook), "entry_id").groupBy("issue_id.Restaurant").agg(
            F.sort_array(F.collect_list(F.struct(F.col("issue_id.k").alias("k"), *[c for c in playbook.columns]))).alias("p")
        )
        out = out.join(found, "Restaurant", "left")
        fields.append(F.col("p").alias("playbook"))
    return out.select("Restaurant", F.to_json(F.struct(*fields)).alias("payload"))


def report_text(cards: DataFrame, health: DataFrame) -> DataFrame:
    """(Restaurant, report): three sentences from a template."""
    rank = F.row_number().over(Window.partitionBy("Restaurant").orderBy("score", "aspect"))
    weak = health.withColumn("r", rank).filter("r = 1").select("Restaurant", "aspect", "score", "neg_mentions")
    said = F.format_string(
        "%s has a health index of %.1f from %d reviews. Its weakest aspect is %s at %.1f, with %d negative mentions. The average rating is %s.",
        "Restaurant", "Overall_Health", "Total_Reviews", "aspect", "score", "neg_mentions", F.col("Average_Stars").cast("string"),
    )
    return cards.join(weak, "Restaurant").select("Restaurant", said.alias("report"))


def unmatched_numbers(text: Column, payload: Column) -> Column:
    """Numbers of the text that the payload doesn't hold as a substring, without the exempt ones."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.filter(F.array_distinct(found), lambda n: ~payload.contains(n) & ~n.isin(*EXEMPT))


def verify_numbers(reports: DataFrame, text: str = "report", payload: str = "payload") -> DataFrame:
    missing = unmatched_numbers(F.col(text), F.col(payload))
    return reports.withColumn("unmatched_numbers", missing).withColumn("verification_passed", F.size("unmatched_numbers") == 0)
