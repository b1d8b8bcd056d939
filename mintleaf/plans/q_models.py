"""Queries for sources, models, reports and windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from mintleaf.operators import evaluate, health, ml, report
from mintleaf.plans.fixtures import ASSERTIONS_SQL, UNITS_SQL, assertions, table
from mintleaf.plans.q_analytics import _CARDS_SQL, _HEALTH_OUT, _W, _cards, _health, _health_sql
from mintleaf.sources import io
from mintleaf.streaming.monthly import windowed_counts


def _labelled(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", "text", F.col("quality").cast("double").alias("label"), (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int") % 10).alias("part"))


def quality_model(spark, d):
    """Held-out report of a logistic regression on the quality labels."""
    rows = _labelled(spark, d)
    train = ml.class_weights(rows.filter("part < 7"))
    model = ml.fit(train, ml.classifiers()["logistic regression"])
    return evaluate.classification_report(model.transform(rows.filter("part >= 7")), "label", "prediction")


def majority(spark, d):
    rows = _labelled(spark, d)
    return ml.majority_baseline(rows.filter("part < 7"), rows.filter("part >= 7")).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def model_leaderboard(spark, d):
    """Every family of models on the quality labels, by macro-F1 on the rows held out."""
    rows = _labelled(spark, d)
    train, test = ml.class_weights(rows.filter("part < 7")), rows.filter("part >= 7")
    return ml.leaderboard(ml.reports(ml.fit_all(train, ml.classifiers()), test))


def _book(spark):
    return spark.createDataFrame([(1, "Food", ["red", "ring"]), (2, "Food", ["widget"]), (3, "Service", ["small", "blue"]), (4, "Ambience", ["large"])], "entry_id int, aspect string, keywords array<string>")


def payload_entries(spark, d):
    """The payloads' playbook entries: for the weakest aspect and the first cause, and for the second of both."""
    cards, h = _cards(spark, d), _health(spark, d)
    causes = cards.select("Restaurant", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("Widget Ring").alias("root_cause"), F.lit(2).cast("long").alias("frequency")), F.struct(F.lit(2).alias("rank"), F.lit("Blue").alias("root_cause"), F.lit(1).cast("long").alias("frequency")))).alias("c")).select("Restaurant", "c.*")
    read = F.from_json("payload", "struct<weakest: string, second_weakest: string, clusters: array<struct<root_cause: string>>, playbook: array<struct<k: int, entry_id: int>>>")
    rows = report.payloads(h, cards, causes, _book(spark)).select("Restaurant", read.alias("p"))
    return rows.select("Restaurant", "p.weakest", "p.second_weakest", F.concat_ws("|", "p.clusters.root_cause").alias("causes"), F.concat_ws("|", F.col("p.playbook.entry_id").cast("array<string>")).alias("entries"))


def playbook(spark, d):
    book = _book(spark)
    issues = table(spark, d, "part").select(F.col("p_partkey").alias("issue_id"), F.when(F.col("p_type") == "MEDIUM", "Food").when(F.col("p_type") == "SMALL", "Service").otherwise("Other").alias("aspect"), F.col("p_name").alias("issue"))
    return report.playbook_matches(issues, book)


def reports(spark, d):
    cards, h = _cards(spark, d), _health(spark, d)
    said = report.report_text(cards, h).join(report.payloads(h, cards), "Restaurant")
    return report.verify_numbers(said).select("Restaurant", "report", "verification_passed")


def json_round_trip(spark, d):
    rows = table(spark, d, "events").select("event_id", io.json_labels(F.to_json(F.array("event_type", F.lit("x")))).alias("a"), io.json_labels(F.when(F.col("event_id") % 2 == 0, F.lit("[]")).otherwise("oops"), ["none"]).alias("b"))
    return rows.select("event_id", F.concat_ws("|", "a").alias("a"), F.concat_ws("|", "b").alias("b"))


QUERIES = {
    "quality_model_report": quality_model,
    "class_weights": lambda s, d: ml.class_weights(_labelled(s, d), boost={1.0: 2.0}).groupBy("label").agg(F.round(F.max("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n")),
    "model_leaderboard": model_leaderboard,
    "payload_entries": payload_entries,
    "majority_baseline": majority,
    "playbook_match": playbook,
    "report_verification": reports,
    "number_verification": lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat_ws("|", report.unmatched_numbers(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of 999 and 30")), F.concat(F.col("o_orderkey").cast("string"), F.lit(" 99")))).alias("unmatched")),
    "json_labels": json_round_trip,
    "nested_scorecards": lambda s, d: io.nested_json(_health(s, d).select("Restaurant", "aspect", "status", "total_mentions"), "Restaurant").select("Restaurant", F.md5("document").alias("document_md5")),
    "consolidated_confidence": lambda s, d: io.consolidate(assertions(s, d).filter("ord_line <= 3").drop("confidence"), assertions(s, d).filter("ord_line > 3"), ["review_id", "aspect", "confidence"]).groupBy("aspect").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 3).alias("confidence")),
    "windowed_counts": lambda s, d: windowed_counts(assertions(s, d)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")),
    "status_bands": lambda s, d: _health(s, d).groupBy(health.band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n")),
}

_L = "l AS (SELECT doc_id, text, CAST(quality AS DOUBLE) AS label FROM documents JOIN labels USING (doc_id))"

_H = f"{_W}{_health_sql(False)}, h AS ({_HEALTH_OUT.format(weight='CAST(total_w AS DOUBLE)')})"
_H2 = f"{_W}{_health_sql(False)}{_CARDS_SQL}, h AS ({_HEALTH_OUT.format(weight='CAST(total_w AS DOUBLE)')})"

ORACLE_SQL = {
    "class_weights": f"WITH {_L}, c AS (SELECT label, count(*) AS n FROM l GROUP BY 1) SELECT label, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) * CASE WHEN label = 1 THEN 2 ELSE 1 END, 6) AS weight, n FROM c",
    "playbook_match": """WITH b AS (SELECT * FROM (VALUES (1, 'Food', ['red', 'ring']), (2, 'Food', ['widget']), (3, 'Service', ['small', 'blue']), (4, 'Ambience', ['large'])) v(entry_id, aspect, keywords)),
i AS (SELECT p_partkey AS issue_id, CASE p_type WHEN 'MEDIUM' THEN 'Food' WHEN 'SMALL' THEN 'Service' ELSE 'Other' END AS aspect, p_name AS issue FROM part),
s AS (SELECT issue_id, entry_id, len(list_filter(keywords, lambda k: contains(lower(issue), k))) AS score FROM i JOIN b ON b.aspect = i.aspect OR i.aspect = 'Other')
SELECT issue_id, entry_id, score FROM s QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, entry_id) = 1""",
    "number_verification": "SELECT o_orderkey, CASE WHEN contains(o_orderkey || ' 99', '999') THEN '' ELSE '999' END AS unmatched FROM orders",
    "json_labels": "SELECT event_id, event_type || '|x' AS a, 'none' AS b FROM events",
    "consolidated_confidence": f"WITH {ASSERTIONS_SQL} SELECT aspect, count(*) AS n, round(sum(CASE WHEN ord_line <= 3 THEN 1.0 ELSE confidence END), 3) AS confidence FROM assertions GROUP BY 1",
    "windowed_counts": f"""WITH {UNITS_SQL} SELECT strftime(make_timestamp(CAST(floor(epoch(CAST(Review_Date AS TIMESTAMP)) / 2592000) AS BIGINT) * 2592000000000), '%Y-%m-%d %H:%M:%S') AS window_start, Restaurant, aspect, count(*) AS mentions,
  count(*) FILTER (sentiment = 'Positive') AS n_Positive, count(*) FILTER (sentiment = 'Negative') AS n_Negative, count(*) FILTER (sentiment = 'Neutral') AS n_Neutral FROM opinions GROUP BY 1, 2, 3""",
    "majority_baseline": f"""WITH {_L}, p AS (SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS BIGINT) % 10 AS part FROM l), m AS (SELECT label AS prediction FROM p WHERE part < 7 GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1)
SELECT label, prediction, count(*) AS n FROM p, m WHERE part >= 7 GROUP BY 1, 2""",
    "status_bands": f"{_H} SELECT CASE WHEN score >= 75 THEN 'Excellent' WHEN score >= 55 THEN 'Satisfactory' ELSE 'Critical Alert' END AS band, count(*) AS n FROM h GROUP BY 1",
    "nested_scorecards": f"""{_H} SELECT Restaurant, md5('[' || string_agg('{{"aspect":"' || aspect || '","status":"' || status || '","total_mentions":' || total_mentions || '}}', ',' ORDER BY aspect) || ']') AS document_md5 FROM h GROUP BY 1""",
    "report_verification": f"""{_H2}, weak AS (SELECT Restaurant, aspect, score, neg_mentions FROM h QUALIFY row_number() OVER (PARTITION BY Restaurant ORDER BY score, aspect) = 1)
SELECT Restaurant, printf('%s has a health index of %.1f from %d reviews. Its weakest aspect is %s at %.1f, with %d negative mentions. The average rating is %s.', Restaurant, Overall_Health, Total_Reviews, aspect, score, neg_mentions, CAST(Average_Stars AS VARCHAR)) AS report,
  true AS verification_passed FROM wide JOIN weak USING (Restaurant)""",
    "payload_entries": f"""{_H2}, b AS (SELECT * FROM (VALUES (1, 'Food', ['red', 'ring']), (2, 'Food', ['widget']), (3, 'Service', ['small', 'blue']), (4, 'Ambience', ['large'])) v(entry_id, aspect, keywords)),
r AS (SELECT Restaurant, aspect, row_number() OVER (PARTITION BY Restaurant ORDER BY score, aspect) AS rn FROM h),
q AS (SELECT Restaurant, aspect, rn, CASE rn WHEN 1 THEN 'widget ring' ELSE 'blue' END AS issue FROM r WHERE rn <= 2),
e AS (SELECT Restaurant, rn, entry_id FROM q JOIN b ON b.aspect = q.aspect OR q.aspect NOT IN (SELECT aspect FROM b)
  QUALIFY row_number() OVER (PARTITION BY Restaurant, rn ORDER BY len(list_filter(keywords, lambda k: contains(issue, k))) DESC, entry_id) = 1)
SELECT Restaurant, max(aspect) FILTER (rn = 1) AS weakest, max(aspect) FILTER (rn = 2) AS second_weakest, 'Widget Ring|Blue' AS causes, string_agg(CAST(entry_id AS VARCHAR), '|' ORDER BY rn) AS entries FROM q JOIN e USING (Restaurant, rn) GROUP BY 1""",
}
