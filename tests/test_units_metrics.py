import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mintleaf.operators import bayes, clean, health, metrics, units
from mintleaf.schemas import NO_OPINION

A = "review_id string, aspect string, sentiment string, annotation_status string, Restaurant string, star_rating double, Review_Date timestamp, YearMonth string, Reviewer string, clause_text string, o int"


def assertions(spark, rows):
    return spark.createDataFrame([(r, a, s, st, "X", 4.0, datetime(2024, 1, 1), ym, "P", "c", k) for k, (r, a, s, st, ym) in enumerate(rows)], A)


@pytest.mark.parametrize(("seen", "want"), [
    (["Positive", "Negative"], "Mixed"), (["Positive", "Negative", "Neutral"], "Mixed"), (["Positive", "Neutral"], "Positive"), (["Negative", "Neutral"], "Negative"), (["Neutral"], "Neutral"), (["odd"], NO_OPINION), ([None], NO_OPINION),
])
def test_conflict_rule(spark, seen, want):
    df = spark.createDataFrame([(s,) for s in seen], "sentiment string")
    assert df.agg(units.resolve_sentiment(F.col("sentiment")).alias("r")).first()["r"] == want


def test_units_exclude_no_opinion_and_merge_mentions(spark):
    df = assertions(spark, [
        ("r1", "Food", "Positive", "Annotated", "2024-01"), ("r1", "Food", "Negative", "Annotated", "2024-01"), ("r1", "Service", "Negative", "Annotated", "2024-01"),
        ("r2", "Food", "Neutral", NO_OPINION, "2024-01"), ("r2", "Nonsense", "Neutral", "Annotated", "2024-01"), ("r3", "Food", "Positive", None, None),
    ])
    got = {(r["review_id"], r["aspect"]): (r["sentiment"], r["clause_count"]) for r in units.review_aspect_units(df, ["o"]).collect()}
    assert got == {("r1", "Food"): ("Mixed", 2), ("r1", "Service"): ("Negative", 1), ("r3", "Food"): ("Positive", 1)}


def test_metrics_reconcile_and_list_all_aspects(spark):
    df = assertions(spark, [(f"r{k}", "Food", s, "Annotated", "2024-02") for k, s in enumerate(["Positive", "Negative", "Neutral"])])
    u = units.review_aspect_units(df, ["o"])
    reviews = spark.createDataFrame([(f"r{k}", "X") for k in range(4)], "review_id string, Restaurant string")
    rows = {r["Aspect"]: r for r in metrics.aspect_metrics(u, reviews).collect()}
    assert len(rows) == 5 and rows["Food"]["Mention_Rate_Pct"] == 75.0 and rows["Service"]["Mention_Count"] == 0 and rows["Service"]["Positive_Pct"] == 0.0
    assert sum(rows["Food"][f"{s}_Count"] for s in ("Positive", "Negative", "Neutral", "Mixed")) == rows["Food"]["Mention_Count"]


def test_trends_drop_bad_months_and_flag_small_samples(spark):
    df = assertions(spark, [("r1", "Food", "Positive", "Annotated", "2024-02"), ("r2", "Food", "Positive", "Annotated", None), ("r3", "Food", "Positive", "Annotated", "bad")])
    rows = metrics.monthly_trends(units.review_aspect_units(df, ["o"])).collect()
    assert [(r["YearMonth"], r["Sample_Size"], r["Small_Sample_Warning"]) for r in rows] == [("2024-02", 1, True)]


def test_peers_come_in_order_and_zero_filled(spark):
    df = assertions(spark, [("r1", "Food", "Positive", "Annotated", "2024-02")])
    rows = metrics.peer_comparison(units.review_aspect_units(df, ["o"]), "Food", "X", ["Z", "X", "Y"]).collect()
    assert [(r["Restaurant"], r["Role"], r["Mention_Count"]) for r in rows] == [("X", "Target", 1), ("Z", "Peer", 0), ("Y", "Peer", 0)]


def test_smoothing_lies_between_prior_and_rate(spark):
    rows = [(f"e{e}-{k}", "Food", "Negative" if k < 2 else "Positive", "Annotated", "2024-01") for e in range(4) for k in range(10)] + [("lone", "Food", "Negative", "Annotated", "2024-01")]
    df = assertions(spark, rows).withColumn("Restaurant", F.when(F.col("review_id") == "lone", "L").otherwise(F.substring("review_id", 1, 2)))
    u = units.review_aspect_units(df, ["o"])
    priors = bayes.beta_priors(u)
    assert {r["aspect"]: r["prior_mean"] for r in priors.collect()}["Food"] == pytest.approx(0.2)
    m = bayes.smoothed(metrics.aspect_metrics(u, None, ["Restaurant"]), priors).filter("Restaurant = 'L' AND Aspect = 'Food'").first()
    assert 20.0 < m["Negative_Smoothed_Pct"] < 100.0


@pytest.mark.parametrize(("pos", "neg", "neu", "low", "high"), [(0, 0, 0, 60, 75), (100, 0, 0, 90, 100), (0, 100, 0, 0, 10)])
def test_health_bounds(spark, pos, neg, neu, low, high):
    got = spark.range(1).select(health.health_score(F.lit(pos), F.lit(neg), F.lit(neu)).alias("s")).first()["s"]
    assert low <= got <= high


def test_decay_favours_recent_reviews(spark):
    dates = [datetime(2023, 1, 1), datetime(2023, 1, 2), datetime(2024, 1, 1), None]
    reviews = spark.createDataFrame([(f"r{k}", "X", 3.0, d, "P") for k, d in enumerate(dates)], "review_id string, Restaurant string, star_rating double, Review_Date timestamp, Reviewer string")
    weights = {r["review_id"]: r["weight"] for r in health.recency_weights(reviews, 90.0, ["review_id"]).collect()}
    assert weights["r2"] == 1.0 and weights["r0"] < weights["r1"] < 0.1 and weights["r0"] <= weights["r3"] <= weights["r2"]
    none = health.recency_weights(reviews.withColumn("Review_Date", F.lit(None).cast("timestamp")), 1.0, ["review_id"])
    assert [round(r["weight"], 4) for r in none.orderBy("review_id").collect()] == [1.0, 0.5, 0.25, 0.125]


def test_spearman_p():
    assert health.spearman_p(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    assert health.spearman_p(0.9, 20) == pytest.approx(6.5743e-8, rel=1e-4)


def test_scope_takes_bounds_in_any_order(spark):
    rows = spark.createDataFrame([("X", datetime(2024, 1, 5, 23)), ("X", datetime(2024, 1, 6)), ("X", None)], "Restaurant string, Review_Date timestamp")
    assert metrics.scoped(rows, "X", "2024-01-05", "2024-01-01").count() == 1


def test_clean_reviews(spark):
    rows = [("R", None, " good food ", "4", 1), ("R", "B", "good food", "5", 2), ("R", "C", "bad", "1", 3), ("R", "D", "some text", "Like", 4), ("R", "E", None, "3", 5), (None, "F", "more text", "3", 6), ("R", " ", "more text", "x", 7)]
    got = clean.clean_reviews(spark.createDataFrame(rows, "Restaurant string, Reviewer string, Review string, Rating string, o int"), ["o"]).collect()
    assert [(r["Reviewer"], r["Review"], r["Rating"], r["Sentiment"], r["Label"], r["Word_Count"]) for r in got] == [("Anonymous", "good food", 4.0, "Positive", 2, 2)]


def test_backfill_only_if_most_dates_miss(spark):
    raw = spark.createDataFrame([("a", datetime(2024, 3, 1), "P"), ("b", datetime(2024, 3, 2), "Q")], "review_id string, Review_Date timestamp, Reviewer string")
    rows = spark.createDataFrame([("a", None, None), ("b", None, "K")], "review_id string, Review_Date timestamp, Reviewer string")
    got = {r["review_id"]: (r["YearMonth"], r["Reviewer"]) for r in clean.backfill_dates(rows, raw).collect()}
    assert got == {"a": ("2024-03", "P"), "b": ("2024-03", "K")}


def test_ids_number_every_wide_row_behind_a_shuffle(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    try:
        n = 30_000
        wide = spark.range(n).select(F.col("id").alias("k"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda x: F.sha2((F.col("id") * 41 + x).cast("string"), 256)), "").alias("payload")).repartition(32)
        got = clean.with_review_ids(wide, ["k"]).select("k", "original_row_id", "review_id", F.length("payload").alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted((r["k"], r["original_row_id"]) for r in got) == [(k, k) for k in range(n)] and all(r["p"] == 41 * 64 for r in got)
    assert {r["review_id"] for r in got if r["k"] in (0, 29_999)} == {"REV_00001", "REV_30000"}


def test_rollup_tells_a_null_entity_from_the_total(spark):
    df = assertions(spark, [("r1", "Food", "Positive", "Annotated", "2024-02"), ("r2", "Food", "Negative", "Annotated", "2024-02")])
    u = units.review_aspect_units(df, ["o"]).withColumn("Restaurant", F.when(F.col("review_id") == "r1", "X"))
    got = {(r["Restaurant"], r["Is_Total"]): r["Mention_Count"] for r in metrics.aspect_metrics_rollup(u).collect()}
    assert got == {("X", False): 1, (None, False): 1, ("All", True): 2}
    assert {r["Mention_Count"] for r in metrics.aspect_metrics_rollup(u, rsd=0.01).collect()} == {1, 2}


def test_spearman_and_ranks_with_ties(spark):
    cards = spark.createDataFrame([("a", 90.0, 4.5), ("b", 80.0, 4.0), ("c", 80.0, 4.0), ("d", 70.0, 3.0), ("e", 60.0, 3.5)], "Restaurant string, Overall_Health double, Average_Stars double")
    assert {r["Restaurant"]: r["rank"] for r in health.leaderboard(cards).collect()} == {"a": 1, "b": 2, "c": 2, "d": 4, "e": 5}
    r = health.spearman(cards).first()
    assert r["n"] == 5 and r["rho"] == pytest.approx(0.894737, abs=1e-6) and r["p_value"] == pytest.approx(0.0405, abs=1e-3) and r["significant"]


def test_lenient_dates(spark):
    rows = spark.createDataFrame([("2024-01-05 10:00:00",), ("2024-02-05",), ("3/7/2024 9:30",), ("4/7/2024",), ("soon",), (None,)], "t string")
    assert [r["m"] for r in rows.select(clean.year_month(clean.parse_dates(F.col("t"))).alias("m")).collect()] == ["2024-01", "2024-02", "2024-03", "2024-04", None, None]


def test_spearman_of_equal_values_is_undefined(spark, monkeypatch):
    from mintleaf.plans import q_analytics

    cards = spark.createDataFrame([(f"r{k}", 50.0 + k, 3.0) for k in range(25)], "Restaurant string, Overall_Health double, Average_Stars double")
    r = health.spearman(cards).first()
    assert r["n"] == 25 and math.isnan(r["rho"]) and math.isnan(r["p_value"]) and r["significant"] is False
    assert health.spearman(cards.filter("false")).first()["n"] == 0
    monkeypatch.setattr(q_analytics, "_cards", lambda s, d: cards)
    assert q_analytics.QUERIES["spearman_validation"](spark, "").first()["significant"] is True  # as its SQL: NaN is the largest number


def test_training_summary_deals_ids_out_before_it_counts(spark):
    rows = [("r1", "c1", "Food", "Positive"), ("r1", "c1", "Food", "Positive"), ("r1", "c1", "Service", "Negative"), ("r2", "c2", "Food", "Positive"), ("r2", None, "Food", "Positive"), ("r3", "c3", "Other", "Positive"), (None, "c4", "Service", None)]
    df = spark.createDataFrame(rows, "review_id string, clause_id string, aspect string, sentiment string")
    out = metrics.training_summary(df)
    got = {(r["aspect"], r["sentiment"]): (r["n"], r["clauses"], r["reviews"]) for r in out.collect()}
    assert len(got) == 16 and {k: v for k, v in got.items() if v[0]} == {("Food", "Positive"): (4, 2, 2), ("Service", "Negative"): (1, 1, 1), ("TOTAL", "TOTAL"): (5, 2, 2)}
    assert {tuple(r)[2:] for r in metrics.training_summary(df.filter("false")).collect()} == {(0, 0, 0)}
    assert "count(distinct" not in out._jdf.queryExecution().analyzed().toString()
