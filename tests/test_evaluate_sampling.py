import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mintleaf.functions.numbers import softmax
from mintleaf.operators import evaluate, ml, quality, sampling
from mintleaf.sources import io
from mintleaf.streaming.monthly import windowed_counts


def test_set_metrics_of_empty_sets(spark):
    sets = spark.createDataFrame([("1", [], []), ("2", ["Food"], []), ("3", ["Food", "Service"], ["Food"])], "clause_id string, reference array<string>, predicted array<string>")
    r = evaluate.set_metrics(sets).first()
    assert r["exact_match"] == pytest.approx(0.3333) and r["jaccard"] == 0.5 and r["hamming_loss"] == pytest.approx(2 / 15, abs=1e-4)
    m = {x["Category"]: x for x in evaluate.multilabel_report(sets).collect()}
    assert (m["Food"]["TP"], m["Food"]["FN"], m["No Aspect Opinion"]["FP"]) == (1, 1, 1) and m["Ambience"]["F1"] == 0.0


def test_reports_agree_with_hand_counts(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "y int, p int")
    r = {x["label"]: x for x in evaluate.classification_report(rows).collect()}
    assert r["accuracy"]["F1"] == 0.6 and r["1"]["Recall"] == 1.0 and r["2"]["F1"] == 0.0 and r["macro avg"]["Support"] == 5
    assert sum(x["n"] for x in evaluate.confusion(rows).collect()) == 5
    assert evaluate.chi_square_p(30.57) == pytest.approx(3.2e-8, rel=0.02)


def test_mcnemar_table(spark):
    rows = [(1, 1, 1)] * 4 + [(1, 1, 0)] * 14 + [(1, 0, 1)] * 6 + [(1, 0, 0)] * 2
    t = evaluate.mcnemar(spark.createDataFrame(rows, "y int, a int, b int"), "y", "a", "b").first()
    assert (t["both_right"], t["only_a"], t["only_b"], t["both_wrong"]) == (4, 14, 6, 2) and t["chi_square"] == pytest.approx(49 / 20)


def test_bootstrap_covers_the_point(spark):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 2).alias("y"), F.when(F.col("id") % 10 == 0, 1 - F.col("id") % 2).otherwise(F.col("id") % 2).alias("a"), (F.col("id") % 3 % 2).alias("b"))
    r = evaluate.bootstrap_macro_f1(rows, "id", "y", "a", "b", [0, 1], 100).first()
    assert r["low"] < r["median"] < r["high"] and 0.85 < r["median"] < 0.95 and r["lead_low"] > 0


def test_split_is_disjoint_and_sized(spark):
    rows = spark.range(1000).select((F.col("id") % 500).cast("string").alias("g"), F.when(F.col("id") % 500 < 300, "a").otherwise("b").alias("l"))
    s = sampling.group_split(rows, "g", "l")
    assert s.count() == 500 and s.select("g").distinct().count() == 500
    counts = {(r["l"], r["split"]): r["count"] for r in s.groupBy("l", "split").count().collect()}
    assert counts == {("a", "train"): 210, ("a", "validation"): 45, ("a", "test"): 45, ("b", "train"): 140, ("b", "validation"): 30, ("b", "test"): 30}
    joined = rows.join(s.select("g", "split"), "g")
    assert sampling.leakage(joined, ["g"]).first()["n"] == 0


def test_overrides_need_their_precondition(spark):
    rows = spark.createDataFrame([("1", "Food"), ("2", "Food"), ("3", "Food")], "k string, aspect string")
    o = spark.createDataFrame([("1", "Food", "Service"), ("2", "Price", "Service")], "k string, expected string, new string")
    got = {r["k"]: (r["aspect"], r["change_note"]) for r in quality.apply_overrides(rows, o, "k", "aspect").collect()}
    assert got == {"1": ("Service", "aspect: Food -> Service"), "2": ("Food", None), "3": ("Food", None)}


def test_correction_is_logged(spark):
    rules = quality.Corrections(
        {"taste": "Food"}, (("music", "Ambience"),), opinions=((r"\bgood\b", "Food", "Positive"), (r"\brude\b", "Service", "Negative")), factual="^went", evaluating="tasty", narrative=r"\bordered\b", cues="cheap",
        contradictions=((None, "Positive", "not good", None, "Negative", "negation"), ("Ambience", None, "waiter", "Service", "Negative", "another aspect")),
    )
    cases = {  # text, aspect, sentiment, status, theme, rationale -> corrected aspect, sentiment, status, action
        "a": ("good soup", None, None, "No Aspect Opinion", None, None, "Food", "Positive", "Annotated", "changed"),
        "b": ("went there", "Food", None, "Annotated", None, None, None, None, "No Aspect Opinion", "changed"),
        "c": ("soup or not", "Food", None, "Annotated", None, None, "Food", None, "Annotated", "unresolved"),
        "d": ("not good", "Food", "Positive", "Annotated", None, None, "Food", "Negative", "Annotated", "changed"),
        "e": ("x", "Food", "Neutral", "Annotated", None, None, "Food", "Neutral", "Annotated", "unchanged"),
        "f": ("loud music", None, "Mixed", "No Aspect Opinion", "taste", None, "Ambience", "Neutral", "Annotated", "changed"),
        "g": ("fine", None, "Positive", "No Aspect Opinion", "taste", "on Service", "Food", "Positive", "Annotated", "changed"),
        "h": ("fine", None, "Positive", "No Aspect Opinion", None, "on Service", "Service", "Positive", "Annotated", "changed"),
        "i": ("fine", None, "Positive", "No Aspect Opinion", None, None, "General Experience", "Positive", "Annotated", "changed"),
        "j": ("rude lot", "Ambience", None, "Annotated", None, None, "Service", "Negative", "Annotated", "changed"),
        "k": ("ordered two", "Food", None, "Annotated", None, None, None, None, "No Aspect Opinion", "changed"),
        "l": ("ordered cheap", "Food", None, "Annotated", None, None, "Food", None, "Annotated", "unresolved"),
        "m": ("the waiter sang", "Ambience", "Positive", "Annotated", None, None, "Service", "Negative", "Annotated", "changed"),
        "n": (None, None, None, "No Aspect Opinion", None, None, None, None, "No Aspect Opinion", "unchanged"),
    }
    schema = "assertion_id string, clause_text string, aspect string, sentiment string, annotation_status string, theme string, rationale string"
    rows = spark.createDataFrame([(k, *v[:6]) for k, v in cases.items()], schema).withColumns({"clause_start_char": F.lit(0), "clause_end_char": F.length("clause_text")})
    done = quality.correct(rows, rules)
    got = {r["assertion_id"]: (r["corrected_aspect"], r["corrected_sentiment"], r["corrected_annotation_status"], r["action"]) for r in done.collect()}
    assert got == {k: v[6:] for k, v in cases.items()}
    assert all(v == 0 for v in quality.correction_invariants(rows, done).first())
    assert {r["assertion_id"] for r in quality.audit_log(done).collect()} == {k for k, v in cases.items() if v[9] != "unchanged"}


def test_queue_gate_and_resolutions(spark):
    rows = spark.createDataFrame([("a", "cold soup", "Needs Review", "soup", None), ("b", "x", "Needs Review", "", None), ("c", "y", "Annotated", "y", 0)], "assertion_id string, clause_text string, annotation_status string, target_text string, target_start_char int").withColumns({"opinion_text": F.lit(None).cast("string"), "opinion_start_char": F.lit(None).cast("int")})
    assert tuple(quality.gate(rows).first()) == (2, False) and tuple(quality.gate(rows.filter("assertion_id = 'c'")).first()) == (0, True)
    done = spark.createDataFrame([("a", "stew"), ("z", "")], "assertion_id string, target_text string")
    assert {tuple(r) for r in quality.resolution_errors(quality.review_queue(rows), done).collect()} == {("a", "span outside"), ("b", "unresolved"), ("z", "not queued")}
    assert [tuple(r) for r in quality.missing_offsets(rows).collect()] == [("a", "target", "soup", "cold soup")]
    left = spark.createDataFrame([("r", "1", "x "), ("r", "2", "y")], "review_id string, clause_id string, clause_text string")
    right = spark.createDataFrame([("r", "1", "x"), ("r", "3", "z")], "review_id string, clause_id string, clause_text string")
    assert tuple(quality.alignment_audit(left, right, ["review_id", "clause_id"]).first()) == (1, 1, 1, 0)


def test_annotations_meet_their_predictions(spark):
    a = spark.createDataFrame([("1", "x", 1), ("1", "y", 0), ("2", "z", 0)], "clause_id string, clause_text string, ord int")
    p = spark.createDataFrame([("1", ["Food", "Service"])], "clause_id string, predicted array<string>")
    got = {(r["clause_id"], r["clause_text"], r["predicted_label"]) for r in quality.with_predictions(a, p).collect()}
    assert got == {("1", "y", "Food"), ("1", "y", "Service"), ("2", "z", None)}


def test_holdout_groups_leave_the_training_rows(spark):
    rows = spark.range(300).select((F.col("id") % 30).cast("string").alias("g"), F.lit("own").alias("x"))
    bench = spark.range(20).select(F.col("id").cast("string").alias("g"), F.lit("bench").alias("x"))
    train, holdout = sampling.holdout_mix(rows, bench, "g")
    assert holdout.count() == 6 and train.filter("from_benchmark").count() == 14
    assert train.join(holdout.select("g").distinct(), "g").count() == 0 and train.filter("NOT from_benchmark").count() == 240


def test_softmax_and_wide_errors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 0.0, 0.0],)], "m array<double>").select(softmax(F.col("m")).alias("p")).collect()
    assert df[0]["p"] == pytest.approx([0.0900306, 0.2447285, 0.6652410]) and df[1]["p"] == pytest.approx([1.0, 0.0, 0.0])
    t = {n: spark.createDataFrame([("1", p, 0.5)], "k string, prediction double, confidence double") for n, p in (("a", 1.0), ("b", 2.0))}
    assert ml.wide_errors(t, ["k"]).first().asDict() == {"k": "1", "pred_a": 1.0, "conf_a": 0.5, "pred_b": 2.0, "conf_b": 0.5}


def test_projected_labels_inherit(spark):
    sets = spark.createDataFrame([("1", ["Food", "Service"])], "clause_id string, predicted array<string>")
    own = spark.createDataFrame([("1", "Food", 1, "taste", "Positive"), ("1", "Price", 0, "cost", "Negative")], "clause_id string, aspect string, ord int, theme string, sentiment string")
    got = {r["aspect"]: (r["assertion_id"], r["theme"], r["inherited"]) for r in quality.project_labels(sets, own).collect()}
    assert got == {"Food": ("1_A01", "taste", False), "Service": ("1_A02", "cost", True)}
    none = quality.project_labels(spark.createDataFrame([("1", [])], sets.schema), own).first()
    assert (none["assertion_id"], none["aspect"], none["annotation_status"], none["theme"]) == ("1_A01", None, "No Aspect Opinion", "cost")


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("X", "P", 'He said "no",\nthen left', "NA"), ("Y", None, "é", "")], "Restaurant string, Reviewer string, Review string, Rating string")
    io.write_csv(rows, str(tmp_path / "c"))
    back = io.read_verbatim_csv(spark, str(tmp_path / "c"), rows.columns)
    assert {tuple(r) for r in back.collect()} == {("X", "P", 'He said "no",\nthen left', "NA"), ("Y", "", "é", "")}
    io.write_jsonl(spark.createDataFrame([(1.0, None), (float("nan"), "é")], "a double, b string").coalesce(1), str(tmp_path / "j"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":1.0,"b":null}', '{"a":null,"b":"é"}']
    io.write_parquet(rows, str(tmp_path / "p"), ["Restaurant"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    raw = spark.createDataFrame([("X", "P", 'a "b",\nc', "Like", None, None, 3)], io.RAW_REVIEW)
    io.write_csv(raw, str(tmp_path / "r"))
    assert [tuple(r) for r in io.read_reviews_csv(spark, str(tmp_path / "r")).collect()] == [("X", "P", 'a "b",\nc', "Like", None, None, 3)]
    t = io.verification_template(rows, ["Restaurant"]).first()
    assert (t["reviewer"], t["verification_status"]) == ("", "pending")


def test_model_is_reloaded_unchanged(spark, tmp_path):
    rows = spark.createDataFrame([(k, "good nice soup" if k % 2 else "bad cold soup", float(k % 2), 1.0) for k in range(40)], "id int, text string, label double, weight double")
    best, found = ml.grid_search(rows, rows, {"lr": ml.classifiers()["logistic regression"]})
    assert best == "lr" and found[0][1] == 1.0
    model = ml.fit(rows, ml.classifiers()["logistic regression"])
    assert ml.saved_and_reloaded(model, rows, str(tmp_path / "m"), "id") == 0
    s = ml.scored(model.transform(rows), ["Negative", "Positive"]).filter("id = 1").first()
    assert s["sentiment"] == "Positive" and s["polarity_score"] > 0


def test_every_family_learns_and_is_ranked(spark):
    words = {0.0: "bad cold stale", 1.0: "fine plain usual", 2.0: "good fresh tasty"}
    rows = spark.createDataFrame([(k, words[float(k % 3)] + (" soup" if k % 2 else ""), float(k % 3)) for k in range(60)], "id int, text string, label double")
    train = ml.class_weights(rows)
    reports = {n: evaluate.classification_report(ml.fit(train, c, vocabulary=50).transform(rows), "label", "prediction") for n, c in ml.classifiers().items()}
    board = ml.leaderboard(reports).collect()
    assert [r["model"] for r in board] == sorted(reports) and all(r["macro_f1"] == r["accuracy"] == 1.0 for r in board)


def test_features_are_sublinear_and_smooth(spark):
    import math

    rows = spark.createDataFrame([("aa aa aa bb",), ("aa cc",), ("bb cc",)], "text string")
    from pyspark.ml import Pipeline

    model = Pipeline(stages=ml.tfidf_stages(vocabulary=10, min_df=2)).fit(rows)
    v, names = model.transform(rows).first()["features"], model.stages[3].vocabulary
    idf = math.log(4 / 3) + 1
    want = {"aa": (1 + math.log(3)) * idf, "bb": idf}
    norm = math.sqrt(sum(x * x for x in want.values()))
    assert {names[i]: x for i, x in zip(v.indices.tolist(), v.values.tolist(), strict=True)} == pytest.approx({k: x / norm for k, x in want.items()})


def test_a_model_of_the_user_scores_texts(spark):
    import numpy as np

    score = ml.user_scorer(lambda: lambda texts: np.array([[t.count("bad"), 0, t.count("good")] for t in texts]), ["Negative", "Neutral", "Positive"], 2)
    rows = spark.createDataFrame([(1, "good good"), (2, "bad"), (3, None)], "id int, text string").select("id", score("text").alias("s")).collect()
    got = {r["id"]: r["s"] for r in rows}
    assert [got[k]["sentiment"] for k in (1, 2, 3)] == ["Positive", "Negative", "Negative"] and got[3]["confidence"] == 0.333
    assert got[1]["probs"]["Positive"] == got[1]["confidence"] == 0.787 and got[1]["polarity_score"] == round(0.787 - 0.106, 2) + 0.0 or got[1]["polarity_score"] == pytest.approx(0.68, abs=2e-3)


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime

    schema = "Restaurant string, aspect string, sentiment string, annotation_status string, Review_Date timestamp"
    rows = spark.createDataFrame([("X", "Food", s, "Annotated", datetime(2024, 1, d)) for s, d in (("Positive", 2), ("Negative", 3), ("Positive", 20))], schema)
    rows.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windowed_counts(rows).collect()))


def test_every_row_stays_one_row_under_overrides(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "y")], "k string, v string")
    o = spark.createDataFrame([("a", "x", "p"), ("a", "x", "o"), ("a", None, "any"), ("b", "z", "p"), ("b", None, "any"), ("b", None, "zz"), ("c", None, "n"), ("d", "x", "p"), ("e", None, "p")], "k string, expected string, new string")
    assert sorted((r["k"], r["v"]) for r in quality.apply_overrides(rows, o, "k", "v").collect()) == [("a", "o"), ("b", "any"), ("c", "n"), ("d", "y")]


def test_a_queued_row_without_text_is_queued(spark):
    queue = spark.createDataFrame([("a", None), ("b", None), ("c", "soup")], "assertion_id string, clause_text string")
    done = spark.createDataFrame([("a", None), ("b", "soup"), ("c", "soup")], "assertion_id string, target_text string")
    assert [tuple(r) for r in quality.resolution_errors(queue, done).collect()] == [("b", "span outside")]


def _best(rows, columns, cells):
    """The most that whole numbers in the cells can take, by trying all."""
    best = 0
    for picks in itertools.product(*(range(n + 1) for n in cells.values())):
        sums = Counter()
        for (r, c), n in zip(cells, picks, strict=True):
            sums["r", r] += n
            sums["c", c] += n
        if all(sums["r", r] <= n for r, n in rows.items()) and all(sums["c", c] <= n for c, n in columns.items()):
            best = max(best, sum(picks))
    return best


def test_flow_over_margins():
    rng = random.Random(4)
    for _ in range(60):
        rows, columns = ({f"{s}{k}": rng.randrange(5) for k in range(2)} for s in "rc")
        cells = {(r, c): rng.randrange(4) for r in rows for c in columns if rng.random() < 0.9}
        taken = sampling._flow(rows, columns, cells)
        assert all(0 <= taken[k] <= n for k, n in cells.items()) and sum(taken.values()) == _best(rows, columns, cells)
        assert all(sum(n for k, n in taken.items() if k[0] == r) <= m for r, m in rows.items()) and all(sum(n for k, n in taken.items() if k[1] == c) <= m for c, m in columns.items())


def test_margin_sample(spark):
    rows = [(f"k{n}", "low" if n % 4 == 0 else "high", "short" if n % 3 else "long", f"e{n % 50}") for n in range(200)] + [("x", None, "short", "e99"), ("y", "other", "long", "e98")]
    df = spark.createDataFrame(rows, "id string, bin string, len string, place string")
    taken, report = sampling.margin_sample(df, {"bin": {"low": 5, "high": 12}, "len": {"short": 10, "long": 7}}, "id", once="place")
    got = taken.collect()
    assert len(got) == 17 == len({r["place"] for r in got}) and all(r["met"] for r in report.collect())
    assert Counter(r["bin"] for r in got) == {"low": 5, "high": 12} and Counter(r["len"] for r in got) == {"short": 10, "long": 7}
    taken, report = sampling.margin_sample(df.filter("bin = 'high' or len = 'long'"), {"bin": {"low": 5, "high": 12}, "len": {"short": 14, "long": 3}}, "id")
    found = {r["value"]: (r["quota"], r["taken"], r["met"]) for r in report.collect()}
    assert found == {"low": (5, 3, False), "high": (12, 12, True), "short": (14, 12, False), "long": (3, 3, True)}
    assert sampling.margin_sample(df.limit(0), {"bin": {"low": 1}, "len": {"short": 1}}, "id")[0].count() == 0


def test_damped_counts_and_shared_features(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, Vectors.sparse(6, [1, 4], [1.0, 5.0])), (2, Vectors.sparse(6, [], [])), (3, Vectors.sparse(6, [0], [2.0]))], ["id", "raw"])
    got = {r["id"]: r["tf"] for r in ml.Sublinear(inputCol="raw", outputCol="tf").transform(df).collect()}
    assert got[1] == Vectors.sparse(6, [1, 4], [1.0, 1 + math.log(5)]) and got[2].numNonzeros() == 0 and got[3].values[0] == pytest.approx(1 + math.log(2))
    rows = ml.class_weights(spark.createDataFrame([(f"{'good fine' if k % 2 else 'bad poor'} food w{k % 7}", float(k % 2)) for k in range(60)], "text string, label double"))
    models = ml.fit_all(rows, {n: c for n, c in ml.classifiers().items() if n in ("logistic regression", "boosted trees")})
    alone = ml.fit(rows, ml.classifiers()["logistic regression"])
    a, b = (sorted((r["text"], r["prediction"]) for r in m.transform(rows).collect()) for m in (models["logistic regression"], alone))
    assert a == b and ml.macro_f1(models["boosted trees"].transform(rows)) == 1.0
    best, found = ml.grid_search(rows, rows, {n: ml.classifiers()["logistic regression"].copy({}) for n in "abcd"})
    assert best == "a" and len(found) == 4


def test_validator_keeps_rows_dealt_out_by_id_in_place(spark):
    """Copies are counted without another exchange of rows that lie together by their id."""
    rows = [("a", "r1", "good", "Food", "Positive", "Annotated", 0, 4)] * 3 + [(None, "r1", "good", "Food", "Positive", "Annotated", 0, 4)] * 2
    df = spark.createDataFrame(rows, "assertion_id string, review_id string, clause_text string, aspect string, sentiment string, annotation_status string, clause_start_char int, clause_end_char int")
    texts = spark.createDataFrame([("r1", "good")], "review_id string, Review string")
    assert [tuple(r) for r in quality.validate(df, texts).collect()] == [("a", "duplicate id", "1", "3")] * 3
    plan = quality.validate(df.repartition("assertion_id"), F.broadcast(texts))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(assertion_id") == 1


def test_features_lie_in_partitions_of_few_rows(spark, monkeypatch):
    """However few splits the texts have, what a model is fitted on is dealt out by its rows, without the texts."""
    seen = []

    class Probe:
        def fit(self, made):
            seen.append((made.rdd.getNumPartitions(), "text" in made.columns, made.count()))
            return ml.LogisticRegression(maxIter=1).fit(made)

    monkeypatch.setattr(ml, "_ROWS", 10)
    train = spark.createDataFrame([(float(k % 2), f"good soup {k % 3}" if k % 2 else f"bad tea {k % 3}") for k in range(95)], "label double, text string").coalesce(1)
    model = ml.fit_all(train, {"m": Probe()})["m"]
    assert seen == [(10, False, 95)] and model.transform(train).filter("label = prediction").count() == 95


def test_vocabulary_is_that_of_a_count_vectorizer(spark):
    """By counts of words in rows enough; ties, which a CountVectorizer leaves open, go by word."""
    from pyspark.ml.feature import CountVectorizer

    df = spark.createDataFrame([(["a"] * 9 + ["b", "c", "c"],), (["b", "b", "b", "d", "c"],), (["e", "d", "b", "f"],), ([],)], "ws array<string>").repartition(3)
    for least in (1, 2, 0.5, 0.75):
        options = {"inputCol": "ws", "outputCol": "v", "minDF": least}
        mine, spark_own = ml.Vocabulary(**options).fit(df), CountVectorizer(**options).fit(df)
        assert sorted(mine.vocabulary) == sorted(spark_own.vocabulary), least
    assert ml.Vocabulary(inputCol="ws", outputCol="v").fit(df).vocabulary == ["a", "b", "c", "d", "e", "f"]
    top = ml.Vocabulary(inputCol="ws", outputCol="v", vocabSize=2, minDF=2).fit(df)
    assert top.vocabulary == ["b", "c"] and sorted(r["v"].toArray().tolist() for r in top.transform(df).collect()) == [[0, 0], [1, 0], [1, 2], [3, 1]]
    with pytest.raises(ValueError, match="minDF"):
        ml.Vocabulary(inputCol="ws", outputCol="v", minDF=5).fit(df)


def test_two_labels_need_one_binary_model(spark):
    """Of the labels 0 and 1 no mirrored model is trained, and predictions are those of one-vs-rest."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    words = ["good", "fine", "bad", "poor", "soup", "tea"]
    rows = [(" ".join(words[(k * s + s) % 6] for s in (1, 2, 3, 5)), float(k % 3 == 0)) for k in range(60)]
    train = ml.class_weights(spark.createDataFrame(rows, "text string, label double")).withColumn("k", F.monotonically_increasing_id())
    family = OneVsRest(classifier=LinearSVC(maxIter=5, regParam=0.01), weightCol="weight")
    model = ml.fit_all(train, {"svm": family}, vocabulary=20)["svm"]
    assert type(model.stages[-1]).__name__ == "LinearSVCModel"
    made = type(model)(model.stages[:-1]).transform(train).persist()
    plain = family.fit(made)
    a, b = (sorted((r["k"], r["prediction"]) for r in m.transform(made).collect()) for m in (plain, model.stages[-1]))
    assert a == b and {p for _, p in a} == {0.0, 1.0}
    three = spark.createDataFrame([(w, float(k % 3)) for k, w in enumerate(words * 4)], "text string, label double")
    assert len(ml.fit_all(ml.class_weights(three), {"svm": family}, vocabulary=20)["svm"].stages[-1].models) == 3


def test_reports_of_models_from_one_pass(spark):
    """The reports are those of each model's predictions, and read counts only."""
    rows = spark.createDataFrame([(f"{'good fine' if k % 3 else 'bad poor'} food w{k % 7}", float(k % 2)) for k in range(60)], "text string, label double")
    lr = lambda n: ml.LogisticRegression(maxIter=n, regParam=0.01)
    models = ml.fit_all(rows, {"one": lr(1), "two": lr(5)}, vocabulary=20)
    got = ml.reports(models, rows)
    for name, m in models.items():
        want = evaluate.classification_report(m.transform(rows), "label", "prediction")
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, want.collect())) and got[name].dtypes == want.dtypes
        assert "UDF" not in got[name]._jdf.queryExecution().optimizedPlan().toString()
