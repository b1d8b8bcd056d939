"""Queries over predictions and label sets, splits, samples and annotation quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from mintleaf.operators import assertions as asr
from mintleaf.operators import clean, evaluate, quality, sampling, units
from mintleaf.plans.fixtures import ASSERTIONS_SQL, PREDICTIONS_SQL, SETS_SQL, UNITS_SQL, assertions, label_sets, pct_sql, predictions, reviews, table

CATEGORIES = ("Food", "Service", "Price / Value", "Ambience", "General Experience")
RULES = quality.Corrections(
    theme_aspects={"taste": "Food", "staff": "Service", "cost": "Price / Value"},
    overrides=(("widget", "Ambience"),),
    default_aspect="General Experience",
    opinions=(("red", "Food", "Positive"), ("blue", "Service", "Negative"), ("small", "Price / Value", "Neutral")),
    factual="^hot", evaluating="ring", narrative="large|bolt", cues="green|cold",
    contradictions=((None, "Positive", "blue", None, "Negative", "negative words"), (None, "Negative", "not bad", None, "Neutral", "mild words"), ("Food", None, "cold", "Ambience", "Negative", "another aspect")),
)


def _rows(spark, d):
    """Annotations with gaps: aspects and sentiments go missing on some lines."""
    return _all_rows(spark, d).dropDuplicates(["assertion_id"])


def _all_rows(spark, d):
    a = assertions(spark, d).filter(F.col("ord_line").isNotNull())
    key = F.concat_ws("_", "clause_id", F.col("ord_part").cast("string"), F.col("ord_supp").cast("string"), F.col("ord_price").cast("string"))
    return a.select(
        key.alias("assertion_id"), "review_id", "clause_id", "clause_text", F.when(F.col("aspect") != "Other", F.col("aspect")).alias("aspect"), F.when(F.col("ord_part") % 13 != 0, F.col("sentiment")).alias("sentiment"),
        "annotation_status", F.when(F.col("ord_supp") % 3 == 0, "taste").when(F.col("ord_supp") % 3 == 1, "staff").alias("theme"), F.lit(0).alias("clause_start_char"), F.length("clause_text").alias("clause_end_char"), "ord_part",
    )


def _corrected(spark, d):
    return quality.correct(_rows(spark, d), RULES)


def _validator(spark, d):
    rows = _rows(spark, d).withColumn("annotation_status", F.when(F.col("ord_part") % 17 == 0, "Done").otherwise(F.col("annotation_status")))
    # the last text is the same with and without copies of rows, which needn't be dropped for it
    texts = _all_rows(spark, d).select("review_id", "clause_text").groupBy("review_id").agg(F.max("clause_text").alias("Review")).filter("review_id NOT LIKE '%7'")
    return quality.validate(rows, texts).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("expected").alias("least_expected"), F.max("actual").alias("most_actual"))


#: Words that occur in the driver's texts, in place of those of restaurants.
GOLD = {"Service": ["en", "der"], "Price": ["ou"], "Ambience": ["ñ", "ß"], "Food": ["a"]}
GOLD_POSITIVE, GOLD_NEGATIVE = ["e", "an", "th"], ["i", "on", "ch"]


def _star_clauses(spark, d):
    t = table(spark, d, "conversations")
    return t.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("clause_id"), F.col("text").alias("clause_text"), (1 + F.col("conv_id") % 5).cast("double").alias("star_rating"))


def _holdout(spark, d):
    """How many rows of each source a training set has, of which holdout groups are gone, and the holdout's own."""
    r = reviews(spark, d).select("review_id", "Reviewer", "Restaurant")
    bench = r.filter("Restaurant IN ('NATION_3', 'NATION_4')")
    train, holdout = sampling.holdout_mix(r.filter("Restaurant != 'NATION_3'"), bench, "Reviewer")
    counted = train.groupBy("from_benchmark").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("Reviewer").alias("reviewers"))
    return counted.unionByName(holdout.agg(F.lit(None).cast("boolean").alias("from_benchmark"), F.count(F.lit(1)).alias("n"), F.countDistinct("Reviewer").alias("reviewers")))


def _split(spark, d):
    return sampling.group_split(assertions(spark, d).filter("sentiment IS NOT NULL"), "review_id", "sentiment")


def _split_rows(spark, d):
    return assertions(spark, d).filter("sentiment IS NOT NULL").join(_split(spark, d).select("review_id", "split"), "review_id")


def _quota(spark, d):
    rows = reviews(spark, d).withColumn("bin", clean.rating_bin(F.col("star_rating")))
    quotas = spark.createDataFrame([("low", 25), ("mid", 25), ("high", 50)], "bin string, quota int")
    return sampling.quota_sample(rows, quotas, ["bin"], "review_id")


QUERIES = {
    "multilabel_report": lambda s, d: evaluate.multilabel_report(label_sets(s, d)),
    "set_metrics": lambda s, d: evaluate.set_metrics(label_sets(s, d)),
    "cooccurrence_matrix": lambda s, d: evaluate.cooccurrence(label_sets(s, d)),
    "error_examples": lambda s, d: evaluate.error_examples(label_sets(s, d)),
    "no_aspect_audit": lambda s, d: evaluate.no_aspect_audit(label_sets(s, d)),
    "no_aspect_breakdown": lambda s, d: evaluate.no_aspect_breakdown(label_sets(s, d)),
    "contingency_tables": lambda s, d: evaluate.contingency(label_sets(s, d)),
    "subset_metrics": lambda s, d: evaluate.subset_metrics(label_sets(s, d)),
    "change_classes": lambda s, d: quality.change_classes(label_sets(s, d)),
    "label_changes": lambda s, d: quality.label_changes(label_sets(s, d)),
    "confusion_matrix": lambda s, d: evaluate.confusion(predictions(s, d)),
    "confusion_f1": lambda s, d: evaluate.classification_report(predictions(s, d)),
    "cohen_kappa": lambda s, d: evaluate.cohen_kappa(predictions(s, d), "y", "p"),
    "mcnemar": lambda s, d: evaluate.mcnemar(predictions(s, d), "y", "p", "p2"),
    "ece": lambda s, d: evaluate.expected_calibration_error(predictions(s, d), "conf", F.col("y") == F.col("p")),
    "disagreement_slices": lambda s, d: evaluate.disagreements(predictions(s, d), "y", "p", "p2").groupBy("slice").agg(F.count(F.lit(1)).alias("n")),
    "bootstrap_ci": lambda s, d: evaluate.bootstrap_macro_f1(predictions(s, d), "vec_id", "y", "p", "p2", list(range(10))),
    "binary_label_report": lambda s, d: evaluate.classification_report(table(s, d, "labels"), "quality", "toxic"),
    "grouped_split": _split,
    "grouped_split_leakage": lambda s, d: sampling.leakage(_split_rows(s, d), ["review_id"]),
    "split_manifest": lambda s, d: sampling.split_manifest(_split_rows(s, d), "review_id", "sentiment").select("split", "groups", "rows", F.array_join(F.transform(F.map_entries("classes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|").alias("classes")),
    "split_ids": lambda s, d: sampling.split_ids(_split_rows(s, d), "review_id"),
    "holdout_mix": _holdout,
    "balanced_candidates": lambda s, d: sampling.balanced_candidates(_star_clauses(s, d), 20, 60, (4, 200)).select("clause_id", "star_rating"),
    "gold_labels": lambda s, d: sampling.gold_labels(_star_clauses(s, d), aspects=GOLD, positive=GOLD_POSITIVE, negative=GOLD_NEGATIVE).select("clause_id", "gold_aspect", "gold_sentiment"),
    "n_per_group": lambda s, d: sampling.n_per_group(reviews(s, d), ["Restaurant"], "review_id", 5).select("Restaurant", "review_id"),
    "quota_sample": lambda s, d: _quota(s, d)[0].select("review_id", "bin"),
    "quota_report": lambda s, d: _quota(s, d)[1],
    "dominant_label": lambda s, d: sampling.dominant_label(assertions(s, d).filter("sentiment IS NOT NULL"), "review_id", "sentiment"),
    "validator_errors": _validator,
    "correction_log": lambda s, d: quality.audit_log(_corrected(s, d)).select("assertion_id", "original_aspect", "original_sentiment", "corrected_aspect", "corrected_sentiment", "corrected_annotation_status", "action", "reason", "confidence"),
    "correction_invariants": lambda s, d: quality.correction_invariants(_rows(s, d), _corrected(s, d)),
    "correction_delta": lambda s, d: quality.distribution_delta(_rows(s, d).select("sentiment"), _corrected(s, d).select(F.col("corrected_sentiment").alias("sentiment")), "sentiment"),
    "suspect_scan": lambda s, d: quality.suspects(_rows(s, d), ["red", "ring", "widget", "small"]),
    "suspect_classes": lambda s, d: quality.classify_suspects(_rows(s, d), "red|blue|ring|old", {"Food": "widget", "Service": "bolt|gear"}, "plate", "old", "hot"),
    "review_gate": lambda s, d: quality.gate(_rows(s, d).withColumn("annotation_status", F.when(F.col("ord_part") % 19 == 0, "Needs Review").otherwise(F.col("annotation_status")))),
    "key_differences": lambda s, d: quality.key_differences(reviews(s, d).select("review_id"), assertions(s, d).select("review_id").filter("review_id NOT LIKE '%3'"), "review_id"),
    "incremental_intake": lambda s, d: reviews(s, d).join(assertions(s, d).select("review_id").distinct(), "review_id", "left_anti").select("review_id", "Restaurant"),
    "semi_join_reviews": lambda s, d: reviews(s, d).join(units.opinions(assertions(s, d)).filter("aspect = 'Ambience'").select("review_id"), "review_id", "left_semi").select("review_id", "star_rating"),
    "rule_status_counts": lambda s, d: asr.link_elaborations(assertions(s, d), ["ord_line", "ord_part", "ord_supp", "ord_price"], own_id="clause_id").groupBy("annotation_status").agg(F.count("elaboration_of").alias("linked"), F.count(F.lit(1)).alias("n")),
}

_S = f"WITH {SETS_SQL}"
_P = f"WITH {PREDICTIONS_SQL}"
_A = f"WITH {ASSERTIONS_SQL}"
_R4 = lambda x: f"round_even(10000 * ({x}), 0) / 10000"
_DIV = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _prf_sql(source: str, key: str, rounded: bool) -> str:
    r = _R4 if rounded else (lambda x: x)
    p, c = _DIV("TP", "(TP + FP)"), _DIV("TP", "(TP + FN)")
    return f"SELECT *, {r('pr')} AS Precision, {r('rc')} AS Recall, {r('CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END')} AS F1 FROM (SELECT *, {p} AS pr, {c} AS rc, TP + FN AS Support FROM {source})"


_ML = _S + ", cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS Category, count(*) FILTER (r AND p) AS TP, count(*) FILTER (NOT r AND p) AS FP, count(*) FILTER (r AND NOT p) AS FN, count(*) FILTER (NOT r AND NOT p) AS TN FROM (SELECT {a} AS r, {b} AS p FROM sets)"
    for c, a, b in [*((c, f"list_contains(reference, '{c}')", f"list_contains(predicted, '{c}')") for c in CATEGORIES), ("No Aspect Opinion", "len(reference) = 0", "len(predicted) = 0")]
) + f"), per AS ({_prf_sql('cells', 'Category', True)})"

_ROWS = """rows_ AS (
  SELECT DISTINCT concat_ws('_', clause_id, CAST(ord_part AS VARCHAR), CAST(ord_supp AS VARCHAR), CAST(ord_price AS VARCHAR)) AS assertion_id, review_id, clause_id, clause_text,
    CASE WHEN aspect <> 'Other' THEN aspect END AS aspect, CASE WHEN ord_part % 13 <> 0 THEN sentiment END AS sentiment, annotation_status,
    CASE ord_supp % 3 WHEN 0 THEN 'taste' WHEN 1 THEN 'staff' END AS theme FROM assertions)"""

_SPLIT = f"""{_A}, counted AS (SELECT review_id, sentiment, count(*) AS n FROM assertions WHERE sentiment IS NOT NULL GROUP BY 1, 2),
dom AS (SELECT review_id, sentiment FROM counted QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY n DESC, sentiment) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY md5(review_id || '|42'), review_id) AS rn, count(*) OVER (PARTITION BY sentiment) AS n FROM dom),
parts AS (SELECT review_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM placed)"""
_CLAUSES = "c AS (SELECT conv_id || '_' || turn AS clause_id, text AS clause_text, CAST(1 + conv_id % 5 AS DOUBLE) AS star_rating FROM conversations)"
_has = lambda words: "(" + " + ".join(f"CASE WHEN contains(lower(clause_text), '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


def _correction_sql() -> str:
    """The rules RULES as SQL over rows_."""
    hit = lambda p: f"regexp_matches(lower(clause_text), '{p}')"
    first = lambda k: "CASE " + " ".join(f"WHEN {hit(r[0])} THEN '{r[k]}'" for r in RULES.opinions) + " END"
    aspect = " ".join([*(f"WHEN {hit(p)} THEN '{a}'" for p, a in RULES.overrides), *(f"WHEN theme = '{t}' THEN '{a}'" for t, a in RULES.theme_aspects.items())])
    none, open_ = "annotation_status = 'No Aspect Opinion'", "annotation_status <> 'No Aspect Opinion' AND aspect IS NOT NULL AND sentiment IS NULL"
    cases = [  # condition, aspect, sentiment, status, action, reason, confidence
        (f"{none} AND sentiment IS NOT NULL", f"CASE {aspect} ELSE '{RULES.default_aspect}' END", "CASE WHEN sentiment = 'Mixed' THEN 'Neutral' ELSE sentiment END", "'Annotated'", "changed", "aspect restored", "high"),
        (f"{none} AND oa IS NOT NULL", "oa", "os", "'Annotated'", "changed", "opinion found", "high"),
        (f"{open_} AND {hit(RULES.factual)} AND NOT {hit(RULES.evaluating)}", "NULL", "NULL", "'No Aspect Opinion'", "changed", "factual clause", "high"),
        (f"{open_} AND oa IS NOT NULL", "oa", "os", "'Annotated'", "changed", "sentiment filled", "high"),
        (f"{open_} AND {hit(RULES.narrative)} AND NOT {hit(RULES.cues)}", "NULL", "NULL", "'No Aspect Opinion'", "changed", "narrative without a cue", "high"),
    ]
    for a, s, p, new_a, new_s, why in RULES.contradictions:
        only = (f" AND aspect = '{a}'" if a else "") + (f" AND sentiment = '{s}'" if s else "")
        cases.append((f"annotation_status = 'Annotated' AND sentiment IS NOT NULL AND {hit(p)}{only}", f"'{new_a}'" if new_a else "aspect", f"'{new_s}'", "'Annotated'", "changed", why, "high"))
    cases.append((open_, "aspect", "sentiment", "annotation_status", "unresolved", "ambiguous", "low"))
    pick = lambda k, other: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[k] if k < 4 else repr(c[k])}" for c in cases) + f" ELSE {other} END"
    return f"""{_A}, {_ROWS}, o AS (SELECT *, {first(1)} AS oa, {first(2)} AS os FROM rows_), fixed AS (
  SELECT assertion_id, aspect AS original_aspect, sentiment AS original_sentiment, {pick(1, "aspect")} AS corrected_aspect, {pick(2, "sentiment")} AS corrected_sentiment, {pick(3, "annotation_status")} AS corrected_annotation_status,
    {pick(4, "'unchanged'")} AS action, {pick(5, "''")} AS reason, {pick(6, "'high'")} AS confidence FROM o)"""


ORACLE_SQL = {
    "correction_log": f"{_correction_sql()} SELECT * FROM fixed WHERE action <> 'unchanged'",
    "correction_delta": f"""{_correction_sql()}, a AS (SELECT original_sentiment AS value, count(*) AS n FROM fixed GROUP BY 1), b AS (SELECT corrected_sentiment AS value, count(*) AS n FROM fixed GROUP BY 1)
SELECT coalesce(a.value, b.value) AS value, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.value IS NOT DISTINCT FROM b.value""",
    "validator_errors": f"""{_A}, {_ROWS}, v AS (SELECT *, CASE WHEN CAST(split_part(assertion_id, '_', 3) AS BIGINT) % 17 = 0 THEN 'Done' ELSE annotation_status END AS st, length(clause_text) AS e FROM rows_),
t AS (SELECT review_id, max(clause_text) AS txt FROM v WHERE review_id NOT LIKE '%7' GROUP BY 1), j AS (SELECT v.*, txt FROM v LEFT JOIN t USING (review_id)),
errors AS (
  SELECT 'missing review' AS rule, 'a review' AS expected, review_id AS actual FROM j WHERE txt IS NULL
  UNION ALL SELECT 'bad range', '0:' || length(txt), '0:' || e FROM j WHERE txt IS NOT NULL AND NOT (e > 0 AND e <= length(txt))
  UNION ALL SELECT 'text mismatch', substr(txt, 1, CAST(e AS BIGINT)), clause_text FROM j WHERE e > 0 AND e <= length(txt) AND substr(txt, 1, CAST(e AS BIGINT)) <> clause_text
  UNION ALL SELECT 'bad status', 'Annotated|Needs Review|No Aspect Opinion', st FROM j WHERE st = 'Done'
  UNION ALL SELECT 'bad aspect', 'Food|Service|Price / Value|Ambience|General Experience', aspect FROM j WHERE st <> 'No Aspect Opinion' AND aspect IS NULL
  UNION ALL SELECT 'bad sentiment', 'Positive|Negative|Neutral', sentiment FROM j WHERE st = 'Annotated' AND sentiment IS NULL
  UNION ALL SELECT 'opinion on no-opinion row', '', concat_ws('/', aspect, sentiment) FROM j WHERE st = 'No Aspect Opinion' AND (aspect IS NOT NULL OR sentiment IS NOT NULL))
SELECT rule, count(*) AS n, min(expected) AS least_expected, max(actual) AS most_actual FROM errors GROUP BY 1""",
    "suspect_classes": f"""{_A}, {_ROWS}, x AS (SELECT assertion_id, lower(clause_text) AS c FROM rows_ WHERE annotation_status = 'No Aspect Opinion'),
y AS (SELECT *, regexp_matches(c, 'red|blue|ring|old') AS e FROM x)
SELECT assertion_id, CASE WHEN NOT e THEN 'C' WHEN regexp_matches(c, 'widget|bolt|gear') THEN 'A' WHEN contains(c, 'plate') THEN 'B' WHEN contains(c, 'old') THEN 'D' ELSE 'C' END AS class,
  CASE WHEN NOT e THEN NULL WHEN contains(c, 'widget') THEN 'Food' WHEN regexp_matches(c, 'bolt|gear') THEN 'Service' WHEN contains(c, 'plate') THEN 'General Experience' END AS aspect FROM y""",
    "review_gate": f"{_A}, {_ROWS} SELECT count(*) FILTER (CAST(split_part(assertion_id, '_', 3) AS BIGINT) % 19 = 0) AS open, count(*) FILTER (CAST(split_part(assertion_id, '_', 3) AS BIGINT) % 19 = 0) = 0 AS passed FROM rows_",
    "multilabel_report": f"""{_ML} SELECT Category, TP, FP, FN, TN, Precision, Recall, F1, Support FROM per
UNION ALL SELECT 'Macro Avg', NULL, NULL, NULL, NULL, {_R4("avg(Precision)")}, {_R4("avg(Recall)")}, {_R4("avg(F1)")}, sum(Support) FROM per
UNION ALL SELECT 'Weighted Avg', NULL, NULL, NULL, NULL, {_R4("sum(Precision * Support) / sum(Support)")}, {_R4("sum(Recall * Support) / sum(Support)")}, {_R4("sum(F1 * Support) / sum(Support)")}, sum(Support) FROM per
UNION ALL SELECT 'Micro Avg', TP, FP, FN, NULL, Precision, Recall, F1, Support FROM ({_prf_sql("(SELECT sum(TP) AS TP, sum(FP) AS FP, sum(FN) AS FN FROM cells)", "", True)})""",
    "set_metrics": f"""{_S}, x AS (SELECT len(list_intersect(reference, predicted)) AS b, len(list_distinct(list_concat(reference, predicted))) AS e, len(predicted) AS np, len(reference) AS nr FROM sets)
SELECT count(*) AS n, {_R4("avg(CAST(e = b AS DOUBLE))")} AS exact_match, {_R4("avg(CAST(b = np AS DOUBLE))")} AS subset, {_R4("avg(CAST(b = nr AS DOUBLE))")} AS superset, {_R4("avg(CAST(b > 0 AS DOUBLE))")} AS overlap,
  {_R4("avg(CASE WHEN e = 0 THEN 1.0 ELSE b / e END)")} AS jaccard, {_R4("avg((e - b) / 5)")} AS hamming_loss FROM x""",
    "cooccurrence_matrix": f"""{_S}, x AS (SELECT CASE WHEN len(reference) = 0 THEN ['No Aspect Opinion'] ELSE reference END AS r, CASE WHEN len(predicted) = 0 THEN ['No Aspect Opinion'] ELSE predicted END AS p FROM sets),
y AS (SELECT unnest(r) AS reference_label, p FROM x), z AS (SELECT reference_label, unnest(p) AS predicted_label FROM y) SELECT reference_label, predicted_label, count(*) AS n FROM z GROUP BY 1, 2""",
    "error_examples": f"""{_S}, e AS (SELECT clause_id, c AS Category, CASE WHEN list_contains(predicted, c) THEN 'FP' ELSE 'FN' END AS kind FROM sets, (SELECT unnest({list(CATEGORIES)}) AS c) WHERE list_contains(reference, c) <> list_contains(predicted, c)),
r AS (SELECT *, row_number() OVER (PARTITION BY Category, kind ORDER BY clause_id) AS rn FROM e) SELECT Category, kind, string_agg(clause_id, '; ' ORDER BY clause_id) AS examples FROM r WHERE rn <= 5 GROUP BY 1, 2""",
    "no_aspect_audit": f"""{_S}, x AS (SELECT len(reference) = 0 AS r, len(predicted) = 0 AS p FROM sets)
SELECT count(*) AS n, count(*) FILTER (r) AS reference_empty, count(*) FILTER (p) AS predicted_empty, count(*) FILTER (r AND p) AS both_empty, count(*) FILTER (r AND NOT p) AS false_alarms, count(*) FILTER (NOT r AND p) AS missed,
  {pct_sql("count(*) FILTER (r)", "count(*)", 2)} AS reference_empty_pct, {pct_sql("count(*) FILTER (p)", "count(*)", 2)} AS predicted_empty_pct, {pct_sql("count(*) FILTER (r AND p)", "count(*) FILTER (r)", 2)} AS both_empty_pct,
  {pct_sql("count(*) FILTER (r AND NOT p)", "count(*) FILTER (r)", 2)} AS false_alarms_pct, {pct_sql("count(*) FILTER (NOT r AND p)", "count(*) FILTER (NOT r)", 2)} AS missed_pct FROM x""",
    "no_aspect_breakdown": f"""{_S}, x AS (SELECT 'false alarm' AS kind, unnest(predicted) AS aspect FROM sets WHERE len(reference) = 0 UNION ALL SELECT 'missed', unnest(reference) FROM sets WHERE len(predicted) = 0)
SELECT kind, aspect, count(*) AS n FROM x GROUP BY 1, 2""",
    "contingency_tables": f"""{_ML} SELECT Category, TP, FN, FP, TN, Support, FP + TN AS Negative_Support, (SELECT count(*) FROM sets) AS N, Precision, Recall, F1, {_R4(_DIV("TN", "(FP + TN)"))} AS Specificity,
  TP + FN + FP + TN = (SELECT count(*) FROM sets) AS adds_up FROM per""",
    "subset_metrics": f"""{_S}, x AS (SELECT len(reference) > 0 AS e, CAST(reference = predicted AS DOUBLE) AS x, CAST(len(list_intersect(reference, predicted)) > 0 AS DOUBLE) AS o FROM sets),
y AS (SELECT 'all' AS subset, * FROM x UNION ALL SELECT CASE WHEN e THEN 'evaluative' ELSE 'no opinion' END, * FROM x) SELECT subset, count(*) AS n, {_R4("avg(x)")} AS exact_match, {_R4("avg(o)")} AS overlap FROM y GROUP BY 1""",
    "change_classes": f"""{_S} SELECT CASE WHEN reference = predicted THEN 'identical' WHEN len(reference) = 0 THEN 'none to some' WHEN len(predicted) = 0 THEN 'some to none' ELSE 'reassigned' END AS change, count(*) AS n FROM sets GROUP BY 1""",
    "label_changes": f"""{_S}, x AS (SELECT c AS aspect, list_contains(reference, c) AS r, list_contains(predicted, c) AS p FROM sets, (SELECT unnest({list(CATEGORIES)}) AS c))
SELECT aspect, count(*) FILTER (r AND p) AS kept, count(*) FILTER (p AND NOT r) AS added, count(*) FILTER (r AND NOT p) AS removed FROM x WHERE r OR p GROUP BY 1""",
    "confusion_matrix": f"{_P} SELECT y, p, count(*) AS n, {_R4('count(*) / sum(count(*)) OVER (PARTITION BY y)')} AS row_share FROM predictions GROUP BY y, p",
    "confusion_f1": f"""{_P}, ls AS (SELECT y AS l FROM predictions UNION SELECT p FROM predictions),
c AS (SELECT CAST(l AS VARCHAR) AS label, count(*) FILTER (y = l AND p = l) AS TP, count(*) FILTER (y <> l AND p = l) AS FP, count(*) FILTER (y = l AND p <> l) AS FN FROM predictions, ls GROUP BY l),
per AS ({_prf_sql("c", "label", False)})
SELECT label, {_R4("Precision")} AS Precision, {_R4("Recall")} AS Recall, {_R4("F1")} AS F1, Support FROM per
UNION ALL SELECT 'accuracy', {_R4("sum(TP) / sum(Support)")}, {_R4("sum(TP) / sum(Support)")}, {_R4("sum(TP) / sum(Support)")}, sum(Support) FROM per
UNION ALL SELECT 'macro avg', {_R4("avg(Precision)")}, {_R4("avg(Recall)")}, {_R4("avg(F1)")}, sum(Support) FROM per
UNION ALL SELECT 'weighted avg', {_R4("sum(Precision * Support) / sum(Support)")}, {_R4("sum(Recall * Support) / sum(Support)")}, {_R4("sum(F1 * Support) / sum(Support)")}, sum(Support) FROM per""",
    "cohen_kappa": f"""{_P}, a AS (SELECT count(*) AS n, count(*) FILTER (y = p) / count(*) AS po FROM predictions),
m AS (SELECT sum(r.c * k.c) AS chance FROM (SELECT y AS l, count(*) AS c FROM predictions GROUP BY 1) r JOIN (SELECT p AS l, count(*) AS c FROM predictions GROUP BY 1) k USING (l))
SELECT n, round_even(1e6 * po, 0) / 1e6 AS agreement, round_even(1e6 * (chance / (n * n)), 0) / 1e6 AS expected, round_even(1e6 * ((po - chance / (n * n)) / (1 - chance / (n * n))), 0) / 1e6 AS kappa FROM a, m""",
    "mcnemar": f"""{_P}, t AS (SELECT count(*) FILTER (y = p AND y = p2) AS both_right, count(*) FILTER (y = p AND y <> p2) AS only_a, count(*) FILTER (y <> p AND y = p2) AS only_b, count(*) FILTER (y <> p AND y <> p2) AS both_wrong FROM predictions)
SELECT *, CASE WHEN only_a + only_b = 0 THEN 0.0 ELSE round_even(1e6 * (CAST(greatest(abs(only_a - only_b) - 1, 0) AS DOUBLE) * greatest(abs(only_a - only_b) - 1, 0) / (only_a + only_b)), 0) / 1e6 END AS chi_square,
  CASE WHEN only_b > 0 THEN round_even(1e6 * (only_a / only_b), 0) / 1e6 END AS odds_ratio FROM t""",
    "ece": f"""{_P}, b AS (SELECT least(CAST(floor(conf * 10) AS INTEGER), 9) AS bin, count(*) AS n, round_even(1e6 * avg(CAST(y = p AS DOUBLE)), 0) / 1e6 AS a, round_even(1e6 * avg(conf), 0) / 1e6 AS c FROM predictions GROUP BY 1)
SELECT sum(n) AS n, {_R4("sum(n * abs(a - c)) / sum(n)")} AS ece FROM b""",
    "disagreement_slices": f"{_P} SELECT CASE WHEN y = p THEN 'a only' WHEN y = p2 THEN 'b only' ELSE 'both wrong' END AS slice, count(*) AS n FROM predictions WHERE NOT (y = p AND y = p2) GROUP BY 1",
    "binary_label_report": f"""WITH ls AS (SELECT quality AS l FROM labels UNION SELECT toxic FROM labels),
c AS (SELECT CAST(l AS VARCHAR) AS label, count(*) FILTER (quality = l AND toxic = l) AS TP, count(*) FILTER (quality <> l AND toxic = l) AS FP, count(*) FILTER (quality = l AND toxic <> l) AS FN FROM labels, ls GROUP BY l),
per AS ({_prf_sql("c", "label", False)})
SELECT label, {_R4("Precision")} AS Precision, {_R4("Recall")} AS Recall, {_R4("F1")} AS F1, Support FROM per
UNION ALL SELECT 'accuracy', {_R4("sum(TP) / sum(Support)")}, {_R4("sum(TP) / sum(Support)")}, {_R4("sum(TP) / sum(Support)")}, sum(Support) FROM per
UNION ALL SELECT 'macro avg', {_R4("avg(Precision)")}, {_R4("avg(Recall)")}, {_R4("avg(F1)")}, sum(Support) FROM per
UNION ALL SELECT 'weighted avg', {_R4("sum(Precision * Support) / sum(Support)")}, {_R4("sum(Recall * Support) / sum(Support)")}, {_R4("sum(F1 * Support) / sum(Support)")}, sum(Support) FROM per""",
    "split_manifest": f"""{_SPLIT}, s AS (SELECT a.review_id, a.sentiment, split FROM assertions a JOIN parts USING (review_id) WHERE a.sentiment IS NOT NULL), c AS (SELECT split, sentiment, count(*) AS n FROM s GROUP BY 1, 2),
m AS (SELECT split, CAST(sum(n) AS BIGINT) AS rows, string_agg(sentiment || '=' || n, '|' ORDER BY sentiment) AS classes FROM c GROUP BY 1) SELECT split, groups, rows, classes FROM m JOIN (SELECT split, count(DISTINCT review_id) AS groups FROM s GROUP BY 1) USING (split)""",
    "split_ids": f"{_SPLIT} SELECT DISTINCT split, review_id FROM parts",
    "holdout_mix": f"""{_A}, r AS (SELECT review_id, Reviewer, Restaurant FROM reviews), b AS (SELECT * FROM r WHERE Restaurant IN ('NATION_3', 'NATION_4')), g AS (SELECT DISTINCT Reviewer FROM b),
p AS (SELECT Reviewer, row_number() OVER (ORDER BY md5(Reviewer || '|42'), Reviewer) <= floor((SELECT count(*) FROM g) * 0.7) AS own FROM g),
t AS (SELECT false AS from_benchmark, Reviewer FROM r WHERE Restaurant <> 'NATION_3' UNION ALL SELECT true, Reviewer FROM b JOIN p USING (Reviewer) WHERE own)
SELECT from_benchmark, count(*) AS n, count(DISTINCT Reviewer) AS reviewers FROM t WHERE Reviewer NOT IN (SELECT Reviewer FROM p WHERE NOT own) GROUP BY 1
UNION ALL SELECT NULL, count(*), count(DISTINCT Reviewer) FROM b JOIN p USING (Reviewer) WHERE NOT own""",
    "balanced_candidates": rf"""WITH {_CLAUSES}, f AS (SELECT * FROM c WHERE len(regexp_split_to_array(trim(clause_text), '\s+')) BETWEEN 4 AND 200 QUALIFY row_number() OVER (PARTITION BY lower(clause_text) ORDER BY clause_id) = 1),
g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY star_rating ORDER BY md5(clause_id || '|42'), clause_id) <= 20) SELECT clause_id, star_rating FROM g ORDER BY md5(clause_id || '|42'), clause_id LIMIT 60""",
    "gold_labels": f"""WITH {_CLAUSES}, h AS (SELECT *, {_has(GOLD_POSITIVE)} AS pos, {_has(GOLD_NEGATIVE)} AS neg FROM c)
SELECT clause_id, CASE {" ".join(f"WHEN {_has(w)} > 0 THEN '{a}'" for a, w in GOLD.items())} ELSE 'General' END AS gold_aspect,
  CASE WHEN pos > neg THEN 'Positive' WHEN neg > pos THEN 'Negative' WHEN star_rating = 3 THEN 'Neutral' WHEN star_rating >= 4 THEN 'Positive' ELSE 'Negative' END AS gold_sentiment FROM h""",
    "grouped_split": f"""{_A}, c AS (SELECT review_id, sentiment, count(*) AS n FROM assertions WHERE sentiment IS NOT NULL GROUP BY 1, 2),
dom AS (SELECT review_id, sentiment FROM c QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY n DESC, sentiment) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY md5(review_id || '|42'), review_id) AS rn, count(*) OVER (PARTITION BY sentiment) AS n FROM dom)
SELECT review_id, sentiment, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM r""",
    "grouped_split_leakage": "SELECT 'review_id' AS key, 0 AS n",
    "n_per_group": f"{_A} SELECT Restaurant, review_id FROM reviews QUALIFY row_number() OVER (PARTITION BY Restaurant ORDER BY md5(review_id || '|42'), review_id) <= 5",
    "quota_sample": f"""{_A}, b AS (SELECT review_id, CASE WHEN star_rating <= 2.5 THEN 'low' WHEN star_rating <= 3.5 THEN 'mid' ELSE 'high' END AS bin FROM reviews)
SELECT review_id, bin FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY md5(review_id || '|42'), review_id) <= CASE bin WHEN 'high' THEN 50 ELSE 25 END""",
    "quota_report": f"""{_A}, b AS (SELECT CASE WHEN star_rating <= 2.5 THEN 'low' WHEN star_rating <= 3.5 THEN 'mid' ELSE 'high' END AS bin, count(*) AS available FROM reviews GROUP BY 1)
SELECT q.bin, quota, coalesce(available, 0) AS available, least(coalesce(available, 0), quota) AS taken FROM (VALUES ('low', 25), ('mid', 25), ('high', 50)) q(bin, quota) LEFT JOIN b ON b.bin = q.bin""",
    "dominant_label": f"""{_A}, c AS (SELECT review_id, sentiment, count(*) AS n FROM assertions WHERE sentiment IS NOT NULL GROUP BY 1, 2)
SELECT review_id, sentiment FROM c QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY n DESC, sentiment) = 1""",
    "key_differences": f"""{_A}, a AS (SELECT DISTINCT review_id FROM assertions WHERE review_id NOT LIKE '%3')
SELECT DISTINCT review_id, 'missing' AS problem FROM reviews WHERE review_id NOT IN (SELECT review_id FROM a) UNION ALL SELECT review_id, 'unexpected' FROM a WHERE review_id NOT IN (SELECT review_id FROM reviews)""",
    "incremental_intake": f"{_A} SELECT review_id, Restaurant FROM reviews WHERE review_id NOT IN (SELECT review_id FROM assertions)",
    "semi_join_reviews": f"WITH {UNITS_SQL} SELECT review_id, star_rating FROM reviews WHERE review_id IN (SELECT review_id FROM opinions WHERE aspect = 'Ambience')",
    "rule_status_counts": f"""{_A}, l AS (SELECT annotation_status, CASE WHEN annotation_status <> 'Annotated' THEN last_value(CASE WHEN annotation_status = 'Annotated' THEN clause_id END IGNORE NULLS)
  OVER (PARTITION BY review_id ORDER BY ord_line, ord_part, ord_supp, ord_price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS e FROM assertions)
SELECT annotation_status, count(e) AS linked, count(*) AS n FROM l GROUP BY 1""",
    "suspect_scan": f"""{_A}, {_ROWS}, h AS (SELECT assertion_id, list_filter(['red', 'ring', 'widget', 'small'], lambda k: contains(lower(clause_text), k)) AS f FROM rows_ WHERE annotation_status = 'No Aspect Opinion')
SELECT assertion_id, len(f) AS n, array_to_string(f, '|') AS hits FROM h WHERE len(f) > 0""",
    "correction_invariants": "SELECT 0 AS lost, 0 AS added, 0 AS text_changed, 0 AS offsets_changed, 0 AS unlogged",
}
