"""Queries over joins of annotations, offsets, overrides and resolutions, margins of samples, and round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from mintleaf.functions.numbers import softmax
from mintleaf.operators import assertions as asr
from mintleaf.operators import clean, ml, quality, sampling
from mintleaf.plans.fixtures import ASSERTIONS_SQL, PREDICTIONS_SQL, predictions, reviews, table
from mintleaf.plans.q_text import _CLAUSES, _DOCS, _clauses, _docs
from mintleaf.sources import io
from mintleaf.sources.tables import shared_dir


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "text")


def _labels(spark, d):
    return table(spark, d, "labels")


def _predicted(spark, d):
    """Annotations (the language of a document) beside the labels predicted for it."""
    notes = _documents(spark, d).select(F.col("doc_id").alias("clause_id"), F.col("lang").alias("aspect"), F.lit(1).alias("ord"))
    found = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    return quality.with_predictions(notes, _labels(spark, d).select(F.col("doc_id").alias("clause_id"), found.alias("predicted"))).select("clause_id", "aspect", "predicted_label")


def _alignment(spark, d):
    docs = _documents(spark, d).select("doc_id", F.col("lang").alias("clause_text"))
    other = F.when(F.col("doc_id") % 5 == 0, F.upper("clause_text")).otherwise(F.concat(F.lit(" "), F.col("clause_text")))
    return quality.alignment_audit(docs.filter("doc_id % 11 <> 0"), docs.filter("doc_id % 7 <> 0").withColumn("clause_text", other), ["doc_id"])


def _overridden(spark, d):
    marks = _labels(spark, d)
    given = marks.filter("quality = 1").select("doc_id", F.lit("en").alias("expected"), F.lit("english").alias("new")).unionByName(marks.filter("toxic = 1 OR doc_id % 2 = 0").select("doc_id", F.lit(None).cast("string").alias("expected"), F.lit("other").alias("new")))
    return quality.apply_overrides(_documents(spark, d).select("doc_id", "lang"), given, "doc_id", "lang")


def _projected(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("clause_id"), F.col("role").alias("aspect"), F.col("turn").alias("ord"), F.col("turn").cast("string").alias("theme"), F.md5("text").alias("sentiment"))
    wanted = F.when(F.col("clause_id").endswith("7"), F.array().cast("array<string>")).otherwise(F.array(F.lit("assistant"), F.lit("judge")))
    return quality.project_labels(turns.select("clause_id").distinct().withColumn("predicted", wanted), turns)


def _offset_check(spark, d):
    rows = _clauses(spark, d).join(_docs(spark, d).select("review_id", "Review"), "review_id")
    rows = rows.withColumn("clause_end_char", F.when(F.col("clause_idx") % 5 > 0, F.col("clause_end_char") + F.when(F.col("clause_idx") % 5 == 1, 1).otherwise(0)))
    return quality.offset_check(rows, "Review", "clause_start_char", "clause_end_char", "clause_text")


def _resolved(spark, d):
    queue = _documents(spark, d).select(F.col("doc_id").cast("string").alias("assertion_id"), F.when(F.col("doc_id") % 13 > 0, F.col("lang")).alias("clause_text"))
    number = F.when(F.col("toxic") == 1, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id"))
    return quality.resolution_errors(queue, _labels(spark, d).select(number.cast("string").alias("assertion_id"), F.when(F.col("quality") == 1, "e").alias("target_text")))


def _missing(spark, d):
    gap = lambda k: F.when(F.col("doc_id") % k > 0, F.lit(0))
    return quality.missing_offsets(_documents(spark, d).select(F.col("doc_id").alias("assertion_id"), F.col("lang").alias("target_text"), gap(3).alias("target_start_char"), F.col("source").alias("opinion_text"), gap(4).alias("opinion_start_char"), F.md5("text").alias("clause_text")))


def _backfilled(spark, d):
    raw = reviews(spark, d).select("review_id", "Review_Date", "Reviewer")
    gone = lambda k, c: F.when(F.substring(F.md5("review_id"), 1, 1) >= k, F.col(c)).alias(c)
    filled = clean.backfill_dates(raw.select("review_id", gone("9", "Review_Date"), gone("4", "Reviewer")), raw.filter("Reviewer NOT LIKE '%3'"))
    return filled.groupBy("YearMonth").agg(F.count(F.lit(1)).alias("n"), F.count("Reviewer").alias("reviewers"))


def _wide(spark, d):
    p = predictions(spark, d)
    return ml.wide_errors({"cosine": p.select("vec_id", F.col("p").alias("prediction"), F.round("conf", 6).alias("confidence")), "product": p.select("vec_id", F.col("p2").alias("prediction"), F.lit(1.0).alias("confidence"))}, ["vec_id"])


def _greedy(spark, d):
    turns = table(spark, d, "conversations").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("clause_id"), "text")
    at = lambda words: F.filter(F.array(*[F.struct(F.instr("text", w).alias("pos"), F.lit(w).alias("word")) for w in words]), lambda x: x["pos"] > 0)
    pairs = asr.pair_targets(at(["en", "an", "on"]), at(["th", "ch", "er", "de"]))
    return turns.select("clause_id", F.explode(pairs).alias("p")).select("clause_id", "p.target", "p.opinion")


def _margins(spark, d):
    rows = reviews(spark, d).withColumn("bin", clean.rating_bin(F.col("star_rating"))).withColumn("half", F.when(F.month("Review_Date") <= 6, "first").otherwise("second"))
    return sampling.margin_sample(rows, {"bin": {"low": 25, "mid": 25, "high": 50}, "half": {"first": 40, "second": 60}}, "review_id", once="Reviewer")[1]


def _path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/mintleaf/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _csv_roundtrip(spark, d):
    path, docs = _path(spark, "csv"), _documents(spark, d).select("doc_id", "lang", "text")
    io.write_csv(docs, path)
    kinds = StructType([StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("text", StringType())])
    return io.read_reviews_csv(spark, path, kinds).select("doc_id", "lang", F.md5("text").alias("text_md5"))


def _verbatim_roundtrip(spark, d):
    path = _path(spark, "verbatim")
    names = F.when(F.col("doc_id") % 3 == 0, "NA").when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("lang"))
    io.write_csv(_documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), names.alias("name")), path)
    return io.read_verbatim_csv(spark, path, ["doc_id", "name"])


def _parquet_roundtrip(spark, d):
    path = _path(spark, "parquet")
    io.write_parquet(_documents(spark, d), path, ["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _jsonl_roundtrip(spark, d):
    path = _path(spark, "jsonl")
    rows = _documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("score"))
    io.write_jsonl(rows, path)
    lines = spark.read.text(path).select(F.size(F.json_object_keys("value")).alias("keys"), F.from_json("value", "doc_id long, text string, score double").alias("r"))
    return lines.select("r.doc_id", "keys", F.md5("r.text").alias("text_md5"), "r.score")


def _intake(spark, d):
    """Documents that come in two overlapping batches, the second one twice."""
    path, docs = _path(spark, "intake"), _documents(spark, d).select("doc_id", "lang")
    io.intake(docs.filter("doc_id % 3 <> 0"), path, "doc_id", "one")
    for _ in range(2):
        io.intake(docs.filter("doc_id % 2 = 0"), path, "doc_id", "two")
    return spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


QUERIES = {
    "predicted_labels": _predicted,
    "alignment_audit": _alignment,
    "overrides": _overridden,
    "projected_labels": _projected,
    "offset_check": _offset_check,
    "resolution_errors": _resolved,
    "missing_offsets": _missing,
    "backfilled_dates": _backfilled,
    "wide_errors": _wide,
    "greedy_pairs": _greedy,
    "margin_report": _margins,
    "softmax_scores": lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(softmax(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))).alias("i", "p")).select("vec_id", "i", F.round("p", 6).alias("p")),
    "verification_template": lambda s, d: io.verification_template(_documents(s, d).select("doc_id", "lang"), ["doc_id", "lang"]),
    "csv_roundtrip": _csv_roundtrip,
    "verbatim_roundtrip": _verbatim_roundtrip,
    "parquet_roundtrip": _parquet_roundtrip,
    "jsonl_roundtrip": _jsonl_roundtrip,
    "intake_batches": _intake,
}


def _at_sql(words: list[str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"{{'pos': instr(text, '{w}'), 'word': '{w}'}}" for w in words) + "], lambda x: x.pos > 0))"


ORACLE_SQL = {
    "predicted_labels": """WITH p AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS l FROM labels)
SELECT d.doc_id AS clause_id, lang AS aspect, unnest(CASE WHEN len(coalesce(l, [])) = 0 THEN [NULL] ELSE l END) AS predicted_label FROM documents d LEFT JOIN p USING (doc_id)""",
    "alignment_audit": """WITH a AS (SELECT doc_id, lang AS ta FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(lang) ELSE ' ' || lang END AS tb FROM documents WHERE doc_id % 7 <> 0)
SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS matched, count(*) FILTER (b.doc_id IS NULL) AS only_left, count(*) FILTER (a.doc_id IS NULL) AS only_right,
  count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND trim(ta) IS DISTINCT FROM trim(tb)) AS text_mismatch FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "overrides": """WITH j AS (SELECT d.doc_id, lang, CASE WHEN quality = 1 AND lang = 'en' THEN 'english' WHEN toxic = 1 OR (l.doc_id IS NOT NULL AND d.doc_id % 2 = 0) THEN 'other' END AS new FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, coalesce(new, lang) AS lang, CASE WHEN new IS NOT NULL THEN 'lang: ' || coalesce(lang, 'null') || ' -> ' || new END AS change_note FROM j""",
    "projected_labels": """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS clause_id, role, turn, CAST(turn AS VARCHAR) AS theme, md5(text) AS sentiment FROM conversations),
f AS (SELECT clause_id, arg_min(theme, turn) AS theme, arg_min(sentiment, turn) AS sentiment FROM t GROUP BY 1), s AS (SELECT clause_id, role, arg_min(theme, turn) AS theme, arg_min(sentiment, turn) AS sentiment FROM t GROUP BY 1, 2),
w AS (SELECT clause_id, unnest(CASE WHEN clause_id LIKE '%7' THEN [NULL] ELSE ['assistant', 'judge'] END) AS aspect FROM f)
SELECT w.clause_id, w.clause_id || CASE WHEN aspect = 'judge' THEN '_A02' ELSE '_A01' END AS assertion_id, aspect, CASE WHEN aspect IS NULL THEN 'No Aspect Opinion' ELSE 'Annotated' END AS annotation_status,
  CASE WHEN s.role IS NULL THEN f.theme ELSE s.theme END AS theme, CASE WHEN s.role IS NULL THEN f.sentiment ELSE s.sentiment END AS sentiment, s.role IS NULL AS inherited
FROM w JOIN f USING (clause_id) LEFT JOIN s ON s.clause_id = w.clause_id AND s.role = w.aspect""",
    "offset_check": f"""WITH {_DOCS}, {_CLAUSES}, e AS (SELECT n.*, d.Review FROM named n JOIN d USING (review_id))
SELECT count(*) AS n, count(*) FILTER (clause_idx % 5 > 1 OR clause_idx % 5 = 1 AND substr(Review, clause_start_char + 1, clause_end_char + 1 - clause_start_char) = clause_text) AS matches,
  count(*) FILTER (clause_idx % 5 = 1 AND substr(Review, clause_start_char + 1, clause_end_char + 1 - clause_start_char) <> clause_text) AS mismatches, count(*) FILTER (clause_idx % 5 = 0) AS missing FROM e""",
    "resolution_errors": """WITH q AS (SELECT CAST(doc_id AS VARCHAR) AS assertion_id, CASE WHEN doc_id % 13 > 0 THEN lang END AS t FROM documents), r AS (SELECT CAST(doc_id + CASE WHEN toxic = 1 THEN 10000000 ELSE 0 END AS VARCHAR) AS assertion_id, CASE WHEN quality = 1 THEN 'e' END AS s FROM labels),
j AS (SELECT coalesce(q.assertion_id, r.assertion_id) AS assertion_id, CASE WHEN r.assertion_id IS NULL THEN 'unresolved' WHEN q.assertion_id IS NULL THEN 'not queued' WHEN s IS NOT NULL AND NOT coalesce(contains(t, s), false) THEN 'span outside' END AS rule FROM q FULL JOIN r ON q.assertion_id = r.assertion_id)
SELECT * FROM j WHERE rule IS NOT NULL""",
    "missing_offsets": """SELECT doc_id AS assertion_id, 'target' AS kind, lang AS span, md5(text) AS clause_text FROM documents WHERE doc_id % 3 = 0 AND coalesce(lang, '') <> ''
UNION ALL SELECT doc_id, 'opinion', source, md5(text) FROM documents WHERE doc_id % 4 = 0 AND coalesce(source, '') <> ''""",
    "backfilled_dates": f"""WITH {ASSERTIONS_SQL}, r AS (SELECT review_id, CASE WHEN md5(review_id)[1] >= '9' THEN Review_Date END AS d, CASE WHEN md5(review_id)[1] >= '4' THEN Reviewer END AS w FROM reviews),
o AS (SELECT review_id, Review_Date AS d2, Reviewer AS w2 FROM reviews WHERE Reviewer NOT LIKE '%3')
SELECT strftime(coalesce(d, d2), '%Y-%m') AS YearMonth, count(*) AS n, count(coalesce(w, w2)) AS reviewers FROM r LEFT JOIN o USING (review_id) GROUP BY 1""",
    "margin_report": f"""WITH {ASSERTIONS_SQL}, p AS (SELECT *, CASE WHEN star_rating <= 2.5 THEN 'low' WHEN star_rating <= 3.5 THEN 'mid' ELSE 'high' END AS bin, CASE WHEN month(Review_Date) <= 6 THEN 'first' ELSE 'second' END AS half FROM reviews),
o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY Reviewer ORDER BY md5(review_id || '|42'), review_id) = 1), m AS (SELECT 'bin' AS margin, bin AS value FROM o UNION ALL SELECT 'half', half FROM o)
SELECT margin, value, CAST(CASE value WHEN 'low' THEN 25 WHEN 'mid' THEN 25 WHEN 'high' THEN 50 WHEN 'first' THEN 40 ELSE 60 END AS INTEGER) AS quota, count(*) AS available, CAST(quota AS BIGINT) AS taken, TRUE AS met FROM m GROUP BY 1, 2""",
    "wide_errors": f"WITH {PREDICTIONS_SQL} SELECT vec_id, p AS pred_cosine, round(conf, 6) AS conf_cosine, p2 AS pred_product, CAST(1 AS DOUBLE) AS conf_product FROM predictions",
    "greedy_pairs": f"""WITH t AS (SELECT conv_id || '_' || turn AS clause_id, {_at_sql(["en", "an", "on"])} AS targets, {_at_sql(["th", "ch", "er", "de"])} AS opinions FROM conversations),
o AS (SELECT clause_id, list_reduce(list_prepend({{'free': targets, 'pos': 0, 'word': '', 'made': CAST([] AS STRUCT(target VARCHAR, opinion VARCHAR)[])}},
    list_transform(opinions, lambda o: {{'free': CAST([] AS STRUCT(pos BIGINT, word VARCHAR)[]), 'pos': o.pos, 'word': o.word, 'made': CAST([] AS STRUCT(target VARCHAR, opinion VARCHAR)[])}})),
  lambda a, o: CASE WHEN len(a.free) = 0 THEN a ELSE {{'free': list_filter(a.free, lambda t: t.pos <> list_sort(list_transform(a.free, lambda u: {{'d': abs(u.pos - o.pos), 'pos': u.pos, 'word': u.word}}))[1].pos), 'pos': 0, 'word': '',
    'made': list_append(a.made, {{'target': list_sort(list_transform(a.free, lambda u: {{'d': abs(u.pos - o.pos), 'pos': u.pos, 'word': u.word}}))[1].word, 'opinion': o.word}})}} END).made AS made FROM t)
SELECT clause_id, p.target, p.opinion FROM (SELECT clause_id, unnest(made) AS p FROM o)""",
    "softmax_scores": """WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(CAST(x AS DOUBLE))) AS v FROM embeddings)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(v[i] / list_sum(v), 6) AS p FROM e, range(1, 5) r(i)""",
    "verification_template": "SELECT doc_id, lang, '' AS reviewer, '' AS verified_aspect, '' AS verified_sentiment, '' AS comment, 'pending' AS verification_status FROM documents",
    "csv_roundtrip": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "verbatim_roundtrip": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE doc_id % 3 WHEN 0 THEN 'NA' WHEN 1 THEN '' ELSE lang END AS name FROM documents",
    "parquet_roundtrip": "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "jsonl_roundtrip": "SELECT doc_id, CAST(3 AS INTEGER) AS keys, CASE WHEN doc_id % 3 > 0 THEN md5(text) END AS text_md5, CASE WHEN doc_id % 2 = 1 THEN 0.5::DOUBLE END AS score FROM documents",
    "intake_batches": "SELECT CASE WHEN doc_id % 3 <> 0 THEN 'one' ELSE 'two' END AS batch, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0 GROUP BY 1",
}
