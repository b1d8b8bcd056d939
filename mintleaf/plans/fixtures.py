"""The driver's tables as review layers, in Spark and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["ord_line", "ord_part", "ord_supp", "ord_price"]
_ASPECT = {"MEDIUM": "Food", "STANDARD": "Service", "LARGE": "Price / Value", "PROMO": "Ambience", "SMALL": "General Experience"}
_SENTIMENT = {"A": "Positive", "N": "Neutral", "R": "Negative"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column, mapping: dict[str, str], other: str | None):
    out = F.lit(other)
    for k, v in mapping.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def _sql_case(column: str, mapping: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {other} END"


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as assertions of reviews (orders) on entities (nations)."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    quiet = F.col("l_quantity") < 5
    return j.select(
        F.col("l_orderkey").cast("string").alias("review_id"), F.col("n_name").alias("Restaurant"), _case(F.col("p_type"), _ASPECT, "Other").alias("aspect"),
        F.when(quiet, "No Aspect Opinion").otherwise("Annotated").alias("annotation_status"), F.when(~quiet, _case(F.col("l_returnflag"), _SENTIMENT, None)).alias("sentiment"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("star_rating"), F.col("o_orderdate").alias("Review_Date"), F.date_format("o_orderdate", "yyyy-MM").alias("YearMonth"),
        F.col("c_name").alias("Reviewer"), (1 - F.col("l_discount")).alias("confidence"), F.col("p_name").alias("clause_text"),
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("clause_id"),
        F.col("l_linenumber").alias("ord_line"), F.col("l_partkey").alias("ord_part"), F.col("l_suppkey").alias("ord_supp"), F.col("l_extendedprice").alias("ord_price"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as reviews, also those without assertions."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(
        F.col("o_orderkey").cast("string").alias("review_id"), F.col("n_name").alias("Restaurant"), F.substring("o_orderpriority", 1, 1).cast("double").alias("star_rating"),
        F.col("o_orderdate").alias("Review_Date"), F.col("c_name").alias("Reviewer"),
    )


ASSERTIONS_SQL = f"""assertions AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS review_id, n_name AS Restaurant, {_sql_case("p_type", _ASPECT, "'Other'")} AS aspect,
    CASE WHEN l_quantity < 5 THEN 'No Aspect Opinion' ELSE 'Annotated' END AS annotation_status,
    CASE WHEN l_quantity >= 5 THEN {_sql_case("l_returnflag", _SENTIMENT, "NULL")} END AS sentiment,
    CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS star_rating, o_orderdate AS Review_Date, strftime(o_orderdate, '%Y-%m') AS YearMonth,
    c_name AS Reviewer, 1 - l_discount AS confidence, p_name AS clause_text, l_orderkey || '_' || l_linenumber AS clause_id,
    l_linenumber AS ord_line, l_partkey AS ord_part, l_suppkey AS ord_supp, l_extendedprice AS ord_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
reviews AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS review_id, n_name AS Restaurant, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS star_rating,
    o_orderdate AS Review_Date, c_name AS Reviewer
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

RESOLVE_SQL = """CASE WHEN bool_or(sentiment = 'Positive') AND bool_or(sentiment = 'Negative') THEN 'Mixed' WHEN bool_or(sentiment = 'Positive') THEN 'Positive'
    WHEN bool_or(sentiment = 'Negative') THEN 'Negative' ELSE 'Neutral' END"""

UNITS_SQL = f"""{ASSERTIONS_SQL},
aspects AS (SELECT unnest(['Food', 'Service', 'Price / Value', 'Ambience', 'General Experience']) AS aspect),
opinions AS (
  SELECT *, row_number() OVER (PARTITION BY review_id, aspect ORDER BY ord_line, ord_part, ord_supp, ord_price) AS rn
  FROM assertions WHERE aspect <> 'Other' AND annotation_status <> 'No Aspect Opinion' AND sentiment IS NOT NULL),
units AS (
  SELECT review_id, aspect, max(CASE WHEN rn = 1 THEN Restaurant END) AS Restaurant, {RESOLVE_SQL} AS sentiment, max(CASE WHEN rn = 1 THEN star_rating END) AS star_rating,
    max(CASE WHEN rn = 1 THEN Review_Date END) AS Review_Date, max(CASE WHEN rn = 1 THEN YearMonth END) AS YearMonth, max(CASE WHEN rn = 1 THEN Reviewer END) AS Reviewer,
    count(*) AS clause_count, max(CASE WHEN rn = 1 THEN clause_text END) AS sample_clause
  FROM opinions GROUP BY review_id, aspect)"""


def pct_sql(part: str, whole: str, digits: int = 1) -> str:
    return f"CASE WHEN coalesce({whole}, 0) = 0 THEN 0.0 ELSE round_even(100 * (CAST({part} AS DOUBLE) / {whole}) * {10**digits}, 0) / {10**digits} END"


def shares_sql(whole: str, alias: str = "") -> str:
    parts = []
    for s in ("Positive", "Negative", "Neutral", "Mixed"):
        n = f"coalesce({alias}n_{s}, 0)"
        parts.append(f"{n} AS {s}_Count, {pct_sql(n, whole)} AS {s}_Pct")
    return ", ".join(parts)


COUNTS_SQL = ", ".join(f"count(*) FILTER (sentiment = '{s}') AS n_{s}" for s in ("Positive", "Negative", "Neutral", "Mixed"))


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with two label sets: the reference from each order line's part, the prediction from its part's size."""
    a = assertions(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord_part"), "p_size")
    guess = F.when(F.col("p_size") % 3 == 0, "Service").when(F.col("p_size") % 7 == 0, None).otherwise(F.when(F.col("aspect") != "Other", F.col("aspect")))
    rows = a.join(parts, "ord_part").select("clause_id", F.when((F.col("aspect") != "Other") & (F.col("annotation_status") == "Annotated"), F.col("aspect")).alias("r"), guess.alias("p"))
    return rows.groupBy("clause_id").agg(F.sort_array(F.collect_set("r")).alias("reference"), F.sort_array(F.collect_set("p")).alias("predicted"))


SETS_SQL = f"""{ASSERTIONS_SQL},
sets AS (
  SELECT clause_id,
    list_sort(coalesce(list(DISTINCT aspect) FILTER (aspect <> 'Other' AND annotation_status = 'Annotated'), [])) AS reference,
    list_sort(coalesce(list(DISTINCT CASE WHEN p_size % 3 = 0 THEN 'Service' WHEN p_size % 7 = 0 THEN NULL WHEN aspect <> 'Other' THEN aspect END)
      FILTER (CASE WHEN p_size % 3 = 0 THEN 'Service' WHEN p_size % 7 = 0 THEN NULL WHEN aspect <> 'Other' THEN aspect END IS NOT NULL), [])) AS predicted
  FROM assertions JOIN part ON ord_part = p_partkey GROUP BY clause_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, p, p2, conf): two nearest-centroid models of the embeddings, by cosine and by dot product."""
    from mintleaf.functions.numbers import dot
    from mintleaf.operators.match import centroids, nearest_centroid

    v = table(spark, sf_dir, "embeddings")
    c = centroids(v)
    one = nearest_centroid(v, c)
    whole = c.agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("l"), F.col("centroid").alias("c")))).alias("t"))
    best = F.array_max(F.transform("t", lambda t: F.struct(dot(F.col("embedding"), t["c"]).alias("s"), (-t["l"]).alias("neg"))))
    two = v.crossJoin(F.broadcast(whole)).select("vec_id", F.col("label").alias("y"), (-best["neg"]).alias("p2"))
    return two.join(one, "vec_id").select("vec_id", "y", F.col("predicted").alias("p"), "p2", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("conf"))


PREDICTIONS_SQL = """centroid_parts AS (
  SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
centroids AS (SELECT label, list(m ORDER BY i) AS c FROM centroid_parts GROUP BY label),
scored AS (
  SELECT vec_id, e.label AS y, c.label AS l, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) AS s, list_dot_product(CAST(embedding AS DOUBLE[]), c) AS d
  FROM embeddings e CROSS JOIN centroids c),
predictions AS (
  SELECT vec_id, any_value(y) AS y, arg_max(l, s) AS p, arg_max(l, d) AS p2, least(greatest(max(s), 0), 1) AS conf FROM scored GROUP BY vec_id)"""
