"""Units over a stream, intake in batches, sketches, and the bootstrap from counts."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mintleaf.operators import evaluate, health, match, metrics, sketches, units
from mintleaf.sources import io
from mintleaf.streaming import units as stream

ROWS = "review_id string, Restaurant string, aspect string, annotation_status string, sentiment string, star_rating double, Review_Date timestamp, YearMonth string, Reviewer string, clause_text string, ord int"


def assertions(spark, n, seed, first_day=0, start=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        day = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=first_day + rng.randrange(40))
        rows.append((
            f"r{rng.randrange(60)}", rng.choice(["A", "B"]), rng.choice(["Food", "Service", "Nonsense"]), rng.choice(["Annotated", "No Aspect Opinion"]),
            rng.choice(["Positive", "Negative", "Neutral", None]), 3.0, rng.choice([day, None]), day.strftime("%Y-%m"), "x", f"t{start + k}", start + k,
        ))
    return spark.createDataFrame(rows, ROWS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stream_with_restarts_equals_the_batch(spark, tmp_path):
    """Three micro-batches, each in a new query on the same checkpoint, give the units and trends of one batch."""
    source, folder, checkpoint = (str(tmp_path / n) for n in ("source", "table", "checkpoint"))
    whole = None
    for k in range(3):
        part = assertions(spark, 150, k, first_day=30 * k, start=1000 * k)
        part.coalesce(1).write.mode("append").parquet(source)
        whole = part if whole is None else whole.unionByName(part)
        query = stream.stream_units(spark.readStream.schema(part.schema).parquet(source), folder, checkpoint, ["ord"], late_days=400)
        assert query.awaitTermination(300)
    batch = units.review_aspect_units(whole, ["ord"])
    found = stream.read_units(spark, folder)
    assert found.columns == batch.columns and rows_of(found) == rows_of(batch)
    assert rows_of(metrics.monthly_trends(found)) == rows_of(metrics.monthly_trends(batch))
    log = stream.batch_log(spark, folder).collect()
    assert [r["n_rows"] for r in log] == [150] * 3 and sum(r["n_late"] for r in log) == 0


def test_late_rows_are_counted_and_kept_out(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / n) for n in ("source", "table", "checkpoint"))
    first, second = assertions(spark, 80, 1, first_day=100), assertions(spark, 80, 2, first_day=60, start=1000)
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        stream.stream_units(spark.readStream.schema(part.schema).parquet(source), folder, checkpoint, ["ord"], late_days=7).awaitTermination(300)
    limit = first.agg(F.max("Review_Date")).first()[0] - datetime.timedelta(days=7)
    late = second.filter(F.col("Review_Date") < F.lit(limit))
    assert late.count() > 0 and rows_of(stream.late_rows(spark, folder).drop("batch")) == rows_of(late)
    assert {r["batch"]: r["n_late"] for r in stream.batch_log(spark, folder).collect()} == {0: 0, 1: late.count()}
    on_time = first.unionByName(second.filter(F.coalesce(F.col("Review_Date") >= F.lit(limit), F.lit(True))))
    assert rows_of(stream.read_units(spark, folder)) == rows_of(units.review_aspect_units(on_time, ["ord"]))


def test_partials_merge_in_any_order(spark):
    rows = assertions(spark, 300, 9)
    parts = [stream.partial_units(rows.filter(F.col("ord") % 3 == k), ["ord"]) for k in range(3)]
    at_once = rows_of(stream.merge_units(stream.partial_units(rows, ["ord"])))
    assert rows_of(stream.merge_units(parts[2].unionByName(stream.merge_units(parts[0].unionByName(parts[1]))))) == at_once


def test_intake_twice_is_intake_once(spark, tmp_path):
    path = str(tmp_path / "reviews")
    rows = lambda ids, month: spark.createDataFrame([(k, f"text {k}", month) for k in ids], "review_id long, text string, YearMonth string")
    io.intake(rows(range(5), "2024-01"), path, "review_id", "monday", ["YearMonth"])
    io.intake(rows(range(3, 9), "2024-02"), path, "review_id", "tuesday", ["YearMonth"])
    once = rows_of(spark.read.parquet(path))
    assert sorted(r[0] for r in once) == list(range(9))
    for _ in range(2):
        io.intake(rows(range(3, 9), "2024-02"), path, "review_id", "tuesday", ["YearMonth"])
        io.intake(rows(range(5), "2024-01"), path, "review_id", "monday", ["YearMonth"])
    assert rows_of(spark.read.parquet(path)) == once
    # a batch that comes again in other form replaces what it brought
    io.intake(rows([8], "2024-03"), path, "review_id", "tuesday", ["YearMonth"])
    assert sorted((r["review_id"], r["YearMonth"]) for r in spark.read.parquet(path).collect()) == [(k, "2024-01") for k in range(5)] + [(8, "2024-03")]


def test_sketches_for_any_scope(spark):
    rows = spark.range(60000).select(
        (F.col("id") % 20011).cast("string").alias("review_id"), F.concat(F.lit("e"), (F.col("id") % 20011 % 7).cast("string")).alias("Restaurant"), F.when(F.col("id") < 20011, "Food").when(F.col("id") < 40022, "Service").otherwise("Ambience").alias("aspect"),
        F.concat(F.lit("2024-0"), (1 + F.col("id") % 20011 % 5).cast("string")).alias("YearMonth"), F.when(F.col("id") % 3 == 0, "Positive").otherwise("Mixed").alias("sentiment"),
    )
    stored = sketches.review_sketches(rows)
    for scope, by in ((None, []), (None, ["Restaurant"]), (F.col("YearMonth").between("2024-02", "2024-03"), ["Restaurant"]), (F.col("Restaurant") == "e3", []), (F.col("Restaurant") == "nowhere", [])):
        exact = metrics.aspect_metrics(rows if scope is None else rows.filter(scope), by=by)
        found = sketches.aspect_metrics_from_sketches(stored, by, scope)
        assert found.columns == exact.columns
        near = lambda df: {tuple(r[c] for c in [*by, "Aspect"]): r for r in df.collect()}
        want, got = near(exact), near(found)
        assert want.keys() == got.keys()
        for key, r in want.items():
            assert abs(got[key]["Eligible_Reviews"] - r["Eligible_Reviews"]) <= 0.03 * r["Eligible_Reviews"]
            assert all(got[key][c] == r[c] for c in exact.columns if c not in ("Eligible_Reviews", "Mention_Rate_Pct"))


def test_median_age_comes_from_counts(spark):
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    days = [0, 0, 0, 1, 5, 5, 30, None]
    weighted = health.recency_weights(spark.createDataFrame([("A", day(k) if k is not None else None, n) for n, k in enumerate(days)], "Restaurant string, Review_Date timestamp, n int"), 30, ["n"])
    got = {r["n"]: r["weight"] for r in weighted.collect()}
    median = float(np.median([30 - k for k in days if k is not None]))
    assert all(got[n] == pytest.approx(2 ** (-(30 - k if k is not None else median) / 30)) for n, k in enumerate(days))


def test_bootstrap_draws_for_cells(spark):
    cells = spark.createDataFrame([(1, 1, 0, 3), (1, 0, 1, 40000), (None, 0, 1, 1)], "y int, a int, b int, n long")
    drawn = evaluate.bootstrap_weights(cells, ["y", "a", "b"], 4000, 7)
    for r in drawn.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.countDistinct("rep").alias("reps")).collect():
        assert r["k"] == r["reps"] == 4000
        assert abs(r["m"] - r["n"]) < 5 * (r["n"] / 4000) ** 0.5 and 0.85 * r["n"] < r["v"] < 1.15 * r["n"]
    assert rows_of(drawn) == rows_of(evaluate.bootstrap_weights(cells.orderBy("n"), ["y", "a", "b"], 4000, 7))


def test_bootstrap_is_near_drawing_rows(spark):
    """The interval from cells is that of drawing rows with replacement, to 0.01."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 3000)
    a, b = (np.where(rng.random(3000) < p, y, rng.integers(0, 3, 3000)) for p in (0.8, 0.7))

    def macro(y, p):
        return np.mean([2 * ((y == x) & (p == x)).sum() / max(1, ((y == x).sum() + (p == x).sum())) for x in range(3)])

    plain = [(macro(y[k], a[k]), macro(y[k], b[k])) for k in (rng.integers(0, 3000, 3000) for _ in range(1000))]
    want = [*np.percentile([p[0] for p in plain], [2.5, 50, 97.5]), *np.percentile([p[0] - p[1] for p in plain], [2.5, 97.5])]
    pairs = spark.createDataFrame([(k, int(y[k]), int(a[k]), int(b[k])) for k in range(3000)], "id int, y int, a int, b int")
    got = evaluate.bootstrap_macro_f1(pairs, "id", "y", "a", "b", [0, 1, 2]).first()
    assert np.abs(np.array(tuple(got)) - want).max() < 0.01


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points, vectors = rng.normal(size=(30, 8)), rng.normal(size=(200, 8))
    points[7] = points[3]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(300, None), (301, [1.0]), (302, [None] * 8), (303, [float("inf")] * 8), (304, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)], "label int, centroid array<double>")
    monkeypatch.setattr(match, "_SCORES", 90)
    got = {r["vec_id"]: r for r in match.nearest_centroid(df, table).collect()}
    scores = vectors @ points.T / np.linalg.norm(vectors, axis=1)[:, None] / np.linalg.norm(points, axis=1)
    assert set(got) == {*range(200), 304} and got[304]["score"] == 0.0
    assert all(got[k]["predicted"] == scores[k].argmax() and got[k]["score"] == pytest.approx(scores[k].max()) for k in range(200))
    assert match.nearest_centroid(df, table.limit(0)).count() == 0
    monkeypatch.setattr(match, "MOST_NUMBERS", 100)
    with pytest.raises(ValueError, match="components"):
        match.nearest_centroid(df, table)
