"""Cells of shards hold a bounded number of rows; queries beyond a broadcast come in chunks."""

import random

import numpy as np
from pyspark.sql import functions as F

from mintleaf.llm import sharding, topk


def test_cells_of_null_texts_hold_as_many_rows_as_others(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("abcdef ") for _ in range(5000))) for k in range(400)] + [(1000 + k, rng.choice([None, "", "x"])) for k in range(40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    plain = sharding.find_cells
    monkeypatch.setattr(sharding, "find_cells", lambda keyed, *more: made.append((keyed, plain(keyed, *more))) or made[-1][1])
    got = sharding.shard_by_bytes(df, 4, cell_rows=1000).collect()
    keyed, cells = made[0]
    fullest = keyed.withColumn("at", cells.column()).groupBy("at.cell").count().agg(F.max("count")).first()[0]
    assert fullest <= 1600 and len(cells.boundaries) > 30
    for s in range(4):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - sum(r["size"] for r in got) / 4) < 5001 + 0.001 * sum(r["size"] for r in got)
    assert len(got) == len(rows)


def test_queries_beyond_a_broadcast_read_the_candidates_in_place(spark, monkeypatch):
    """Vectors of more than one broadcast of queries: chunk by chunk, without a shuffle of the candidates."""
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((600, 32))
    df = spark.createDataFrame([(k * 10, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, topk.top_k(df, 3).collect()))
    monkeypatch.setattr(topk, "MOST_BROADCAST", 10_000)
    plans = []
    plain = topk.written
    monkeypatch.setattr(topk, "written", lambda frame, name: (plans.append(frame._jdf.queryExecution().executedPlan().toString()) if name == "entries" else None) or plain(frame, name))
    assert sorted(map(tuple, topk.top_k(df, 3).collect())) == whole
    assert len(plans) >= 8 and not any("Exchange" in p for p in plans)
