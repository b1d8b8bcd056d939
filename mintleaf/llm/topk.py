"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of ``PARTS`` partial products over consecutive ranges of the vector's components. A node has one
range of one batch of candidates; the nodes of a batch are in one task, beside the vectors. The queries come to the
candidates, by broadcasts of about ``MOST_BROADCAST`` bytes one after the other.

1. A task gathers the best entries of each query on its nodes over all its blocks, with the scores of their candidates.
   The best of all tasks give a safe cutoff: the score that k candidates reach already.
2. The cutoff goes back with the queries. Whoever scores at least the cutoff has at least an equal share of it in one
   range, so each node collects exactly its entries that reach cutoff / PARTS, however many these are.
3. What was collected is resolved exactly where the vectors are: the other ranges are added, and what reaches the cutoff
   leaves the task.

Components count as floor(256 * x). Equal vectors are searched as one, with its least k + 1 ids. Vectors that are null,
empty or hold null or non-finite components take no part; vectors of other lengths aren't candidates of a query.
Rows with a null id take no part; of rows with equal id and vector one counts. Ties go to the smaller id. Ids are
integers. Products are exact: where they could leave 2^53 they are worked out in whole numbers, and a score that a
long can't hold counts as the nearest long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.llm.common import written

PARTS = 2
#: Rows of a block: a node holds a matrix of QUERY_BLOCK * CANDIDATE_BLOCK numbers.
QUERY_BLOCK, CANDIDATE_BLOCK = 256, 8192
#: Bytes of queries that go to every task at a time.
MOST_BROADCAST = 32 << 20
_NONE, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.filter(F.col(id_col).isNotNull() & usable)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def _ranges(dim: int) -> list[slice]:
    cuts = [dim * p // PARTS for p in range(PARTS + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _by_length(ids: pa.Array, vectors: pa.Array, *more: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(length, [ids, matrix, ...]) of the vectors of each length, in blocks."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        for at in range(0, len(own), CANDIDATE_BLOCK):
            rows = pa.array(own[at : at + CANDIDATE_BLOCK])
            matrix = vectors.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
            yield int(n), [ids.take(rows).to_numpy(zero_copy_only=False), matrix, *(m.take(rows).to_numpy(zero_copy_only=False) for m in more)]


def _query_blocks(table: pa.Table) -> dict[int, list[tuple]]:
    """Blocks (ids, matrix, cutoffs) of (cid, v, cut) by length of the vectors."""
    out: dict[int, list[tuple]] = {}
    if table.num_rows:
        for n, (ids, matrix, cut) in _by_length(*(table[c].combine_chunks() for c in ("cid", "v", "cut"))):
            out.setdefault(n, []).extend((ids[a : a + QUERY_BLOCK], matrix[a : a + QUERY_BLOCK], cut[a : a + QUERY_BLOCK]) for a in range(0, len(ids), QUERY_BLOCK))
    return out


def _everywhere(queries: DataFrame, candidates: DataFrame, make) -> DataFrame:
    """The entries (q, c, score) that ``make()``, a worker with ``tile`` and ``close``, gives for all queries (cid, v, cut) on all candidates (cid, v).

    The candidates are read in place, once for each chunk of ``MOST_BROADCAST`` bytes of queries; the entries of a chunk are
    written before the next one is broadcast.
    """
    size = queries.agg(F.sum(8 * F.size("v") + 32)).first()[0] or 0
    chunks = max(1, -(-size // MOST_BROADCAST))

    def met(own: DataFrame) -> tuple[DataFrame, Broadcast]:
        held = own.sparkSession.sparkContext.broadcast(_query_blocks(own.select("cid", "v", "cut").toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker = make()
            for batch in batches:
                for n, (c_ids, c) in _by_length(batch.column(0), batch.column(1)):
                    for q_ids, q, cut in held.value.get(n, ()):
                        yield from worker.tile(q_ids, cut, c_ids, _parts(q, c))
            yield from worker.close()

        return candidates.select("cid", "v").mapInArrow(run, _ENTRY), held

    if chunks == 1:
        return met(queries)[0]
    out: DataFrame | None = None
    for k in range(chunks):
        entries, held = met(queries.filter(F.pmod(F.xxhash64("cid"), F.lit(chunks)) == k))
        entries = written(entries, "entries")
        held.unpersist()
        out = entries if out is None else out.unionByName(entries)
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices; whole numbers of any size where a long might not hold a sum."""
    most = max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0)))) * max(abs(int(c.max(initial=0))), abs(int(c.min(initial=0)))) * max(1, q.shape[1]) * PARTS
    if most < 1 << 53:
        return q.astype(np.float64) @ c.astype(np.float64).T
    if most < 1 << 62:
        return q @ c.T
    return q.astype(object) @ c.astype(object).T


def _longs(x: np.ndarray) -> np.ndarray:
    return np.clip(x, _NONE, _MOST).astype(np.int64) if x.dtype == object else x.astype(np.int64)


def _parts(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The partial products of each node."""
    return [_products(q[:, r], c[:, r]) for r in _ranges(q.shape[1])]


def _entries(q_ids, c_ids, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_ids, pa.int64()), pa.array(c_ids, pa.int64()), pa.array(score, pa.int64())], names=["q", "c", "score"])


_ENTRY = "q long, c long, score long"


class LocalLists:
    """The candidates of the k best entries of each query on the nodes of a task, with their scores."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def tile(self, q_ids, cut, c_ids, parts) -> Iterator[pa.RecordBatch]:
        score, n = sum(parts[1:], parts[0]), min(self.k, len(c_ids))
        best = np.concatenate([np.argpartition(s, len(c_ids) - n, axis=1)[:, len(c_ids) - n :] for s in parts], axis=1)
        best.sort(axis=1)
        found, names = _longs(np.take_along_axis(score, best, 1)), c_ids[best]
        found[:, 1:][best[:, 1:] == best[:, :-1]] = _NONE  # on several nodes
        key = q_ids.tobytes()
        if key in self.held:
            names, found = np.concatenate([self.held[key][1], names], axis=1), np.concatenate([self.held[key][2], found], axis=1)
        if found.shape[1] > self.k:
            top = np.argpartition(found, found.shape[1] - self.k, axis=1)[:, found.shape[1] - self.k :]
            names, found = np.take_along_axis(names, top, 1), np.take_along_axis(found, top, 1)
        self.held[key] = q_ids, names, found
        return iter(())

    def close(self) -> Iterator[pa.RecordBatch]:
        for q_ids, names, found in self.held.values():
            own = found > _NONE
            yield _entries(np.repeat(q_ids, own.sum(axis=1)), names[own], found[own])


class Resolved:
    """Of all entries of a node that reach an equal share of the query's cutoff, those whose score reaches the cutoff."""

    def tile(self, q_ids, cut, c_ids, parts) -> Iterator[pa.RecordBatch]:
        # the share is rounded down, which collects no less
        share = (cut.astype(object) if any(s.dtype == object for s in parts) else cut) // PARTS
        collected = np.zeros(parts[0].shape, bool)
        for s in parts:
            collected |= (s >= share[:, None]).astype(bool)
        i, j = np.nonzero(collected)
        score = _longs(sum((s[i, j] for s in parts[1:]), parts[0][i, j]))
        reach = score >= cut[i]
        yield _entries(q_ids[i[reach]], c_ids[j[reach]], score[reach])

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose id is divisible by ``query_every``."""
    own = quantised(vectors, id_col, vector_col).withColumns({"a": F.xxhash64(F.lit(1), "v"), "b": F.xxhash64(F.lit(2), "v")})
    # the least k + 1 ids of each distinct vector; Spark limits the rows of a vector before it shuffles them
    ranked = own.distinct().withColumn("r", F.row_number().over(Window.partitionBy("a", "b", "v").orderBy("id"))).filter(F.col("r") <= k + 1)
    distinct = ranked.groupBy("a", "b", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = written(distinct.select(F.col("ids")[0].alias("cid"), "ids", "v", "a", "b"), "vectors")
    # queries find their vector by two hashes of it, so the vectors needn't move
    asked = own.filter(F.col("id") % query_every == 0).dropDuplicates(["id", "a", "b"])
    asked = written(asked.join(distinct.select("a", "b", "cid"), ["a", "b"]).select(F.col("id").alias("query_id"), "cid", "v"), "queries")
    queries = written(asked.groupBy("cid").agg(F.first("v").alias("v")), "asked")
    candidates, wide = distinct.select("cid", "v"), k + 1  # a query's own vector may be among the best

    # 1: local lists, and the cutoff that the best of them give
    lists = _everywhere(queries.withColumn("cut", F.lit(_NONE).cast("long")), candidates, lambda: LocalLists(wide))
    kth = lists.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("r") == wide)
    cutoffs = kth.select(F.col("q").alias("cid"), F.col("score").alias("cut"))

    # 2 and 3: the cutoff goes with the queries; what is collected is resolved
    with_cut = queries.join(cutoffs, "cid", "left").select("cid", "v", F.coalesce("cut", F.lit(_NONE).cast("long")).alias("cut"))
    scores = _everywhere(written(with_cut, "cutoffs"), candidates, Resolved)
    kept = scores.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("r") <= wide)
    named = kept.join(distinct.select(F.col("cid").alias("c"), "ids"), "c").select(F.col("q").alias("cid"), "score", F.explode("ids").alias("vec_id"))
    found = asked.select("query_id", "cid").join(named, "cid").filter("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
