"""Exact deduplication with a heavy-hitter split.

1. One pass over the texts writes (row key, id, digest); the texts aren't read again.
2. Each task runs Misra-Gries with ``counters`` counters over its digests; the summaries are merged and cut back
   to ``counters``. Every digest on more than rows / (counters + 1) rows survives.
3. A second pass over the digests alone counts the survivors exactly and finds the row that stays. These winners,
   at most ``counters`` rows, are broadcast: rows of heavy digests meet their winner map-side and never shuffle.
4. All other digests take an ordinary shuffle, where a group has at most rows / (counters + 1) rows.

``drop_exact_duplicates`` takes the winners' ids in step 3 in place of the row keys of step 1.

Texts are equal when identical after lower-casing A-Z. Null counts as the empty text. The row with the largest id
stays; a null id is smaller than any id; of repeated rows with the same id one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.llm.common import ascii_lower, fresh, written

#: Counters of each Misra-Gries summary, and the most rows that are ever broadcast (about 100 bytes each).
COUNTERS = 1024


def misra_gries(digests: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """Candidates for the digests on more than n / (counters + 1) of n rows, with lower bounds of their counts."""
    found: dict[bytes, int] = {}
    for digest in digests:
        if digest in found:
            found[digest] += 1
        elif len(found) < counters:
            found[digest] = 1
        else:
            found = {d: c - 1 for d, c in found.items() if c > 1}
    return found


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            # the counts of a batch at once: a weighted Misra-Gries step
            for row in batch.column(0).value_counts().to_pylist():
                found[row["values"]] = found.get(row["values"], 0) + row["counts"]
            if len(found) > counters:
                cut = sorted(found.values(), reverse=True)[counters]
                found = {d: c - cut for d, c in found.items() if c > cut}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    return run


def heavy_digests(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified winners (digest, keep_rank, keep_id, group_size) of the frequent digests: at most ``counters`` rows."""
    merged = (
        keyed.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "digest").limit(counters)
        .filter("n > 1").select("digest")
    )
    return (
        keyed.join(F.broadcast(merged), "digest")
        .groupBy("digest").agg(F.max(F.struct("has_id", "id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).isNotNull().alias("has_id"), F.col(id_col).alias("id"), _digest(text_col).alias("digest"))
    # the row numbers are told apart in the written table only, never in ``docs`` again
    keyed = written(keyed, "digests")
    winners = written(heavy_digests(keyed, counters), "heavy")
    marked = keyed.join(F.broadcast(winners), "digest", "left")
    heavy = marked.filter("group_size is not null")
    group = Window.partitionBy("digest")
    light = (
        keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("best", F.max(F.struct("has_id", "id", "row")).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return heavy.unionByName(light).select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that aren't kept; all its columns stay as they are.

    Nothing but the contents of a row decides, so it doesn't matter how ``docs`` is split when it is read again: rows of
    heavy digests that don't have the winner's id go map-side; then each task keeps its best row of a digest, and a
    shuffle the best of all. Of rows with the same id and text the one with the largest hash of all columns stays.
    """
    digest, best, other = fresh(docs, "_digest"), fresh(docs, "_best"), fresh(docs, "_keep_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"])
    keyed = docs.select(_digest(text_col).alias("digest"), F.col(id_col).isNotNull().alias("has_id"), F.col(id_col).alias("id"), F.lit(0).alias("row"))
    keyed = written(keyed, "digests")
    winners = written(heavy_digests(keyed, counters), "heavy").select(F.col("digest").alias(digest), F.struct("best.id").alias(other))
    rows = docs.withColumn(digest, _digest(text_col)).join(F.broadcast(winners), digest, "left")
    rows = rows.filter(F.col(other).isNull() | F.col(f"{other}.id").eqNullSafe(F.col(id_col)))
    order = F.struct(F.col(id_col).isNotNull().alias("a"), F.col(id_col).alias("b"), hashed.alias("c"))
    kept = rows.groupBy(digest).agg(F.max_by(F.struct(*columns), order).alias(best))
    return kept.select(*[F.col(f"{best}.`{c}`").alias(c) for c in docs.columns])
