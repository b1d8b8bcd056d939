"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id), so equal texts lie together. The splitters between shards are found
without sorting: every round counts exact bytes and rows below candidate boundaries (probes) in each partition, adds
the counts up, and places finer probes in the interval that still holds each wanted splitter, until the bytes below
meet the target within the tolerance. In the same way shards are cut into cells of about equal rows, as null and short
texts have few bytes. Then the rows are exchanged once, to these cells, and numbered there.

A boundary falls between texts if one meets the tolerance; inside a larger group of equal texts it is refined over
the ids, so one text on a third of all rows is spread like any other. Rows equal in both text and id stay together.
The tolerance is that of a splitter: no row can be cut, so a row longer than it decides the nearest boundary.
Null texts count as empty with one byte; null ids come before all others. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.llm.common import written

#: Probes of each open interval and round.
FAN_OUT, MOST_PROBES = 64, 1 << 16
#: Rows of a cell, the unit that is sorted in one task after the exchange.
CELL_ROWS = 1 << 18
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
Boundary = tuple[int, int]


def _positions(hashes: np.ndarray, ids: np.ndarray, probes: list[Boundary]) -> np.ndarray:
    """How many probes are at or below each row (a row is below a probe if its (hash, id) is less)."""
    ph, pi = (np.array([p[i] for p in probes], np.int64) for i in (0, 1))
    left, right = np.searchsorted(ph, hashes, "left"), np.searchsorted(ph, hashes, "right")
    out = right.copy()
    for at in np.unique(left[left < right]):
        rows = np.flatnonzero((left == at) & (right > at))
        to = right[rows[0]]
        out[rows] = at + np.searchsorted(pi[at:to], ids[rows], "right")
    return out


def _histogram(probes: list[Boundary]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, _HIGH), np.full(n, _LOW)
        for batch in batches:
            h, i, s = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = _positions(h, i, probes)
            np.add.at(size, at, s)
            rows += np.bincount(at, minlength=n)
            np.minimum.at(least, at, h)
            np.maximum.at(most, at, h)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"at": pa.array(full)} | {k: pa.array(v[full]) for k, v in (("size", size), ("rows", rows), ("least", least), ("most", most))})

    return run


def _counts(keyed: DataFrame, probes: list[Boundary]) -> list[tuple[int, int, int, int]]:
    """Exact bytes and rows, and the least and largest hash, of each interval that the probes bound."""
    counted = (
        keyed.select("h", "i", "size").mapInArrow(_histogram(probes), "at long, size long, rows long, least long, most long")
        .groupBy("at").agg(F.sum("size"), F.sum("rows"), F.min("least"), F.max("most")).collect()  # a row for each probe at most
    )
    out = [(0, 0, 0, 0)] * (len(probes) + 1)
    for at, *values in counted:
        out[at] = tuple(values)
    return out


@dataclass(frozen=True)
class _Interval:
    """Rows from ``low`` to below ``high``, with the bytes and rows below either, and their least and largest hash."""

    low: Boundary
    below: tuple[int, int]
    high: Boundary
    below_high: tuple[int, int]
    least: int
    most: int

    def nearest(self, target: int, measure: int) -> tuple[Boundary, int, int]:
        ends = ((self.low, *self.below), (self.high, *self.below_high))
        return min(ends, key=lambda e: abs(e[1 + measure] - target))

    def inner(self, n: int, ids: tuple[int, int]) -> list[Boundary]:
        """Up to n boundaries inside: over the hashes, or over the ids where one hash is left."""
        if self.least < self.most:
            low, high = self.least, self.most + 1
            step = max(1, (high - low) // (n + 1))
            return [(x, _LOW) for x in range(low + step, high, step)]
        low = max(self.low[1], ids[0]) if self.low[0] == self.least else ids[0]
        high = min(self.high[1], ids[1]) if self.high[0] == self.least else ids[1]
        step = max(1, (high - low) // (n + 1))
        found = [(self.least, x) for x in range(low + step, high + 1, step)]
        return [b for b in ((self.least, _LOW), *found, (self.least, _HIGH)) if self.low < b < self.high]


def find_splitters(keyed: DataFrame, targets: list[int], total: tuple[int, int], tolerances: list[int], measure: int = 0) -> list[tuple[Boundary, int, int]]:
    """For each wanted number of bytes (``measure`` 0) or rows (1) below: the boundary, and the bytes and rows below it.

    The driver holds a few numbers for each splitter, no rows; a round has about MOST_PROBES probes or two for each splitter.
    """
    if not targets or not total[1]:
        return [((_LOW, _LOW), 0, 0)] * len(targets)
    least, most, *ids = keyed.agg(F.min("h"), F.max("h"), F.min("i"), F.max("i")).first()
    around = [_Interval((_LOW, _LOW), (0, 0), (_HIGH, _HIGH), total, least, most)] * len(targets)
    closed = [False] * len(targets)
    while True:
        probes: set[Boundary] = set()
        fan_out = max(2, min(FAN_OUT, MOST_PROBES // max(1, len(closed) - sum(closed))))
        for k, (x, target) in enumerate(zip(around, targets, strict=True)):
            closed[k] = closed[k] or abs(x.nearest(target, measure)[1 + measure] - target) <= tolerances[k] or x.below_high[1] - x.below[1] <= 1
            if not closed[k]:
                inner = x.inner(fan_out - 1, ids)
                closed[k] = not inner
                probes.update((x.low, *inner, x.high) if inner else ())
        if not probes:
            return [x.nearest(target, measure) for x, target in zip(around, targets, strict=True)]
        order = sorted(probes)
        counts = _counts(keyed, order)
        place = {b: k for k, b in enumerate(order)}
        for k, (x, target) in enumerate(zip(around, targets, strict=True)):
            if closed[k]:
                continue
            below, at = x.below, place[x.low]
            while order[at] < x.high:
                size, rows, least, most = counts[at + 1]
                above = (below[0] + size, below[1] + rows)
                if above[measure] > target or order[at + 1] == x.high:
                    around[k] = _Interval(order[at], below, order[at + 1], above, least, most)
                    break
                below, at = above, at + 1


@dataclass(frozen=True)
class Cells:
    """Boundaries of the cells, and for each cell its shard and the slot of its first row."""

    boundaries: list[Boundary]
    shard: list[int]
    first: list[int]

    def column(self) -> Column:
        """struct<cell, shard, first> of the columns h and i."""
        boundaries, shard, first = self.boundaries, np.array(self.shard, np.int32), np.array(self.first, np.int64)

        @F.arrow_udf("struct<cell: int, shard: int, first: long>")
        def number(h: pa.Array, i: pa.Array) -> pa.Array:
            cell = _positions(h.to_numpy(zero_copy_only=False), i.to_numpy(zero_copy_only=False), boundaries) if boundaries else np.zeros(len(h), np.int64)
            return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(shard[cell]), pa.array(first[cell])], names=["cell", "shard", "first"])

        return number(F.col("h"), F.col("i"))


def find_cells(keyed: DataFrame, shards: int, total: tuple[int, int], tolerance: float, cell_rows: int) -> Cells:
    """Shards of equal bytes, cut into cells of about ``cell_rows`` rows each, however few bytes these have."""
    tight = max(1, int(total[0] / shards * tolerance))
    ends = sorted((b, rows) for b, _, rows in find_splitters(keyed, [total[0] * k // shards for k in range(1, shards)], total, [tight] * (shards - 1)))
    edges = [0, *(rows for _, rows in ends), total[1]]
    inside = [x for low, high in zip(edges[:-1], edges[1:], strict=True) for x in range(low + cell_rows, high - cell_rows // 2, cell_rows)]
    cuts = find_splitters(keyed, inside, total, [max(1, cell_rows // 4)] * len(inside), measure=1)
    below = dict(ends) | {b: rows for b, _, rows in cuts}
    boundaries = sorted(below)
    shard = [0, *(bisect.bisect_right(ends, b, key=lambda e: e[0]) for b in boundaries)]
    rows = [0, *(below[b] for b in boundaries)]
    return Cells(boundaries, shard, [n - edges[s] for n, s in zip(rows, shard, strict=True)])


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (gapless within the shard, in key order).

    ``tolerance`` is a share of a shard's bytes. Each shard is cut into cells of about ``cell_rows`` rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = written(
        docs.select(
            F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("i"), F.xxhash64(text).alias("h"),
            (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        ),
        "shardkeys",
    )
    got = keyed.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).first()
    total = (got["size"] or 0, got["rows"])
    cells = find_cells(keyed, shards, total, tolerance, cell_rows)
    in_cell = Window.partitionBy("at.cell").orderBy("h", "i", "size")
    return keyed.withColumn("at", cells.column()).withColumn("slot", F.row_number().over(in_cell) - 1 + F.col("at.first")).select(
        "id", "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("slot").cast("long").alias("slot")
    )
