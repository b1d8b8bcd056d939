"""Helpers shared by the corpus operators: word arrays, their hashes, and written intermediate tables."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.sources.tables import written  # noqa: F401  for the operators

#: White space between words: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def release_memory() -> None:
    """Gives what a Python worker no longer uses back to the system, as workers stay on for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# --- arrays -------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string or binary array, and the len + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each text, and the len + 1 word offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space after each word and no other white space, and their offsets."""
    if not len(data):
        return data, offsets
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    starts = offsets[offsets < len(data)]
    keep[starts] = ~space[starts]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return np.where(space, np.uint8(0x20), data)[keep], before[offsets]


#: Bytes of a number with n bytes left, for n from 0 to 8.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words, and longer spans to compare, are taken one by one.
_LONG = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number; zeros follow its end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span data[starts[i]:ends[i]]: eight bytes at a time enter a state that is mixed after each."""
    size, eight = ends - starts, lanes(data)
    out = mix(size.astype(np.uint64) * _ODD + np.uint64(seed))
    step, rows = 0, np.flatnonzero((size > 0) & (size <= _LONG))
    while len(rows):
        out[rows] = mix(out[rows] ^ (eight[starts[rows] + step] & _MASKS[np.minimum(size[rows] - step, 8)]))
        step += 8
        rows = rows[size[rows] > step]
    for k in np.flatnonzero(size > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether data[a[i]:a_ends[i]] equals data[b[i]:b_ends[i]]."""
    size, eight = a_ends - a, lanes(data)
    same = size == b_ends - b
    for k in np.flatnonzero(same & (size > _LONG)):
        same[k] = np.array_equal(data[a[k] : a_ends[k]], data[b[k] : b_ends[k]])
    step, rows = 0, np.flatnonzero(same & (size <= _LONG))
    while len(rows):
        same[rows] = (eight[a[rows] + step] ^ eight[b[rows] + step]) & _MASKS[np.minimum(size[rows] - step, 8)] == 0
        step += 8
        rows = rows[same[rows] & (size[rows] > step)]
    return same


def window_hashes(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (over all of ``words``, text ends not regarded).

    A window is put together from parts of 1, 2, 4, ... words, each join being mixed, so it isn't a sum over its words.
    """
    if len(words) < k:
        return words[:0]
    out, covered, part, width = None, 0, mix(words ^ np.uint64(seed)), 1
    while True:
        if k & width:
            out = part if out is None else mix(out[: len(words) - covered - width + 1] * _ODD + part[covered:])
            covered += width
            if covered == k:
                return out
        part = mix(part[: len(part) - width] * _ODD + part[width:])
        width *= 2


def windows_inside(word_offsets: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """Starts of the windows of k words that lie in one text."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    for back in range(1, k):
        ends = word_offsets[1:] - back
        inside[ends[(ends >= 0) & (ends < n)]] = False
    return np.flatnonzero(inside)


# --- positions ----------------------------------------------------------------


def with_row_index(df: DataFrame, order: list[str], index: str) -> DataFrame:
    """``df`` as a written table with a column ``index``: the place of each row, from 0, in a total order.

    Ranges of the order are sorted each in its task, and written once with the places inside the range; only one row
    for each range (its size) is brought together to find where the range starts.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(index, F.monotonically_increasing_id())
    ranged = written(ranged, "ranges")
    part = F.shiftright(index, 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ranged.join(F.broadcast(starts), part == F.col("_part"))
    return placed.withColumn(index, F.col("_before") + F.col(index).bitwiseAND((1 << 33) - 1)).drop("_part", "_before")
