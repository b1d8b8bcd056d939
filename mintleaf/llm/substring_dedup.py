"""Removal of repeated passages: windows of ``k`` consecutive words, counted by super-k-mer partitioning.

Map: in every batch of texts the minimiser of a window is the least hash among its groups of ``MINIMISER_WORDS`` words.
Consecutive windows of one text with the same minimiser travel as one packed string (a super-k-mer) to the bucket of
that minimiser; equal windows always meet there. A window that starts earlier in the same batch is settled there and
doesn't travel, so a passage that a third of all texts share reaches its bucket once for each batch. The strings of a
batch and bucket are compressed together.
Bucket: the windows are sorted by a hash of their words, and those of one hash compared word for word; all but the
earliest of equal ones are repeats. A task holds ``most_bytes`` of a bucket. A bucket with more (distinct windows
around one frequent phrase) is settled stretch by stretch; the windows that are left of each stretch are dealt out
again, each by itself, and Spark compares them by their words.
Then the repeats of each text (runs of window starts, never more than its words) are joined with the texts again.

A word is ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is a repeat if its words also start earlier: in a text with a
smaller id, or before it in the same text. Every word under a repeat goes. Windows are judged on the input. Null and
empty texts have no words; texts of fewer than k words keep all; a null id comes before all others; rows with equal
ids at equal starts aren't earlier than one another, so both stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.llm.common import joined_words, same_bytes, string_bytes, window_hashes, windows_inside, word_hashes, word_spans, written

MINIMISER_WORDS = 3
#: Bytes of texts that are worked on at a time, and about the bytes of packed strings in a bucket.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Bytes of strings that a task holds of one bucket; what a fuller bucket holds is split by window.
MOST_BYTES = 16 << 20
_LOW = -(1 << 63)
_SEEDS = (11, 12)
#: Of the compression of packed strings.
LEVEL = 3


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _repeats(keys: np.ndarray, doc: np.ndarray, start: np.ndarray, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the words data[low:high] of each window are those of one with a smaller (doc, start).

    Windows of equal keys are compared by their bytes; where a key stands for several windows these are told apart.
    """
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return out
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    rows = np.flatnonzero(shared)
    rows = rows[np.lexsort((start[rows], doc[rows], keys[rows]))]
    new = np.ones(len(rows), bool)
    new[1:] = keys[rows][1:] != keys[rows][:-1]
    first = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    equal = same_bytes(data, low[rows], high[rows], low[first], high[first])
    if not equal.all():
        mixed = np.isin(keys[rows], keys[rows[~equal]])
        firsts: dict[bytes, int] = {}
        for k in np.flatnonzero(mixed):
            first[k] = firsts.setdefault(data[low[rows[k]] : high[rows[k]]].tobytes(), rows[k])
    out[rows] = (doc[rows] != doc[first]) | (start[rows] != start[first])
    return out


def _runs(text: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive starts of one text, from windows in (text, start) order: text, doc, start, length."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return text[at], doc[at], start[at], np.diff(np.append(at, len(text)))


_PACKED = "bucket int, text binary, doc binary, start binary, length binary, strings binary"
_FOUND = "text long, doc long, start int, windows int, hash long, words binary"


def _row(bucket: int, text, doc, start, length, strings: bytes) -> tuple:
    return bucket, text.astype(np.int64).tobytes(), doc.astype(np.int64).tobytes(), start.astype(np.int32).tobytes(), length.astype(np.int32).tobytes(), strings


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("bucket", pa.int32()), *((c, pa.binary()) for c in ("text", "doc", "start", "length", "strings"))]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BATCH_BYTES."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _pack(k: int, buckets: int):
    import zstandard

    def rows_of(part: pa.RecordBatch) -> list[tuple]:
        text, doc = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
        data, offsets = joined_words(*string_bytes(part.column(2)))
        starts, ends, texts = word_spans(data, offsets)
        at = windows_inside(texts, k, len(starts))
        if not len(at):
            return []
        words = word_hashes(data, starts, ends, _SEEDS[0])
        owner = np.searchsorted(texts, at, "right") - 1
        start = at - texts[owner]
        least = _sliding_min(window_hashes(words, MINIMISER_WORDS, _SEEDS[0]), k - MINIMISER_WORDS + 1)[at]
        settled = _repeats(window_hashes(words, k, _SEEDS[1])[at], doc[owner], start, data, starts[at], ends[at + k - 1])
        rows = []
        if settled.any():
            t, d, s, n = _runs(text[owner[settled]], doc[owner[settled]], start[settled])
            rows.append(_row(int(t[0] % buckets), t, d, s, n, b""))
        at, owner, start, least = at[~settled], owner[~settled], start[~settled], least[~settled]
        if not len(at):
            return rows
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        low, high = starts[at[first]], ends[at[last] + k - 1]
        bucket = (least[first] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        raw, squeeze = data.tobytes(), zstandard.ZstdCompressor(level=LEVEL).compress
        for a, z in zip(cuts, cuts[1:], strict=False):
            own = order[a:z]
            strings = b"".join([raw[x:y] for x, y in zip(low[own].tolist(), high[own].tolist(), strict=True)])
            own_first = first[own]
            rows.append(_row(int(bucket[own[0]]), text[owner[own_first]], doc[owner[own_first]], start[own_first], high[own] - low[own], squeeze(strings)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                yield _batch(rows_of(part))

    return run


def _found(runs=None, windows=None) -> pa.RecordBatch:
    """A batch of _FOUND: runs of repeats, or windows (text, doc, start, hash, words) that are still open."""
    text, doc, start, n = runs if runs is not None else (*windows[:3], np.ones(len(windows[0])))
    columns = [x.astype(t) for x, t in zip((text, doc, start, n), (np.int64, np.int64, np.int32, np.int32), strict=True)]
    more = [pa.nulls(len(text), pa.int64()), pa.nulls(len(text), pa.binary())] if windows is None else [pa.array(windows[3].view(np.int64)), pa.array(windows[4], pa.binary())]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *more], names=["text", "doc", "start", "windows", "hash", "words"])


def _count(k: int, most_bytes: int):
    import zstandard

    def counted(rows: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
        """The repeats among packed strings of one bucket; unless these are all, also the windows that aren't."""
        text, doc, start, length = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in ((1, np.int64), (2, np.int64), (3, np.int32), (4, np.int32)))
        grow = zstandard.ZstdDecompressor().decompress
        data = np.frombuffer(b"".join([grow(r[5]) for r in rows]), np.uint8)
        starts, ends, texts = word_spans(data, np.concatenate([[0], np.cumsum(length, dtype=np.int64)]))
        at = windows_inside(texts, k, len(starts))
        owner = np.searchsorted(texts, at, "right") - 1
        begin = start[owner] + (at - texts[owner])
        hashes = window_hashes(word_hashes(data, starts, ends, _SEEDS[0]), k, _SEEDS[1])[at]
        low, high = starts[at], ends[at + k - 1]
        repeat = _repeats(hashes, doc[owner], begin, data, low, high)
        yield _found(runs=_runs(text[owner[repeat]], doc[owner[repeat]], begin[repeat]))
        if not whole:
            left = np.flatnonzero(~repeat)
            for cut in range(0, len(left), 1 << 14):
                own = left[cut : cut + (1 << 14)]
                words = [data[a:b].tobytes() for a, b in zip(low[own].tolist(), high[own].tolist(), strict=True)]
                yield _found(windows=(text[owner[own]], doc[owner[own]], begin[own], hashes[own], words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[tuple] = []
        size, whole = 0, True
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not row[5]:  # settled in its batch
                    yield _found(runs=tuple(np.frombuffer(row[c], t) for c, t in ((1, np.int64), (2, np.int64), (3, np.int32), (4, np.int32))))
                    continue
                more = int(np.frombuffer(row[4], np.int32).sum(dtype=np.int64))
                if open_rows and open_rows[0][0] != row[0]:
                    yield from counted(open_rows, whole)
                    open_rows, size, whole = [], 0, True
                elif open_rows and size + more > most_bytes:
                    yield from counted(open_rows, False)
                    open_rows, size, whole = [], 0, False
                open_rows.append(row)
                size += more
        if open_rows:
            yield from counted(open_rows, whole)

    return run


def _kept(k: int):
    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: string>")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        # few Python strings at a time
        return pa.concat_arrays([cut_some(texts.slice(at, 512), runs.slice(at, 512)) for at in range(0, max(len(texts), 1), 512)])

    def cut_some(texts: pa.Array, runs: pa.Array) -> pa.Array:
        n_words, n_removed, kept = [], [], []
        for text, own in zip(texts.cast(pa.binary()).to_pylist(), runs.to_pylist(), strict=True):
            words = (text or b"").split()  # on exactly \x20 and \x09-\x0D
            n_words.append(len(words))
            gone = 0
            if own:
                change = np.zeros(len(words) + 1, np.int64)
                at = np.array([r["start"] for r in own])
                np.add.at(change, at, 1)
                np.add.at(change, at + np.array([r["windows"] for r in own]) + k - 1, -1)
                stays = np.cumsum(change[:-1]) == 0
                gone = len(words) - int(stays.sum())
                words = [words[i] for i in np.flatnonzero(stays)]
            n_removed.append(gone)
            kept.append(b" ".join(words).decode())
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])

    return cut


def repeated_windows(keyed: DataFrame, k: int, buckets: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(text, doc, start, windows): runs of repeated windows, from (hash of the text, doc, text)."""
    packed = keyed.mapInArrow(_pack(k, buckets), _PACKED)
    found = written(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(k, most_bytes), _FOUND), "windows")
    # open windows of overfull buckets, one of each stretch that a task held; the earliest of equal ones is no repeat
    first = F.min(F.struct("doc", "start")).over(Window.partitionBy("hash", "words"))
    later = found.filter("words IS NOT NULL").withColumn("first", first).filter(F.struct("doc", "start") > F.col("first"))
    columns = ["text", "doc", "start", "windows"]
    return found.filter("words IS NULL").select(*columns).unionByName(later.select(*columns))


def remove_repeats(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the kept words, joined by one space). Ids are integers.

    Runs find their text by id and text hash: rows that are equal in both have the same repeats.
    """
    if k <= MINIMISER_WORDS:
        raise ValueError(f"k must be over {MINIMISER_WORDS}")
    keyed = docs.select(F.xxhash64(text_col).alias("hash"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * size // bucket_bytes)
    runs = repeated_windows(keyed.select("hash", "doc", "text"), k, buckets, most_bytes)
    # at most the windows of one text
    by_text = runs.groupBy(F.col("text").alias("hash"), "doc").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    return (
        keyed.join(by_text, ["doc", "hash"], "left").withColumn("cut", _kept(k)("text", "runs"))
        .select("id", F.col("cut.n_words").alias("n_words"), F.col("cut.n_removed").alias("n_removed"), F.col("cut.kept").alias("kept"))
    )
