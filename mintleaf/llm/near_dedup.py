"""MinHash near-deduplication by a signature-coordinate inverted join.

1. Each document gets its set of distinct word shingles (as 64-bit hashes) and a signature of ``COORDINATES`` minima.
   Documents of equal sets meet by a fingerprint of the set; one of each goes on.
2. Postings: a document stands under each (coordinate, value) pair of its signature. Pairs that hold one document are
   skipped. Two documents are candidates if they stand together ``MATCHES`` times or more, so a document with fewer
   shared pairs drops out, and of the others the rarest ``shared - MATCHES + 1`` pairs (the prefix) are enough to meet
   any candidate: only these short lists are merged. The long lists are skipped there, and enter the collision count
   afterwards, for the candidates alone.
3. Lists aren't expanded into all pairs. Round by round each list compares its members with one pivot; members that
   are linked share a component and need no further comparison. When rounds bring little more, the documents of lists
   that still hold several components meet by the rarest shingles of their full sets, as many as the similarity asks
   for, so that no link is missed; documents of one component don't meet there.
4. Candidates that reach the match threshold are confirmed on the full shingle sets; the confirmed links give the
   components.

At a similarity of 0.75 a pair has 48 matches of 64 on average; it falls below 32 with a probability under 10^-5.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text of fewer words than a shingle has its whole sequence
as its one shingle. Texts without words (null, empty) link with nothing. Rows with equal ids are one document: they
share a component. Rows with a null id are kept, link with nothing and have no component. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.llm.common import fresh, mix, release_memory, string_bytes, window_hashes, windows_inside, word_hashes, word_spans, written
from mintleaf.llm.components import component_labels

SHINGLE_WORDS, COORDINATES, MATCHES = 5, 64, 32
#: Similarity of a link: NUM * union <= DEN * intersection.
NUM, DEN = 75, 100
#: A table of ids is broadcast up to so many rows (12 bytes each), and shuffled beyond.
BROADCAST_IDS = 1 << 20
PIVOT_ROUNDS = 4
_SEED = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(75)
_A = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = string_bytes(texts)
    data = _LOWER[raw]
    starts, ends, words = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends, _SEED)
    inside = windows_inside(words, k, len(hashes))
    full = window_hashes(hashes, k, _SEED)
    cuts = np.searchsorted(inside, words)
    sets = []
    for i in range(len(texts)):
        n = words[i + 1] - words[i]
        if n >= k:
            sets.append(np.unique(full[inside[cuts[i] : cuts[i + 1]]]))
        else:
            sets.append(window_hashes(hashes[words[i] : words[i + 1]], n, _SEED + n) if n else hashes[:0])
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least hash of each coordinate."""
    least = np.full(COORDINATES, ~np.uint64(0))
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                sets = shingle_sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc", "n", "fp", "sig"],
                )
            release_memory()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                sets = shingle_sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "fp", "shingles"]
                )
            release_memory()

    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, doc): the hash of each (coordinate, value) pair of a signature."""
    coordinate = np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
        pairs = mix(values.astype(np.uint64) | coordinate)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES))], names=["pair", "doc"]
        )


def _linked():
    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        """Whether two shingle sets reach the similarity."""
        out = []
        for x, y in zip(a, b, strict=True):
            both = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(NUM * (len(both) - common) <= DEN * common)
        return pa.array(out)

    return linked


def _active(reps: DataFrame) -> DataFrame:
    """(doc, n, pairs, prefix) of the documents that share MATCHES pairs or more with any others."""
    postings = reps.select("doc", "sig").mapInArrow(_post, "pair long, doc long")
    shared = postings.groupBy("pair").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = (
        postings.join(shared, "pair").groupBy("doc")
        .agg(F.sort_array(F.collect_list(F.struct("df", "pair"))).alias("found"))  # at most COORDINATES
        .filter(F.size("found") >= MATCHES)
    )
    return lists.join(reps.select("doc", "n", "fp"), "doc").select(
        "doc", "n", "fp", F.aggregate("found.df", F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"), F.col("found.pair").alias("pairs"), F.slice("found.pair", F.lit(1), F.size("found") - MATCHES + 1).alias("prefix")
    )


def _confirmed(candidates: DataFrame, active: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (a, b, u, v) that reach the match threshold and then the similarity on the full sets, as edges (u, v)."""
    counted = candidates
    for c in ("a", "b"):
        counted = counted.join(active.select(F.col("doc").alias(c), F.col("pairs").alias(f"pairs_{c}"), F.col("n").alias(f"n_{c}")), c)
    counted = counted.filter((F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM) & (F.size(F.array_intersect("pairs_a", "pairs_b")) >= MATCHES))
    counted = counted.select("a", "b", "u", "v")
    for c in ("a", "b"):
        counted = counted.join(sets.select(F.col("doc").alias(c), F.col("shingles").alias(f"set_{c}")), c)
    return counted.filter(_linked()("set_a", "set_b")).select("u", "v").distinct()


def _pairs(posted: DataFrame, other: str, component: str) -> DataFrame:
    """(a, b, u, v): a pair of documents in one order, and their components."""
    one, two = F.struct(F.col("doc").alias("d"), F.col("component").alias("c")), F.struct(F.col(other).alias("d"), F.col(component).alias("c"))
    pair = posted.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    return pair.select(F.col("x.d").alias("a"), F.col("y.d").alias("b"), F.col("x.c").alias("u"), F.col("y.c").alias("v")).distinct()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n, shingle) of each shingle of a set."""
    for batch in batches:
        for part in _slices(batch):
            sets = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(1)]
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["doc", "n", "shingle"]
            )


def _open_pairs(posted: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, u, v) of documents in different components that may reach the similarity.

    Only documents of lists with two components or more are looked at. Their shingles are put in the order of rising
    frequency; two sets of the wanted similarity share a shingle within their first n - o + 1, where o is the overlap
    that their sizes ask for. In the list of a shingle all but the largest component meet the others.
    """
    several = posted.groupBy("pair").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("pair")
    open_docs = posted.join(several, "pair", "left_semi").select("doc", "component").distinct()
    open_docs = written(open_docs, "open")
    rows = sets.select("doc", "shingles").join(open_docs.select("doc"), "doc", "left_semi").mapInArrow(_explode, "doc long, n long, shingle long")
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = rows.join(shared, "shingle")
    order = Window.partitionBy("doc").orderBy("df", "shingle")
    # shingles that no other has come first in the order; they can't be shared
    placed = known.withColumn("r", F.row_number().over(order)).withColumn("own", F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("doc")))
    least = F.ceil(F.col("n") * NUM / DEN)
    prefix = placed.withColumn("pos", F.col("own") + F.col("r")).filter(F.col("pos") <= F.col("n") - least + 1).join(open_docs, "doc").select("shingle", "doc", "component", "n", "pos")
    prefix = written(prefix, "prefixes")
    sizes = prefix.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("shingle").agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("shingle", F.col("m.component").alias("most"))
    largest = written(largest, "largest")
    few = prefix.join(largest, "shingle").filter("component != most").drop("most")
    other = prefix.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("doc", "component", "n", "pos")])
    need = F.ceil((F.col("n") + F.col("other_n")) * NUM / (NUM + DEN))
    near = (F.col("component") != F.col("other_component")) & (F.col("pos") <= F.col("n") - need + 1) & (F.col("other_pos") <= F.col("other_n") - need + 1)
    return _pairs(few.join(other, (few["shingle"] == other["shingle"]) & near), "other_doc", "other_component")


def _link(active: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc, component) of the active documents."""
    labels = active.select("doc", F.col("doc").alias("component"))
    before = None
    for turn in range(PIVOT_ROUNDS + 1):
        posted = written(active.join(labels, "doc").select("doc", "component", "weight", F.explode("prefix").alias("pair")), "lists")
        # pairs of members in different components, over all lists
        sizes = posted.groupBy("pair", "component").agg(F.count(F.lit(1)).alias("c"))
        each = sizes.groupBy("pair").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        left = each.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0
        if not left:
            break
        last = turn == PIVOT_ROUNDS or before is not None and left > 0.5 * before
        before = left
        if last:
            met = _open_pairs(posted, sets)
        else:
            # the pivot is the member that shares most with others at first, and any later
            order = -F.col("weight") if turn == 0 else F.xxhash64(F.col("doc"), F.lit(turn))
            pivots = posted.groupBy("pair").agg(F.min(F.struct(order.alias("o"), "doc", "component")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1")
            pivots = written(pivots.select("pair", F.col("p.doc").alias("pivot"), F.col("p.component").alias("pivot_component")), "pivots")
            met = _pairs(posted.join(pivots, "pair").filter("component != pivot_component"), "pivot", "pivot_component")
        candidates = written(met, "candidates")
        grouped = component_labels(_confirmed(candidates, active, sets))
        labels = labels.join(grouped.withColumnRenamed("node", "component"), "component", "left").select("doc", F.coalesce("label", "component").alias("component"))
        labels = written(labels, "documents")
        if last:
            break
    return labels


def _representatives(signed: DataFrame) -> DataFrame:
    """(fp, doc, least, n, sig): a row for each set, ``least`` the least id with it, and ``doc`` a number that no other set has.

    That is the least id, unless other sets have the same one, as where rows of one id have different texts: all but one of
    these get numbers beyond all ids.
    """
    found = signed.filter("fp is not null and doc is not null").groupBy("fp").agg(F.min("doc").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    found = written(found, "found")
    taken = found.groupBy("least").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    others = found.select("fp", "least").join(taken, "least").filter("fp != first")
    others = written(others.select("fp", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("other")), "others")
    return written(found.join(others, "fp", "left").select("fp", F.coalesce("other", "least").alias("doc"), "least", "n", "sig"), "sets")


def _meet_by_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` (fp, component), with the components joined that have rows of one id: rows of one id are one document."""
    ids = signed.filter("fp is not null and doc is not null").groupBy("doc").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x != y").select("doc")
    ids = written(ids, "repeated")
    if not ids.limit(1).count():
        return classes
    met = written(signed.select("doc", "fp").join(ids, "doc", "left_semi").join(classes, "fp").select("doc", "component").distinct(), "met")
    least = met.groupBy("doc").agg(F.min("component").alias("v"))
    joined = component_labels(met.join(least, "doc").select(F.col("component").alias("u"), "v"))
    return classes.join(joined.withColumnRenamed("node", "component"), "component", "left").select("fp", F.coalesce("label", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the least id of its component), kept.

    Rows with the same id are one document, whatever their texts: they are in one component, and a set is a row's own.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = written(texts.mapInArrow(_sign(k), "doc long, n long, fp binary, sig binary"), "signatures")
    reps = _representatives(signed)
    active = written(_active(reps), "active")
    chosen = reps.select("fp", "doc", "least").join(active.select("doc"), "doc", "left_semi")
    wanted = chosen.select(F.col("least").alias("doc")).distinct()
    small = active.count() <= BROADCAST_IDS
    sets = texts.join(F.broadcast(wanted) if small else wanted, "doc", "left_semi").mapInArrow(_sets(k), "doc long, fp binary, shingles binary")
    sets = written(sets.withColumnRenamed("doc", "least").join(chosen, ["least", "fp"]).select("doc", "shingles"), "shingles")
    labels = _link(active, sets)
    classes = written(reps.select("fp", "doc").join(labels, "doc", "left").select("fp", F.coalesce("component", "doc").alias("component")), "classes")
    named = _meet_by_id(signed, classes)
    out = signed.join(named, "fp", "left").select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))
    return out.select(F.col("doc").alias("id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id. All columns stay as they are."""
    gone = near_duplicates(docs, id_col, text_col, k).filter("not kept").select("id").distinct()
    key = fresh(docs, "_id")
    return docs.withColumn(key, F.col(id_col).cast("long")).join(gone.withColumnRenamed("id", key), key, "left_anti").drop(key)
