"""Language identification with string kernels: Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of byte n-grams of ``ORDERS`` that both hold (presence, not frequency, of the
lower-cased UTF-8 text), over the geometric mean of what each holds; n-grams that no landmark holds don't count. Texts
are mapped to kernel values with the landmarks, times the inverse root of the landmarks' own kernel matrix. Ridge
regression on that map with targets 1 and -1 for each language is the Nyström form of kernel ridge regression; its
normal equations are added up over the training texts in tasks. As the landmarks enter linearly, the fitted model is
one weight for each n-gram and language: a batch is scored by the product of its presence matrix with the weights.

Training takes ``per_language`` distinct whole texts of each language (those of the least text hash), a documented
bound, and of these ``landmarks`` of each language as landmarks (fewer where there are many languages). The driver
holds the landmarks, and a square matrix of their number. Every text of the input is scored as a whole.

A text that is null or has no letter gets ``und`` and score 0; so does every text if there is nothing to learn from.
The score is (1 + the largest regression value) / 2, held within 0 and 1; ties go to the language that sorts first.
Rows with a null language or id aren't learnt from, but predicted. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mintleaf.llm.common import fresh, release_memory, string_bytes, written

ORDERS = (1, 2, 3)
#: Training texts and landmarks of each language, and the weight of the ridge.
PER_LANGUAGE, LANDMARKS, RIDGE = 256, 24, 1e-3
#: Longer texts are landmarks only where a language has too few others.
LANDMARK_BYTES = 1 << 16
#: Landmarks of all languages together, where there are many languages.
MOST_LANDMARKS = 2048
#: A text with a smaller share of n-grams that any learned language has is in none of them.
LEAST_KNOWN = 0.3
UNKNOWN = "und"
_BLOCK = 64
_LETTER = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(any(map(str.isalpha, m[0])) for m in _LETTER.finditer(text))


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """Number of the n-gram that starts at each byte, apart for each order."""
    n = len(data) - order + 1
    out = np.zeros(max(n, 0), np.int32)
    for i in range(order if n > 0 else 0):
        out = out << 8 | data[i : i + n]
    return out


class Grams:
    """The n-grams of the landmarks, numbered from 1; 0 stands for any other."""

    def __init__(self, codes: list[np.ndarray]):
        self.codes = codes
        self.size = 1 + sum(map(len, codes))
        kind = np.uint16 if self.size < 1 << 16 else np.int32
        self.tables, at = [], 1
        for order, own in zip(ORDERS, codes, strict=True):
            table = np.zeros(1 << 8 * order, kind)
            table[own] = np.arange(at, at + len(own))
            at += len(own)
            self.tables.append(table)

    @classmethod
    def of(cls, texts: list[bytes]) -> Grams:
        return cls([np.unique(np.concatenate([_codes(np.frombuffer(t, np.uint8), n) for t in texts])) for n in ORDERS])

    def presence(self, data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """A row for each text, with 1 for the n-grams that it holds; column 0 stays 0.

        ``known`` takes the share of the places of a text (over all orders) at which an n-gram of the landmarks begins.
        """
        n = len(offsets) - 1
        found = np.zeros(n * self.size, np.float32)
        row = np.repeat(np.arange(n, dtype=np.int64) * self.size, np.diff(offsets))
        for order, table in zip(ORDERS, self.tables, strict=True):
            ids = table[_codes(data, order)]
            at = row[: len(ids)] + ids
            for back in range(1, order):  # n-grams that run into the next text
                over = offsets[1:] - back
                at[over[(over >= 0) & (over < len(at))]] = 0
            found[at] = 1
            if known is not None:
                sums = np.concatenate([[0], np.cumsum(ids > 0)])
                ends = np.minimum(offsets, len(ids))
                known += (sums[ends[1:]] - sums[ends[:-1]]) / (np.maximum(np.diff(offsets), 1) * len(ORDERS))
        found = found.reshape(n, self.size)
        found[:, 0] = 0
        return found


@dataclass
class Model:
    languages: list[str]
    codes: list[np.ndarray]
    weights: np.ndarray  # of each n-gram and language

    def scores(self, grams: Grams, texts: list[str], shares: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The regression values of each language, and with ``shares`` those of known n-grams."""
        out, known = [np.zeros((0, len(self.languages)), np.float32)], np.zeros(len(texts))
        for at in range(0, len(texts), _BLOCK):
            data, offsets = string_bytes(pa.array([t.lower() for t in texts[at : at + _BLOCK]], pa.large_string()))
            out.append(_unit(grams.presence(data, offsets, known[at : at + _BLOCK] if shares else None)) @ self.weights)
        return np.concatenate(out), known


def _unit(presence: np.ndarray) -> np.ndarray:
    return presence / np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))


def _normal_equations(grams_codes, landmarks: np.ndarray, languages: list[str]):
    """Sums of K'K and K'Y of the training texts of a partition, for kernel values K with the landmarks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(grams_codes), len(landmarks)
        total = np.zeros((m, m + len(languages)))
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                data, offsets = string_bytes(pa.array([t.lower() for t in part.column(0).to_pylist()], pa.large_string()))
                kernel = (_unit(grams.presence(data, offsets)) @ landmarks.T).astype(np.float64)
                targets = np.array([[1.0 if x == y else -1.0 for y in languages] for x in part.column(1).to_pylist()])
                total += kernel.T @ np.concatenate([kernel, targets], axis=1)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    return run


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of the languages of ``labelled``; None if no row has a language and letters."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # a share of the hashes that holds about eight times the wanted texts; a row for each language reaches the driver
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return None
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(sizes)))
    below = {lang: -(1 << 63) + min((1 << 64) - 1, (8 * per_language << 64) // max(n, 1)) for lang, n in sizes.items()}
    bounds = labelled.sparkSession.createDataFrame(list(below.items()), StructType([rows.schema["lang"], StructField("below", LongType())]))
    low = rows.join(F.broadcast(bounds), "lang").filter(F.col("h") <= F.col("below")).select("lang", "h").distinct()
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= per_language)
    # at most per_language rows of each language are broadcast, and go on
    sample = written(rows.join(F.broadcast(ranked), ["lang", "h"]).dropDuplicates(["lang", "h"]).filter(F.col("text").rlike(r"\p{L}")), "sample")
    # long texts come last, so that the landmarks are small in bytes too
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.octet_length("text") > LANDMARK_BYTES, "rank"))
    short = sample.withColumn("place", place).filter(F.col("place") <= landmarks)
    own = [r for r in short.orderBy("lang", "place").collect() if has_letter(r["text"])]
    languages = sorted({r["lang"] for r in own})
    if not own:
        return None
    texts = [r["text"].lower().encode() for r in own]
    grams = Grams.of(texts)
    data, offsets = string_bytes(pa.array(texts, pa.large_binary()))
    marks = _unit(grams.presence(data, offsets))
    sums = sample.filter(F.col("lang").isin(languages)).select("text", "lang").mapInArrow(_normal_equations(grams.codes, marks, languages), "sums binary")
    m = len(marks)
    # one small matrix of each partition of the bounded sample, merged in the executors
    total = sum((np.frombuffer(r["sums"]).reshape(m, -1) for r in sums.coalesce(8).toLocalIterator()), np.zeros((m, m + len(languages))))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2), up to a rotation
    left, right = root.T @ total[:, :m] @ root, root.T @ total[:, m:]
    n = max(1.0, float(np.trace(left)))
    dual = root @ np.linalg.solve(left + ridge * n / len(left) * np.eye(len(left)), right)
    return Model(languages, grams.codes, (marks.T @ dual).astype(np.float32))


def predict(model: Model | None, text: Column, spark, shares: bool = False) -> Column:
    """struct<lang_pred: string, score: double, known: double> of whole texts; known: with ``shares``, that of their n-grams that the landmarks hold."""
    shared = spark.sparkContext.broadcast(model)
    made: list[Grams] = []

    @F.arrow_udf("struct<lang_pred: string, score: double, known: double>")
    def run(column: pa.Array) -> pa.Array:
        model = shared.value
        if model is not None and not made:
            made.append(Grams(model.codes))
        # few Python strings at a time
        found = pa.concat_arrays([labelled(model, column.slice(at, 4 * _BLOCK).to_pylist()) for at in range(0, max(len(column), 1), 4 * _BLOCK)])
        if shares:  # stages follow
            release_memory()
        return found

    def labelled(model: Model | None, texts: list[str | None]) -> pa.Array:
        lang, score, share = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if model is not None:
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            for i, values, share[i] in zip(known, *model.scores(made[0], [texts[i] for i in known], shares), strict=True):
                best = int(values.argmax())
                lang[i], score[i] = model.languages[best], min(1.0, max(0.0, (1 + float(values[best])) / 2))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], names=["lang_pred", "score", "known"])

    return run(text)


def is_held_out(id_col: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """``docs`` with a struct column ``language`` (a column of that name gives way), learnt from the rows not held out."""
    model = fit(docs.filter(F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))), text_col, lang_col, **bounds)
    return docs.withColumn("language", predict(model, F.col(text_col), docs.sparkSession))


def _letters():
    @F.arrow_udf("boolean")
    def letters(texts: pa.Array) -> pa.Array:
        return pa.array([has_letter(t) for t in texts.to_pylist()], pa.bool_())

    return letters


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_known: float = LEAST_KNOWN) -> DataFrame:
    """``docs`` without the rows that are in no learned language; all columns stay as they are.

    A row goes if its language is ``und`` (no text, or no letter), or if the share of its n-grams that the landmarks of
    any language hold is below ``least_known``. Where there is nothing to learn from, every row with a letter stays.
    """
    model = fit(docs.filter(F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col))), text_col, lang_col)
    if model is None:
        return docs.filter(_letters()(F.col(text_col)))
    tmp = fresh(docs, "_language")
    claimed = (F.col(f"{tmp}.lang_pred") != UNKNOWN) & (F.col(f"{tmp}.known") >= least_known)
    return docs.withColumn(tmp, predict(model, F.col(text_col), docs.sparkSession, True)).filter(claimed).drop(tmp)

