"""Sentiment models on tables: features, weights, classifiers, search and scoring, with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintleaf.functions.numbers import softmax
from mintleaf.operators.evaluate import classification_report, report_of_cells
from mintleaf.sources.tables import written


#: Rows of a partition of features: as 10,000 numbers each, 164 MB.
_ROWS = 4096


def tfidf_stages(text: str = "text", vocabulary: int = 10_000, min_df: int = 2) -> list:
    """Word 1- and 2-grams with sublinear counts 1 + ln(tf), times 1 + ln((n + 1) / (df + 1)), of unit length."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+", minTokenLength=2)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    both = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _grams FROM __THIS__")
    counts = Vocabulary(inputCol="_grams", outputCol="_raw", vocabSize=vocabulary, minDF=min_df)
    return [words, pairs, both, counts, Sublinear(inputCol="_raw", outputCol="_tf"), SmoothIDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="features")]


class Vocabulary(CountVectorizer):
    """A CountVectorizer that counts words by SQL aggregates, whose tables hold no object for each word; ties go by word.

    Of its parameters vocabSize and minDF are kept to.
    """

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        words = F.col(self.getInputCol())
        # the words of a row, and the different ones once more
        both = F.array(F.struct(words.alias("_ws"), F.lit(0).alias("_once")), F.struct(F.array_distinct(words).alias("_ws"), F.lit(1).alias("_once")))
        counts = dataset.select(F.inline(both)).select(F.explode("_ws").alias("w"), "_once").groupBy("w").agg(F.count_if(F.col("_once") == 0).alias("n"), F.sum("_once").alias("df"))
        least = self.getMinDF() if self.getMinDF() >= 1 else self.getMinDF() * dataset.count()
        top = counts.filter(F.col("df") >= least).orderBy(F.desc("n"), "w").limit(self.getVocabSize()).collect()
        if not top:
            raise ValueError("no word is in enough rows: lower minDF")
        return CountVectorizerModel.from_vocabulary([r["w"] for r in top], self.getInputCol(), self.getOutputCol())


class Sublinear(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln(x) of the entries of a vector of counts, batch by batch; the one step here that Spark's own transformers lack."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        @F.arrow_udf(VectorUDT())
        def damp(vectors: pa.Array) -> pa.Array:
            """All entries of a batch of vectors at once; their places stay."""
            kind, size, places, values = (vectors.field(k) for k in range(4))
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(values.value_lengths(), 0).to_numpy())])
            logs = pa.array(1 + np.log(values.flatten().to_numpy(zero_copy_only=False)), pa.float64())
            damped = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), logs, type=values.type)
            return pa.StructArray.from_arrays([kind, size, places, damped], fields=list(vectors.type), mask=vectors.is_null())

        return dataset.withColumn(self.getOutputCol(), damp(F.col(self.getInputCol())))


class SmoothIDF(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits inverse document frequencies, and gives a product with them plus 1."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol=self.getInputCol(), outputCol="_").fit(dataset).idf
        return ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def class_weights(rows: DataFrame, label: str = "label", boost: dict | None = None) -> DataFrame:
    """A column ``weight``: n / (classes * n of the class), times the boost of the class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = F.col("_n") / (F.col("_k") * F.col("_c"))
    for value, times in (boost or {}).items():
        w = F.when(F.col(label) == value, w * times).otherwise(w)
    table = counts.crossJoin(F.broadcast(totals)).withColumn("weight", w)
    return rows.join(F.broadcast(table.select(label, "weight")), label)


def majority_baseline(train: DataFrame, rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with the most frequent training label (ties: the smaller) as ``prediction``."""
    best = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min_by(label, F.struct((-F.col("n")).alias("m"), label)).alias("prediction"))
    return rows.crossJoin(F.broadcast(best))


def classifiers(seed: int = 42) -> dict:
    """The model families; binary ones are wrapped for several classes."""
    return {
        "logistic regression": LogisticRegression(weightCol="weight", maxIter=50, regParam=0.01),
        "linear SVM": OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01), weightCol="weight"),
        "random forest": RandomForestClassifier(weightCol="weight", numTrees=20, maxDepth=8, seed=seed),
        "boosted trees": OneVsRest(classifier=GBTClassifier(weightCol="weight", maxIter=10, maxDepth=3, seed=seed), weightCol="weight"),
    }


def fit(train: DataFrame, classifier, text: str = "text", **features) -> PipelineModel:
    """Features are fitted on the training rows alone."""
    return fit_all(train, {"": classifier}, text, **features)[""]


def macro_f1(predictions: DataFrame, label: str = "label") -> float:
    return classification_report(predictions, label, "prediction").filter("label = 'macro avg'").first()["F1"]


def fit_all(train: DataFrame, candidates: dict, text: str = "text", **features) -> dict[str, PipelineModel]:
    """A model for each candidate. The features are fitted on the training rows once, and made once for all candidates."""
    first, last = (stages := tfidf_stages(text, **features))[:4], stages[4:]
    counter = Pipeline(stages=first).fit(train)
    # trees hold a row as so many numbers as there are features: partitions have few rows, however many splits the texts have
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // _ROWS))
    counted = counter.transform(train).drop(text, "_words", "_pairs", "_grams").repartition(parts).persist()
    try:
        weigher = Pipeline(stages=last).fit(counted)
        made = weigher.transform(counted).drop("_raw", "_tf", "_tfidf").persist()
        made.count()
    finally:
        # trees need the memory
        counted.unpersist()
    try:
        return {name: PipelineModel([*counter.stages, *weigher.stages, _fitted(c, made)]) for name, c in candidates.items()}
    finally:
        made.unpersist()


def _fitted(classifier, made: DataFrame):
    """The classifier fitted on rows; one-vs-rest of the labels 0 and 1 is its binary classifier alone.

    There the model of label 0 is that of label 1 with all signs turned, so the higher of both is what one of them predicts.
    """
    if not isinstance(classifier, OneVsRest) or {r[0] for r in made.select(classifier.getLabelCol()).distinct().limit(3).collect()} != {0.0, 1.0}:
        return classifier.fit(made)
    binary = classifier.getClassifier()
    names = {binary.labelCol: classifier.getLabelCol(), binary.featuresCol: classifier.getFeaturesCol(), binary.predictionCol: classifier.getPredictionCol()}
    if classifier.isDefined(classifier.weightCol) and classifier.getWeightCol():
        names[binary.weightCol] = classifier.getWeightCol()
    return binary.fit(made, names)


def reports(models: dict[str, PipelineModel], rows: DataFrame, label: str = "label") -> dict[str, DataFrame]:
    """The classification report of each model of one ``fit_all``, from counts in a written table.

    The rows' features are made once, and all models predict side by side, in one pass.
    """
    shared = next(iter(models.values())).stages[:-1]
    seen = PipelineModel(shared).transform(rows).select(F.col(label).alias("y"), "features")
    for k, m in enumerate(models.values()):
        seen = m.stages[-1].transform(seen).select(*seen.columns, F.col("prediction").alias(f"p{k}"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"p{k}").alias("p")) for k, name in enumerate(models)]))
    cells = written(seen.select("y", each.alias("e")).groupBy("e.model", "y", "e.p").agg(F.count(F.lit(1)).alias("n")), "predictions")
    return {name: report_of_cells(cells.filter(F.col("model") == name)) for name in models}


def grid_search(train: DataFrame, validation: DataFrame, candidates: dict, text: str = "text", label: str = "label", **features) -> tuple[str, list[tuple[str, float]]]:
    """The name of the candidate of the best macro-F1 on one fixed validation split (ties: the first), and all values."""
    found = [(name, macro_f1(m.transform(validation), label)) for name, m in fit_all(train, candidates, text, **features).items()]
    return max(found, key=lambda x: x[1])[0], found


def leaderboard(reports: dict[str, DataFrame]) -> DataFrame:
    """(model, macro_f1, accuracy) by macro-F1 from the classification reports of models."""
    out = None
    for name, r in reports.items():
        row = r.agg(F.max(F.when(F.col("label") == "macro avg", F.col("F1"))).alias("macro_f1"), F.max(F.when(F.col("label") == "accuracy", F.col("F1"))).alias("accuracy")).select(F.lit(name).alias("model"), "macro_f1", "accuracy")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("macro_f1"), "model")


def scored(predictions: DataFrame, labels: list[str], margins: Column | None = None, negative: str = "Negative", positive: str = "Positive") -> DataFrame:
    """sentiment, confidence, probs and polarity_score (3 decimals) from a probability vector, or from margins."""
    p = softmax(margins) if margins is not None else vector_to_array("probability")
    named = F.array(*[F.lit(x) for x in labels])
    rows = predictions.withColumn("_p", p)
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    return rows.withColumns({
        "sentiment": F.element_at(named, best), "confidence": F.round(F.array_max("_p"), 3), "probs": F.map_from_arrays(named, F.transform("_p", lambda x: F.round(x, 3))),
        "polarity_score": F.round(F.col("_p")[labels.index(positive)] - F.col("_p")[labels.index(negative)], 3),
    }).drop("_p")


def wide_errors(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One row for each key with pred_<model> and conf_<model> of every model."""
    out = None
    for name, t in tables.items():
        one = t.select(*key, F.col("prediction").alias(f"pred_{name}"), F.col("confidence").alias(f"conf_{name}"))
        out = one if out is None else out.join(one, key)
    return out


def saved_and_reloaded(model: PipelineModel, rows: DataFrame, path: str, key: str) -> int:
    """How many rows the model predicts otherwise after it was saved and loaded again."""
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a, b = (m.transform(rows).select(key, F.col("prediction").alias(n)) for m, n in ((model, "a"), (again, "b")))
    return a.join(b, key).filter("a != b").count()


def user_scorer(load: Callable[[], Callable[[list[str]], np.ndarray]], labels: list[str], batch: int = 64) -> Callable[[Column], Column]:
    """A column function that scores texts with a model of the user's own: struct(sentiment, confidence, probs, polarity_score).

    ``load`` is called once in each task and gives a function from texts to logits, a row for each text; texts reach it in
    batches of ``batch``. A null text counts as empty.
    """
    kind = "struct<sentiment: string, confidence: double, probs: map<string, double>, polarity_score: double>"

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            logits = np.concatenate([np.asarray(model(texts[a : a + batch]), float) for a in range(0, len(texts), batch)]) if texts else np.zeros((0, len(labels)))
            odds = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(texts) else logits
            p = odds / odds.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1) if len(texts) else []
            yield pd.DataFrame({
                "sentiment": [labels[k] for k in best], "confidence": p.max(axis=1).round(3) if len(texts) else [], "probs": [dict(zip(labels, row, strict=True)) for row in p.round(3).tolist()],
                "polarity_score": (p[:, labels.index("Positive")] - p[:, labels.index("Negative")]).round(3),
            })

    return F.pandas_udf(run, kind)
