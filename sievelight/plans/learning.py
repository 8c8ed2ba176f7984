"""The linear text model: n-gram TF-IDF, multinomial logistic regression, label cleaning, calibration.

Texts are read a fixed number of times: once a vocabulary and once for the counts, which are materialised; the estimators
behind them read the counts alone. Character n-grams, of which a text has as many as characters, are counted as integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import labels
from sievelight.functions.text import let
from sievelight.storage import materialise

#: Characters in a character n-gram, and characters that are counted at once.
SIZE, AT_ONCE = 3, 1 << 21


def with_char_grams(rows: DataFrame, column: str = "text", size: int = SIZE) -> DataFrame:

    def grams(chars: Column) -> Column:
        n = F.size(chars) - size + 1
        return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(*(F.get(chars, i + k) for k in range(size))))).otherwise(F.array().cast("array<string>"))

    return rows.withColumn("char_grams", let(F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit("(?s)."), F.lit(0)), grams))


def _codes(text: str) -> np.ndarray:
    """The text's character n-grams as numbers, 21 bits a character."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    codes = points[: max(0, len(points) - SIZE + 1)].copy()
    for k in range(1, SIZE):
        codes = codes << 21 | points[k : len(codes) + k]
    return codes


def _gram(code: int) -> str:
    return "".join(chr(code >> 21 * k & 0x1FFFFF) for k in range(SIZE - 1, -1, -1))


def _most_frequent(counted: DataFrame, size: int) -> list[str]:
    """The ``size`` most frequent of (term, n), ties in the order of the terms: a vocabulary, whose size bounds the rows."""
    most = counted.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    return [r["term"] for r in most.collect()]


def _count_chars(rows: DataFrame) -> DataFrame:
    """(term, n) of character n-grams, added up over some texts at a time."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0

        def added_up() -> pd.DataFrame:
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pd.DataFrame({"code": codes, "n": n})

        for b in batches:
            for t in b["t"]:
                waiting.append(_codes(t))
                size += len(waiting[-1])
                if size >= AT_ONCE:
                    yield added_up()
                    waiting, size = [], 0
        if waiting:
            yield added_up()

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"term": [_gram(c) for c in b["code"].tolist()], "n": b["n"]})

    codes = rows.select(F.lower(F.coalesce("text", F.lit(""))).alias("t")).mapInPandas(count, "code long, n long")
    return codes.groupBy("code").agg(F.sum("n").alias("n")).mapInPandas(named, "term string, n long")


def _char_tf(vocabulary: list[str]) -> Column:
    """What the vocabulary's CountVectorizerModel gives for ``char_grams``, from the text itself."""
    codes = np.array([_codes(g)[0] for g in vocabulary], np.int64)
    order = np.argsort(codes)
    codes, size = codes[order], len(vocabulary)

    @F.pandas_udf(VectorUDT())
    def counts(texts: pd.Series) -> pd.DataFrame:
        places, times = [], []
        for t in texts:
            given = _codes(t)
            at = np.minimum(np.searchsorted(codes, given), size - 1)
            found, n = np.unique(order[at[codes[at] == given]], return_counts=True)
            places.append(found.astype(np.int32))
            times.append(n.astype(float))
        # A sparse vector's fields in VectorUDT.
        return pd.DataFrame({"type": np.zeros(len(places), np.int8), "size": np.full(len(places), size, np.int32), "indices": pd.Series(places, dtype=object), "values": pd.Series(times, dtype=object)})

    return counts(F.lower(F.coalesce("text", F.lit(""))))


def text_pipeline(words: int = 200_000, chars: int = 60_000, iterations: int = 30) -> Pipeline:
    """Over (text, char_grams, class): two TF-IDF spaces, each of unit length, side by side."""
    return Pipeline(stages=[
        StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
        RegexTokenizer(inputCol="text", outputCol="uni", pattern=r"[^\p{L}]+"), NGram(n=2, inputCol="uni", outputCol="bi"),
        CountVectorizer(inputCol="uni", outputCol="uni_tf", vocabSize=words // 2), CountVectorizer(inputCol="bi", outputCol="bi_tf", vocabSize=words // 2),
        VectorAssembler(inputCols=["uni_tf", "bi_tf"], outputCol="word_tf"), IDF(inputCol="word_tf", outputCol="word_idf"), Normalizer(inputCol="word_idf", outputCol="word_vec"),
        CountVectorizer(inputCol="char_grams", outputCol="char_tf", vocabSize=chars), IDF(inputCol="char_tf", outputCol="char_idf"), Normalizer(inputCol="char_idf", outputCol="char_vec"),
        VectorAssembler(inputCols=["word_vec", "char_vec"], outputCol="features"),
        LogisticRegression(family="multinomial", maxIter=iterations, regParam=1e-4, featuresCol="features", labelCol="label"),
    ])


def train(rows: DataFrame, **settings: int) -> PipelineModel:
    """Fits ``text_pipeline``; of equally frequent terms, those first in order are in the vocabularies."""
    indexer, tokens, pairs, uni, bi, *middle, chars, char_idf, char_norm, together, regression = text_pipeline(**settings).getStages()
    words = pairs.transform(tokens.transform(rows.select("text")))

    def fitted(vectors: CountVectorizer, counted: DataFrame) -> CountVectorizerModel:
        terms = _most_frequent(counted, vectors.getVocabSize())
        return CountVectorizerModel.from_vocabulary(terms, vectors.getInputCol(), vectors.getOutputCol())

    of = lambda c: words.select(F.explode(c).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counting = [indexer.fit(rows.select("class")), tokens, pairs, fitted(uni, of("uni")), fitted(bi, of("bi"))]
    char_model = fitted(chars, _count_chars(rows))
    counted = PipelineModel(counting).transform(rows.select("text", "class")).withColumn("char_tf", _char_tf(char_model.vocabulary))
    counts = materialise(counted.select("label", "uni_tf", "bi_tf", "char_tf"), "text_counts")
    rest = Pipeline(stages=[*middle, char_idf, char_norm, together, regression]).fit(counts).stages
    return PipelineModel([*counting, *rest[: len(middle)], char_model, *rest[len(middle) :]])


def _transformed(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """What the model's stages give, but for the column of character n-grams."""
    at = next(i for i, stage in enumerate(model.stages) if isinstance(stage, CountVectorizerModel) and stage.getInputCol() == "char_grams")
    before = PipelineModel(model.stages[:at]).transform(rows)
    return PipelineModel(model.stages[at + 1 :]).transform(before.withColumn("char_tf", _char_tf(model.stages[at].vocabulary)))


def classify(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds probabilities, a map from class to probability, and predicted."""
    names = model.stages[0].labels
    scored = _transformed(model, rows).withColumn("_p", vector_to_array("probability"))
    by_name = F.map_from_arrays(F.array(*map(F.lit, names)), F.slice("_p", 1, len(names)))
    return scored.withColumn("probabilities", by_name).withColumn("predicted", F.element_at(F.array(*map(F.lit, names)), F.array_position(F.slice("_p", 1, len(names)), F.array_max(F.slice("_p", 1, len(names)))).cast("int"))).select(*rows.columns, "probabilities", "predicted")


def class_direction(model: PipelineModel, target: str) -> np.ndarray:
    """The target's weights less the mean of the other classes'."""
    names, weights = model.stages[0].labels, model.stages[-1].coefficientMatrix.toArray()
    at = names.index(target)
    others = [i for i in range(len(names)) if i != at]
    return weights[at] - weights[others].mean(axis=0)


def label_issues(rows: DataFrame, folds: int = 3, given_below: float = 0.15, other_from: float = 0.60, **settings: int) -> DataFrame:
    """Noisy rows whose held-out probability of the given label is low while another's is high: (all columns, predicted)."""
    dealt = rows.withColumn("fold", labels.fold_of(F.col("group_key"), folds))
    found = None
    for k in range(folds):
        held = classify(train(dealt.where(F.col("fold") != k), **settings), dealt.where((F.col("fold") == k) & F.col("noisy")))
        bad = held.where((F.element_at("probabilities", F.col("class")) < given_below) & (F.element_at("probabilities", F.col("predicted")) >= other_from) & (F.col("predicted") != F.col("class")))
        found = bad if found is None else found.union(bad)
    return found.drop("fold", "probabilities")


@dataclass(frozen=True)
class Platt:
    a: float
    b: float
    brier_before: float
    brier_after: float


def fit_platt(rows: DataFrame, p: str = "p", y: str = "y", steps: int = 100) -> Platt:
    """Damped Newton on smoothed targets; one aggregate a step. Keeps (1, 0) if the Brier score would get worse."""
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    d = rows.select(F.log(c / (1 - c)).alias("x"), F.col(y).cast("double").alias("y"), F.col(p).alias("p")).persist()
    n, pos = d.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n:
        return Platt(1.0, 0.0, 0.0, 0.0)
    t = F.when(F.col("y") > 0.5, (pos + 1) / (pos + 2)).otherwise(1 / (n - pos + 2))
    a, b, damping = 1.0, 0.0, 1e-6

    def loss(a: float, b: float):
        z = a * F.col("x") + b
        return F.sum(F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z))))

    ladder = [1.0, 0.5, 0.25, 0.125, 0.03, 0.0]
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(a * F.col("x") + b)))
        w = q * (1 - q)
        ga, gb, haa, hab, hbb = d.agg(F.sum((q - t) * F.col("x")), F.sum(q - t), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)).first()
        det = (haa + damping) * (hbb + damping) - hab * hab
        da, db = -((hbb + damping) * ga - hab * gb) / det, -((haa + damping) * gb - hab * ga) / det
        values = d.agg(*(loss(a + s * da, b + s * db) for s in ladder)).first()
        best = min(range(len(ladder)), key=lambda i: (values[i], i))
        a, b = a + ladder[best] * da, b + ladder[best] * db
        if abs(ladder[best] * da) + abs(ladder[best] * db) < 1e-7:
            break
    after = F.avg(F.pow(labels.platt(F.col("p"), a, b) - F.col("y"), 2))
    before, now = d.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)), after).first()
    d.unpersist()
    return Platt(a, b, before, now) if now <= before else Platt(1.0, 0.0, before, before)


def top_terms(model: PipelineModel, target: str, k: int = 20) -> list[tuple[str, float]]:
    """The words and pairs that speak most for a class."""
    direction = class_direction(model, target)
    vocabulary = [*model.stages[3].vocabulary, *model.stages[4].vocabulary]
    order = np.argsort(-direction[: len(vocabulary)], kind="stable")[:k]
    return [(vocabulary[i], float(direction[i])) for i in order]
