"""Trained topic classifiers: balanced logistic regression over tf-idf of words and word pairs.

Words are counted over all training rows; the vocabulary is bounded by `VOCABULARY`, the sample split is by hash, so that
reruns agree. Defined results: null text has no words and gets the model's prior; without rows of both classes training
raises ValueError."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import written

VOCABULARY = 10_000
KINDS = {
    "lr": lambda: LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50, regParam=1e-3),
    "svm": lambda: LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=50, regParam=1e-3),
    "rf": lambda: RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=100, seed=42),
}


def _tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", text.tokens(F.coalesce("text", F.lit(""))))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four fifths for training and a fifth to measure with, by hash of the id."""
    part = F.pmod(F.xxhash64(F.lit(42), "doc_id"), F.lit(5))
    return df.filter(part > 0), df.filter(part == 0)


def train(df: DataFrame, kind: str = "lr") -> PipelineModel:
    """df: text, label (0 or 1). Classes weigh the same whatever their sizes."""
    n = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("label IN (0, 1)").collect()}
    if len(n) < 2:
        raise ValueError("training needs rows of both classes")
    total = sum(n.values())
    rows = _tokens(df).filter("label IN (0, 1)").withColumn("weight", F.when(F.col("label") == 1, total / (2 * n[1])).otherwise(total / (2 * n[0]))).withColumn("label", F.col("label").cast("double"))
    steps = [
        StopWordsRemover(inputCol="tokens", outputCol="single"), NGram(n=2, inputCol="single", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(single, pairs) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=VOCABULARY), IDF(inputCol="tf", outputCol="features"), KINDS[kind](),
    ]
    return Pipeline(stages=steps).fit(rows)


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """df with confidence (of the positive class) and is_relevant. A model without probabilities gives its margin
    through the logistic function."""
    out = model.transform(_tokens(df))
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.withColumn("confidence", p).withColumn("is_relevant", F.col("confidence") >= 0.5).select(*[F.col(f"`{c}`") for c in df.columns], "confidence", "is_relevant")


def measures(predicted: DataFrame) -> DataFrame:
    """One row: n, accuracy, f1 of the positive class. predicted: label, is_relevant."""
    hit = lambda label, relevant: F.sum(F.when((F.col("label") == label) & (F.col("is_relevant") == relevant), 1).otherwise(0))
    tp, fp, fn = hit(1, True), hit(0, True), hit(1, False)
    return predicted.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("is_relevant").cast("int")).cast("double")).alias("accuracy"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def cross_validated(df: DataFrame, kind: str = "lr", folds: int = 5, seed: int = 42, measure: str = "accuracy") -> dict[str, float]:
    """Mean, standard deviation (of the population), least and largest measure over folds by seeded hash of doc_id. A fold
    without rows, or without which a class is missing, is left out."""
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(folds))
    got = []
    for k in range(folds):
        rest, held = df.filter(part != k), df.filter(part == k)
        if rest.filter("label IN (0, 1)").select("label").distinct().count() == 2 and not held.isEmpty():
            got.append(float(measures(predict(held, train(rest, kind))).first()[measure]))
    if not got:
        return {"folds": 0, "mean": float("nan"), "std": float("nan"), "min": float("nan"), "max": float("nan")}
    mean = sum(got) / len(got)
    return {"folds": len(got), "mean": mean, "std": (sum((x - mean) ** 2 for x in got) / len(got)) ** 0.5, "min": min(got), "max": max(got)}


def tfidf_relevance(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc_id, score): cosine of each document (doc_id, text) with the terms, each once, by term frequency and smooth inverse
    document frequency. Documents that hold none of the terms have no row. Texts are tokenised once."""
    words = F.filter(F.split(F.lower("text"), r"(?U)[^\w]+"), lambda x: F.length(x) > 1)
    tf = written(docs.select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")))
    total = tf.select("doc_id").distinct().count()
    idf = F.log((1.0 + total) / (1.0 + F.coalesce("d", F.lit(0)))) + 1
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    weighed = tf.join(df, "term").withColumn("idf", idf).withColumn("x", F.col("n") * F.col("idf"))
    asked = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string"))
    own = asked.join(df, "term", "left").agg(F.sqrt(F.sum(idf * idf)).alias("q")).first().q or 1.0
    hit = F.col("term").isin(*terms)
    by_doc = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"), F.sum(F.when(hit, F.col("x") * F.col("idf"))).alias("dot"))
    return by_doc.filter("dot IS NOT NULL").select("doc_id", (F.col("dot") / F.col("len") / F.lit(float(own))).alias("score"))
