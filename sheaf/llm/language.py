"""Language identification with a string kernel.

The kernel is the blended-spectrum presence kernel: the number of distinct byte n-grams, of every length in `GRAMS`, that
two texts share, divided by the root of the product of how many each has. A bounded number of landmark texts stands for
the training texts (Nyström); one-versus-rest kernel ridge regression is fitted on the landmark features of a bounded
sample of labelled texts. Scoring is one matrix product a batch: presence rows by the landmarks' presence matrix, times
the Nyström map and the ridge coefficients, which are multiplied once beforehand.

N-grams are hashed to `BINS` columns. Whole texts are read, whatever their length. Text is lower-cased letters with one
space between words, so digits, marks and case carry no weight.

Defined results: null text, or text without a letter, gives `und` with score 0; without a usable training row every
prediction is `und`; ties go to the first language in alphabetical order; lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import table

GRAMS = (1, 2, 3, 4)
BINS = 1 << 14
#: Bounds of the training sample: distinct texts and landmarks of each language.
TRAIN_TEXTS = 400
LANDMARKS = 64
RIDGE = 1e-3
#: Parts of a language that are ranked on their own first.
PARTS = 16

_not_letters = regex.compile(r"\P{L}+")


def tokens(text: str | None) -> bytes:
    found = _not_letters.sub(" ", (text or "").lower()).strip()
    return f" {found} ".encode() if found else b""


def presence(texts: list[bytes]) -> np.ndarray:
    """(texts, BINS) of 0 and 1."""
    out = np.zeros((len(texts), BINS), np.float32)
    for n, t in enumerate(texts):
        if not t:
            continue
        data = np.frombuffer(t, np.uint8).astype(np.uint32)
        code = np.zeros(len(data), np.uint32)
        for g in range(1, max(GRAMS) + 1):
            if g > len(data):
                break
            code = (code[: len(data) - g + 1] << np.uint32(8)) | data[g - 1 :]
            if g in GRAMS:
                h = (code + np.uint32(g)) * np.uint32(2654435761)
                out[n, (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(18)] = 1
    return out


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return (x @ self.weights) / size


def fit(x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """x: what presence() gives for the training texts."""
    languages = sorted(set(labels))
    size = np.sqrt(np.maximum(x.sum(1), 1))
    y = np.array([[1.0 if a == b else -1.0 for b in languages] for a in labels])
    lab = np.array(labels)
    at = np.concatenate([np.flatnonzero(lab == b)[:landmarks] for b in languages])
    marks = x[at] / size[at][:, None]  # K(a, b) = marks_a . x_b / size_b
    k_mm = (marks @ (x[at] / size[at][:, None]).T).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = ((x / size[:, None]) @ marks.T).astype(np.float64) @ root
    # classes weigh alike
    w = np.array([1.0 / labels.count(a) for a in labels])
    w *= len(w) / w.sum()
    coef = np.linalg.solve(z.T @ (z * w[:, None]) + ridge * len(z) * np.eye(z.shape[1]), z.T @ (y * w[:, None]))
    return Model(languages, (marks.T.astype(np.float64) @ (root @ coef)).astype(np.float32))


def _predict(model: Model | None, names: list[str]):
    def of(batches):
        for batch in batches:
            lang, score = [], []
            for s in range(0, len(batch), 128):
                texts = [tokens(t) for t in batch.column(batch.num_columns - 1).slice(s, 128).to_pylist()]
                if model is None:
                    lang += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                f = model.score(presence(texts)).astype(np.float64)
                best = f.argmax(1)
                p = np.clip((f.max(1) + 1) / 2, 0.0, 1.0)
                for n, t in enumerate(texts):
                    lang.append(model.languages[best[n]] if t else "und")
                    score.append(float(p[n]) if t else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    return of


def _packed(batches):
    for pdf in batches:
        x = [np.packbits(presence([tokens(t)])[0] > 0).tobytes() for t in pdf["text"]]
        yield pdf[["lang", "h"]].assign(x=pd.Series(x, dtype=object, index=pdf.index))


def train(labelled: DataFrame, texts: int = TRAIN_TEXTS) -> Model | None:
    """labelled: (text, lang). At most `texts` distinct texts a language, the first by hash, are fitted on, each whole; the
    driver reads only which n-grams they have."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    # the first of a language are among the first of each of its parts, so no task ranks a whole language
    first = usable.select("lang", "h").distinct().withColumn("part", F.pmod(F.xxhash64("h"), F.lit(PARTS)))
    for group in (("lang", "part"), ("lang",)):
        first = first.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("h"))).filter(F.col("n") <= texts).drop("n")
    last = first.groupBy("lang").agg(F.max("h").alias("last"))
    drawn = usable.join(F.broadcast(last), "lang").filter("h <= last").select("lang", "h", "text").distinct().mapInPandas(_packed, "lang string, h long, x binary").collect()
    drawn.sort(key=lambda r: (r.lang, r.h, bytes(r.x)))
    return fit(np.array([np.unpackbits(np.frombuffer(r.x, np.uint8)) for r in drawn], np.float32), [r.lang for r in drawn]) if drawn else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without text, with lang_pred and score; columns of these names give way to them."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    made = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], "text")
    return rows.mapInArrow(_predict(model, [f.name for f in [*kept, *made]]), StructType([*kept, *made]))


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = train(docs.filter(~F.col("held_out")).select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
