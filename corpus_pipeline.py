"""Corpus pipeline: toxicity, near-dedup, suffix-array dedup, mixing, packing, over the documents table.

Every stage takes all that its predecessor kept, and all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import minhash_dedup, mixing, packing, suffix_dedup, toxicity
from sheaf.llm.common import fresh, materialise, release, table


def _like_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars in step with text where docs has it."""
    return df.select(*[F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    names = fresh(docs, "tox_score"), fresh(docs, "tox_label")
    return toxicity.score(docs, model, names=names).filter(F.col(f"`{names[1]}`") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like_documents(suffix_dedup.dedup_text(docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like_documents(mixing.repeated(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained model, signatures and byte windows decide: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
