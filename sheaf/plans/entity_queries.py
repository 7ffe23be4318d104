"""Queries of dictionary entity recognition, match reports, and the cleaners that normalise Unicode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise
from ..operators import entities as en
from ..operators import topics
from .fixtures import expanded, view
from .registry import query
from .text_queries import docs, scalar

scalar("strip_html", normalise.strip_html, None)
scalar("normalize_unicode", normalise.normalize_unicode, None)
scalar("clean_nlp", normalise.clean_nlp, None)
scalar("normalize_text", normalise.normalize_text, None)
scalar("clean_rust_export", normalise.clean_service_export, r"trim(regexp_replace(nfc_normalize(regexp_replace(text, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]', '', 'g')), '[\s\p{Z}]+', ' ', 'g'))")

FOOTBALL = en.football() | {"PERSON": en.GENERAL["PERSON"]}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.recognise(view(spark, sf_dir, "match_reports"), FOOTBALL, sport=True)


def rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.inline("entities"))


@query("ner_dictionary")
def ner_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = docs(spark, sf_dir).select("doc_id", "text").unionByName(view(spark, sf_dir, "match_reports"))
    return rows(en.recognise(texts, en.GENERAL | FOOTBALL | {"EVENT": (*en.GENERAL["EVENT"], *en.RULER_EVENTS)}))


def _counted(label: str, terms: tuple[str, ...]) -> str:
    single = "|".join(sorted(terms, key=len, reverse=True))
    return expanded(rf"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\b({single})\b')) AS BIGINT) AS n FROM match_reports")


def _count(label: str, terms: tuple[str, ...]):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = en.recognise(view(spark, sf_dir, "match_reports"), {label: terms})
        return found.select("doc_id", F.size("entities").cast("long").alias("n"))

    return of


query("ner_position", _counted("POSITION", en.POSITIONS))(_count("POSITION", en.POSITIONS))
query("ner_event", _counted("EVENT", en.EVENTS))(_count("EVENT", en.EVENTS))


@query("match_events")
def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.match_events(reports(spark, sf_dir))


@query("teams_with_players")
def teams_with_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.teams_with_players(reports(spark, sf_dir))


@query("match_report")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.match_report(reports(spark, sf_dir))


def topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language against all others stand in for a topic."""
    return docs(spark, sf_dir).select("doc_id", "text", F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"))


@query("topic_train")
def topic_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, held = topics.split(topic_rows(spark, sf_dir))
    return topics.measures(topics.predict(held, topics.train(seen)))


@query("topic_predict")
def topic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = topic_rows(spark, sf_dir)
    return topics.predict(every, topics.train(topics.split(every)[0])).select("doc_id", "is_relevant", "confidence")
