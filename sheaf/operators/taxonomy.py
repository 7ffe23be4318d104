"""Topic trees: paths, keywords, filters that work with them, and prediction down the tree.

topics: (topic_id, parent_id, name, keywords array<string>); keywords may be absent or null. Trees are walked one level at a
time, a level a join, written to the shared folder, at most `MAX_DEPTH` levels deep, so a circle ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import written

MAX_DEPTH = 10

_SCHEMA = "topic_id string, parent_id string, name string, keywords array<string>"


def from_nested(spark: SparkSession, roots: Iterable[Mapping]) -> DataFrame:
    """A nested tree, as a taxonomy file holds it: {id, name, keywords, children: [...]}."""
    rows, open_ = [], [(None, r) for r in roots]
    while open_:
        parent, t = open_.pop()
        key = t.get("id") or (t["name"] if parent is None else f"{parent}/{t['name']}")
        rows.append((key, parent, t["name"], list(t.get("keywords") or [])))
        open_ += [(key, c) for c in t.get("children") or []]
    return spark.createDataFrame(rows, _SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy file: one JSON document, a tree or a list of trees, or an object whose `root_nodes` holds them."""
    (text,) = spark.read.text(path, wholetext=True).first()
    got = json.loads(text)
    got = got.get("root_nodes", [got]) if isinstance(got, dict) else got
    return from_nested(spark, got)


def _keywords(topics: DataFrame) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.col("keywords"), none) if "keywords" in topics.columns else none


def walked(topics: DataFrame) -> DataFrame:
    """(topic_id, parent_id, name, keywords, root, level, path array): topics that a root leads to."""
    own = topics.select("topic_id", "parent_id", "name", _keywords(topics).alias("keywords"))
    order = ["topic_id", "parent_id", "name", "keywords", "root", "level", "path"]
    out = level = written(own.filter("parent_id IS NULL").withColumns({"root": F.col("topic_id"), "level": F.lit(0), "path": F.array("name")}).select(*order))
    for depth in range(1, MAX_DEPTH + 1):
        above = level.select(F.col("topic_id").alias("up"), "root", F.col("path").alias("lead"))
        below = own.join(above, F.col("parent_id") == F.col("up")).select("topic_id", "parent_id", "name", "keywords", "root", F.lit(depth).alias("level"), F.array_append("lead", F.col("name")).alias("path"))
        level = written(below)
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def paths(topics: DataFrame, between: str = " > ") -> DataFrame:
    return walked(topics).select("topic_id", "level", F.array_join("path", between).alias("path"))


def leaves(topics: DataFrame) -> DataFrame:
    return topics.join(topics.select(F.col("parent_id").alias("topic_id")), "topic_id", "left_anti")


def lookup(topics: DataFrame, name: str) -> DataFrame:
    """Topics of this name, whatever its case, or of this id."""
    return topics.filter((F.lower("name") == name.lower()) | (F.col("topic_id").cast("string") == name))


def nested(topics: DataFrame) -> DataFrame:
    """One row a root: (topic_id, tree), the tree as JSON with children in order of id. Levels are folded from below."""
    all_ = walked(topics)
    below = None
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    for depth in range(MAX_DEPTH, -1, -1):
        here = all_.filter(F.col("level") == depth)
        if below is None:
            here = here.withColumn("children", F.lit(""))
        else:
            kids = below.groupBy("parent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("topic_id", "tree"))), lambda x: x["tree"]), ",").alias("kids"))
            here = here.join(kids.withColumnRenamed("parent_id", "up"), F.col("topic_id") == F.col("up"), "left").withColumn("children", F.coalesce("kids", F.lit("")))
        tree = F.concat(
            F.lit('{"id":'), quoted(F.col("topic_id").cast("string")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"keywords":'), F.to_json("keywords"), F.lit(',"children":['), F.col("children"), F.lit("]}")
        )
        below = here.select("topic_id", "parent_id", tree.alias("tree"))
    return below.select("topic_id", "tree")


def save(topics: DataFrame, path: str) -> None:
    """One tree a line."""
    nested(topics).select("tree").write.mode("overwrite").text(path)


def training_texts(topics: DataFrame) -> DataFrame:
    """(topic_id, text): name, keywords and path of each topic, to train on where no documents are labelled."""
    return walked(topics).select("topic_id", F.lower(F.concat_ws(" ", F.col("name"), F.array_join("keywords", " "), F.array_join("path", " "))).alias("text"))


def domain_keywords(topics: DataFrame, more: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """(domain, keyword): of each root, the lower-case keywords of its topics and the words of the names of those that have
    keywords; `more` adds keywords to domains by the root's name."""
    rows = walked(topics).filter(F.size("keywords") > 0)
    roots = topics.filter("parent_id IS NULL").select(F.col("topic_id").alias("root"), F.lower("name").alias("domain"))
    words = F.concat(F.transform("keywords", lambda k: F.lower(k)), F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != ""))
    out = rows.join(roots, "root").select("domain", F.explode(words).alias("keyword"))
    if more:
        extra = [(d.lower(), k.lower()) for d, ks in more.items() for k in ks]
        out = out.union(topics.sparkSession.createDataFrame(extra, "domain string, keyword string"))
    return out.distinct()


def keyword_scores(terms: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, domain, matches, score) from the most frequent terms (doc_id, term, n_words) of each document.

    The score is log10(1 + matches), 1 at most, times 0.7; a text of fewer than 50 words gets that share of it."""
    cap = 0.7 * F.least(F.lit(1.0), F.col("n_words") / 50)
    hit = terms.join(keywords, F.col("term") == F.col("keyword")).groupBy("doc_id", "domain").agg(F.countDistinct("term").alias("matches"), F.max("n_words").alias("n_words"))
    return hit.select("doc_id", "domain", "matches", (cap * F.least(F.lit(1.0), F.log10(1.0 + F.col("matches")))).alias("score"))


def hybrid(keyword: Column, tfidf: Column, threshold: float = 0.25, low: float = 0.2, high: float = 0.4) -> Column:
    """(score, relevant): the keyword score, joined by the TF-IDF score, which weighs twice, where it leaves doubt."""
    doubt = (keyword >= low) & (keyword <= high)
    score = F.when(doubt, (keyword + 2 * F.coalesce(tfidf, F.lit(0.0))) / 3).otherwise(keyword)
    return F.struct(score.alias("score"), (score >= threshold).alias("relevant"))


def hierarchical(scores: DataFrame, topics: DataFrame, threshold: float = 0.5, max_depth: int = 3) -> DataFrame:
    """(doc_id, topic_id, level, score): from scores (doc_id, topic_id, score), the roots, and every topic that reaches the
    threshold below a topic that is kept."""
    own = topics.select("topic_id", "parent_id")
    all_ = scores.join(own, "topic_id")
    level = all_.filter("parent_id IS NULL").select("doc_id", "topic_id", F.lit(0).alias("level"), "score")
    out = level
    for depth in range(1, max_depth):
        above = level.select(F.col("doc_id").alias("d"), F.col("topic_id").alias("up"))
        level = all_.filter(F.col("score") >= threshold).join(above, (F.col("doc_id") == F.col("d")) & (F.col("parent_id") == F.col("up"))).select("doc_id", "topic_id", F.lit(depth).alias("level"), "score")
        out = out.union(level)
    return out


def classified(predictions: DataFrame, filtered: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, primary_topic, primary_score, subtopics, overall, relevant) from predictions (doc_id, topic_id, level, score)
    and the fast filter (doc_id, score, relevant, empty).

    An empty text is irrelevant with confidence 1, one that the filter drops has the filter's; for the others the primary
    topic weighs 0.7 and the filter 0.3, and the primary topic decides."""
    best = Window.partitionBy("doc_id").orderBy(F.col("level"), F.desc("score"), "topic_id")
    rows = predictions.withColumn("place", F.row_number().over(best))
    first = rows.filter("place = 1").select("doc_id", F.col("topic_id").alias("primary_topic"), F.col("score").alias("primary_score"))
    rest = rows.filter("place > 1").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "topic_id"))).alias("rest"))
    joined = filtered.join(first, "doc_id", "left").join(rest, "doc_id", "left")
    asked = ~F.col("empty") & F.col("relevant") & F.col("primary_score").isNotNull()
    return joined.select(
        "doc_id", F.when(asked, F.col("primary_topic")).alias("primary_topic"), F.when(asked, F.col("primary_score")).alias("primary_score"),
        F.when(asked, F.transform(F.coalesce("rest", F.array().cast("array<struct<order:double,topic_id:string>>")), lambda x: x["topic_id"])).alias("subtopics"),
        F.when(F.col("empty"), 1.0).when(asked, 0.7 * F.col("primary_score") + 0.3 * F.col("score")).otherwise(F.col("score")).alias("overall"),
        (asked & (F.col("primary_score") >= threshold)).alias("relevant"),
    )
