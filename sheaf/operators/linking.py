"""Linking mentions to the entities of a knowledge base.

kb: (entity_id, name, type, aliases array<string>, attributes map<string,string>); aliases and attributes may be absent or
null. mentions: (mention_id, text, type) and, for disambiguation, context. A type is compatible with the expected one if it
is that type or one below it (`expected.` at its start); a mention without a type expects any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kb_normalize

THRESHOLD = 0.5
MAX_CANDIDATES = 5
ACCEPT = 0.5


def compatible(actual: Column, expected: Column) -> Column:
    return expected.isNull() | (actual == expected) | actual.startswith(F.concat(expected, F.lit(".")))


def expectable(type_: Column) -> Column:
    """What a mention may expect to be compatible with a type: the type, those above it, and nothing."""
    parts = F.split(type_, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return F.when(type_.isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.concat(above, F.array(F.lit(None).cast("string"))))


def similarity(a: Column, b: Column) -> Column:
    """Of two normalised names: 1 if equal, 0.2 and 0.8 times the ratio of lengths if one holds the other, else one less the
    edit distance a character of the longer."""
    least, most = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.8 * least / most + 0.2).otherwise(1.0 - F.levenshtein(a, b) / most)


def names(kb: DataFrame) -> DataFrame:
    """(entity_id, type, key, kind): the index of normalised names and aliases; kind is name or alias."""
    out = kb.select("entity_id", "type", kb_normalize(F.col("name")).alias("key"), F.lit("name").alias("kind"))
    if "aliases" in kb.columns:
        out = out.union(kb.select("entity_id", "type", F.explode("aliases").alias("alias")).select("entity_id", "type", kb_normalize(F.col("alias")).alias("key"), F.lit("alias").alias("kind")))
    return out.distinct()


def _grams(key: Column) -> Column:
    n = F.length(key)
    return F.when(n < 2, F.array(key)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2)))))


def candidates(mentions: DataFrame, kb: DataFrame, threshold: float = THRESHOLD, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(mention_id, entity_id, score, rank): entities of the same name (1.0) or alias (0.9); only where there is none, those
    that are similar enough.

    Texts are searched once each, whatever the number of their mentions. Similar names of more than two characters share a
    pair of neighbouring characters if the threshold is above about 0.5 plus half a character, so that pair deals out the
    join; below it, lengths alone bound the pairs of a type."""
    asked = mentions.select("mention_id", kb_normalize(F.col("text")).alias("key"), F.col("type").alias("expected"))
    texts = asked.select("key", "expected").distinct()
    index = names(kb)
    index = index.withColumn("wanted", F.explode(expectable(F.col("type"))))
    fits = F.col("expected").eqNullSafe(F.col("wanted"))
    exact = texts.join(index.withColumnRenamed("key", "own"), (F.col("key") == F.col("own")) & fits)
    exact = exact.groupBy("key", "expected", "entity_id").agg(F.max(F.when(F.col("kind") == "name", 1.0).otherwise(0.9)).alias("score"))
    found = exact.select(F.col("key").alias("k"), F.col("expected").alias("e")).distinct()
    open_ = texts.filter("key <> ''").join(found, (F.col("key") == F.col("k")) & F.col("expected").eqNullSafe(F.col("e")), "left_anti")
    other = index.select("entity_id", "wanted", F.col("key").alias("name")).distinct()
    least, most = F.least(F.length("key"), F.length("name")), F.greatest(F.length("key"), F.length("name"))
    # a name that holds the other passes from a shorter length on than an edited one
    near = 0.8 * least / most + 0.2 >= threshold
    if threshold > 0.5:
        left, right = open_.withColumn("gram", F.explode(_grams(F.col("key")))), other.withColumn("own_gram", F.explode(_grams(F.col("name"))))
        pairs = left.join(right, (F.col("gram") == F.col("own_gram")) & fits).filter(near).select("key", "expected", "entity_id", "name")
        few = 1 / (threshold - 0.5) + 2
        short = open_.filter(F.length("key") <= few).join(other.filter(F.length("name") <= few), fits).filter(near)
        pairs = pairs.union(short.select("key", "expected", "entity_id", "name")).distinct()
    else:
        pairs = open_.join(other, fits).filter(near).select("key", "expected", "entity_id", "name")
    fuzzy = pairs.withColumn("score", similarity(F.col("key"), F.col("name"))).filter(F.col("score") >= threshold)
    fuzzy = fuzzy.groupBy("key", "expected", "entity_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("key", "expected").orderBy(F.desc("score"), "entity_id")
    ranked = exact.union(fuzzy).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_candidates)
    ranked = ranked.withColumnsRenamed({"key": "k", "expected": "e"})
    return asked.join(ranked, (F.col("key") == F.col("k")) & F.col("expected").eqNullSafe(F.col("e"))).select("mention_id", "entity_id", "score", "rank")


def occurrences(haystack: Column, needle: Column) -> Column:
    return F.when(F.length(needle) > 0, (F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / F.length(needle)).otherwise(F.lit(0.0))


def context_relevance(context: Column, name: Column, aliases: Column, attributes: Column) -> Column:
    """How often the context names the entity, an alias, or an attribute of more than three characters, on a scale to 1."""
    text = F.lower(context)
    terms = F.concat(F.array(F.lower(name)), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda x: F.lower(x)))
    values = F.filter(F.transform(F.map_values(F.coalesce(attributes, F.create_map().cast("map<string,string>"))), lambda x: F.lower(x)), lambda x: F.length(x) > 3)
    n = F.aggregate(F.concat(terms, values), F.lit(0.0), lambda s, x: s + F.coalesce(occurrences(text, x), F.lit(0.0)))
    return F.coalesce(F.least(F.lit(1.0), F.log(1.0 + n) / 2), F.lit(0.0))


def disambiguate(mentions: DataFrame, kb: DataFrame, found: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(mention_id, entity_id, score, linked_by): the one candidate, or the best by score and context if it is good enough."""
    none = F.lit(None)
    full = kb.select(
        "entity_id", "name", (F.col("aliases") if "aliases" in kb.columns else none).cast("array<string>").alias("aliases"),
        (F.col("attributes") if "attributes" in kb.columns else none).cast("map<string,string>").alias("attributes"),
    )
    rows = found.join(full, "entity_id").join(mentions.select("mention_id", "context"), "mention_id")
    all_of = Window.partitionBy("mention_id")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(all_of))
    context = context_relevance(F.col("context"), F.col("name"), F.col("aliases"), F.col("attributes"))
    rows = rows.withColumn("combined", F.when(F.col("n") == 1, F.col("score")).otherwise(F.col("score") * (0.5 + 0.5 * context)))
    rows = rows.withColumn("place", F.row_number().over(all_of.orderBy(F.desc("combined"), "rank")))
    kept = rows.filter((F.col("place") == 1) & ((F.col("n") == 1) | (F.col("combined") >= accept)))
    return kept.select("mention_id", "entity_id", F.col("combined").alias("score"), F.when(F.col("n") == 1, "only").otherwise("context").alias("linked_by"))


def link(mentions: DataFrame, kb: DataFrame, threshold: float = THRESHOLD, max_candidates: int = MAX_CANDIDATES, accept: float = ACCEPT) -> DataFrame:
    """(mention_id, entity_id, score, linked_by) of all mentions that can be linked."""
    return disambiguate(mentions, kb, candidates(mentions, kb, threshold, max_candidates), accept)


def unlinked(mentions: DataFrame, links: DataFrame) -> DataFrame:
    return mentions.join(links.select("mention_id"), "mention_id", "left_anti")


def suggest(mentions: DataFrame, kb: DataFrame, domain: str) -> DataFrame:
    """New rows for a knowledge base: one for each unlinked text and type, numbered on from the entities of the type."""
    have = kb.groupBy("type").agg(F.count(F.lit(1)).alias("have"))
    new = mentions.groupBy(kb_normalize(F.col("text")).alias("key"), "type").agg(F.min("text").alias("name")).filter("key <> ''")
    place = F.row_number().over(Window.partitionBy("type").orderBy("key"))
    slug = F.lower(F.regexp_replace("type", r"[^A-Za-z0-9]+", "_"))
    numbered = new.withColumn("place", place).join(have, "type", "left")
    return numbered.select(F.concat(F.lit(domain + "_"), slug, F.lit("_"), (F.coalesce("have", F.lit(0)) + F.col("place")).cast("string")).alias("entity_id"), "name", "type")


def get_or_create(incoming: DataFrame, kb: DataFrame) -> DataFrame:
    """incoming (row_id, entity_id, name, type) with resolved: the entity of its id, else of its normalised name and type,
    else null, and created, true for the first row of each that is null."""
    by_id = kb.select(F.col("entity_id").alias("own")).distinct()
    by_name = kb.groupBy(kb_normalize(F.col("name")).alias("key"), F.col("type").alias("kind")).agg(F.min("entity_id").alias("same"))
    key = kb_normalize(F.col("name"))
    rows = incoming.withColumn("k", key).join(by_id, F.col("entity_id") == F.col("own"), "left").join(by_name, (F.col("k") == F.col("key")) & (F.col("type") == F.col("kind")), "left")
    rows = rows.withColumn("resolved", F.coalesce("own", "same"))
    first = F.row_number().over(Window.partitionBy("k", "type", F.col("resolved").isNull()).orderBy("row_id"))
    return rows.select(*incoming.columns, "resolved", (F.col("resolved").isNull() & (first == 1)).alias("created"))
