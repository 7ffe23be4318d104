"""Contradictions between claims.

claims: (claim_id, entity_id, claim_type, sentiment, content, confidence), a row for each entity that a claim mentions. Claims
of one entity that say the same in the same tone are one class, named by its least claim_id; classes are compared, not
claims, so that a claim that is repeated many times costs one row. `members` leads back from classes to claims.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a negation, and pairs of terms that oppose one another.
NEGATIONS = ("not", "n't", "never", "no", "disagree", "incorrect", "false", "untrue")
OPPOSED = (("win", "lose"), ("victory", "defeat"), ("true", "false"), ("confirm", "deny"), ("agree", "disagree"))
SENTIMENT_GAP = 1.0
MIN_LENGTH = 20

_SAME = ["entity_id", "claim_type", "sentiment", "content"]


def classes(claims: DataFrame) -> DataFrame:
    """(class_id, entity_id, claim_type, sentiment, content, n, confidence); content is lower case."""
    return claims.withColumn("content", F.lower("content")).groupBy(*_SAME).agg(F.min("claim_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


def members(claims: DataFrame, of: DataFrame) -> DataFrame:
    """(class_id, claim_id)."""
    a, b = claims.withColumn("content", F.lower("content")).alias("a"), of.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _SAME]
    return a.join(b, same[0] & same[1] & same[2] & same[3]).select("b.class_id", "a.claim_id")


def _any(content: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(content, F.lit(t))
    return out


def common_words(a: Column, b: Column) -> Column:
    """Whether more than half of the smaller set of words is in the other."""
    x, y = (F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != "")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) > F.least(F.size(x), F.size(y)) * 0.5


KINDS = ("sentiment_conflict", "direct_negation", "factual_conflict")


def kind(a: str, b: str, kinds: Sequence[str] = KINDS) -> Column:
    """Why two claims of one entity contradict one another: the first rule that holds, else null. With fewer kinds, rules
    that come after the last of them aren't tried."""
    one, two = F.col(f"{a}.content"), F.col(f"{b}.content")
    tone = F.abs(F.col(f"{a}.sentiment") - F.col(f"{b}.sentiment")) > SENTIMENT_GAP
    negated = (_any(one, NEGATIONS) & F.contains(one, two)) | (_any(two, NEGATIONS) & F.contains(two, one))
    opposed = F.lit(False)
    for x, y in OPPOSED:
        opposed = opposed | (F.contains(one, F.lit(x)) & F.contains(two, F.lit(y))) | (F.contains(one, F.lit(y)) & F.contains(two, F.lit(x)))
    both = (F.col(f"{a}.claim_type") == "factual") & (F.col(f"{b}.claim_type") == "factual") & (F.length(one) > MIN_LENGTH) & (F.length(two) > MIN_LENGTH)
    last = max(KINDS.index(k) for k in kinds)
    out = F.when(tone, KINDS[0])
    for name, rule in list(zip(KINDS, (tone, negated, both & opposed & common_words(one, two)), strict=True))[1 : last + 1]:
        out = out.when(rule, name)
    return out


def conflicts(of: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(entity_id, c1, c2, kind, n_pairs) of the classes of one entity that contradict one another, c1 < c2; n_pairs counts
    the pairs of claims that they stand for."""
    a, b = of.alias("a"), of.alias("b")
    met = a.join(b, (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.class_id") < F.col("b.class_id"))).withColumn("kind", kind("a", "b", kinds))
    return met.filter(F.col("kind").isin(*kinds)).select("a.entity_id", F.col("a.class_id").alias("c1"), F.col("b.class_id").alias("c2"), "kind", (F.col("a.n") * F.col("b.n")).alias("n_pairs"))


def candidates(claims: DataFrame, claim_id: int) -> DataFrame:
    """(claim_id): claims that share an entity with one, without itself."""
    entities = claims.filter(F.col("claim_id") == claim_id).select("entity_id").distinct()
    return claims.filter(F.col("claim_id") != claim_id).join(F.broadcast(entities), "entity_id", "left_semi").select("claim_id").distinct()


def records(found: DataFrame, of: DataFrame) -> DataFrame:
    """(primary_id, contra_id, kind): the more confident class first, the first one on a tie; each triple once."""
    one = of.select(F.col("class_id").alias("c1"), F.col("confidence").alias("p1")).distinct()
    two = of.select(F.col("class_id").alias("c2"), F.col("confidence").alias("p2")).distinct()
    first = F.col("p1") >= F.col("p2")
    rows = found.join(one, "c1").join(two, "c2")
    return rows.select(F.when(first, F.col("c1")).otherwise(F.col("c2")).alias("primary_id"), F.when(first, F.col("c2")).otherwise(F.col("c1")).alias("contra_id"), "kind").distinct()


def entity_attributes(nodes: DataFrame) -> DataFrame:
    """(node_id, attribute): no rule compares attributes of one entity, so there are no rows."""
    return nodes.select("node_id", F.lit(None).cast("string").alias("attribute")).filter("false")
