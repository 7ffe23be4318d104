"""Credibility of a source by its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of football sources, by parts of their hosts, with accuracy, transparency and expertise.
OFFICIAL = ("fifa.com", "uefa.com", "premierleague.com", "thefa.com")
SPORTS = ("espn.com", "skysports.com", "goal.com", "bbc.co.uk/sport")
NEWS = ("guardian.co.uk", "telegraph.co.uk", "nytimes.com")
BLOGS = ("wordpress.com", "blogspot.com", "medium.com")
TIERS = ((OFFICIAL, 0.9, 0.85, 0.95), (SPORTS, 0.8, 0.75, 0.85), (NEWS, 0.8, 0.8, 0.7), (BLOGS, 0.6, 0.5, 0.5))
ACCURACY, BIAS, TRANSPARENCY, CONSISTENCY = 0.7, 0.5, 0.6, 0.7
#: Expertise of an unknown football source, and of any source in another domain.
UNKNOWN, ELSEWHERE = 0.6, 0.5
WEIGHTS = {"accuracy": 0.4, "expertise": 0.3, "consistency": 0.2, "transparency": 0.1}
CACHE_DAYS = 30


def evaluate(host: Column, domain: str | None = "football") -> Column:
    """struct<accuracy, bias, transparency, consistency, expertise, overall>."""
    accuracy, transparency, expertise = F.lit(ACCURACY), F.lit(TRANSPARENCY), F.lit(ELSEWHERE)
    if domain == "football":
        expertise = F.lit(UNKNOWN)
        for hosts, a, t, e in reversed(TIERS):
            here = F.lit(False)
            for h in hosts:
                here = here | F.contains(host, F.lit(h))
            accuracy, transparency, expertise = F.when(here, a).otherwise(accuracy), F.when(here, t).otherwise(transparency), F.when(here, e).otherwise(expertise)
    parts = {"accuracy": accuracy, "expertise": expertise, "consistency": F.lit(CONSISTENCY), "transparency": transparency}
    overall = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.struct(accuracy.alias("accuracy"), F.lit(BIAS).alias("bias"), transparency.alias("transparency"), F.lit(CONSISTENCY).alias("consistency"), expertise.alias("expertise"), overall.alias("overall"))


def cached(asked: DataFrame, cache: DataFrame, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """asked (key, overall) against cache (key, overall_score, updated_at, uses): (key, score, uses, state). A fresh entry is
    reused; a stale one is updated and its uses counted up; a key without one is new."""
    held = cache.select(F.col("key"), "overall_score", "updated_at", "uses")
    fresh = F.col("updated_at") > now - F.make_dt_interval(F.lit(days))
    state = F.when(F.col("updated_at").isNull(), "new").when(fresh, "reused").otherwise("updated")
    joined = asked.join(held, "key", "left").withColumn("state", state)
    uses = F.when(F.col("state") == "reused", F.col("uses")).when(F.col("state") == "updated", F.col("uses") + 1).otherwise(F.lit(1))
    return joined.select("key", F.when(F.col("state") == "reused", F.col("overall_score")).otherwise(F.col("overall")).alias("score"), uses.cast("long").alias("uses"), "state")
